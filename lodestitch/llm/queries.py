"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from . import align, decontaminate, embeddings, language, licences, lines, media, middle, mixing, pii, quality, simhash, urls

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_urls": urls.op2_urls,
    "op3_licences": licences.op3_licences,
    "op4_media": media.op4_media,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_simhash": simhash.op9_simhash,
    "op10_language": language.op10_language,
    "op11_align": align.op11_align,
    "op12_middle": middle.op12_middle,
    "op13_embeddings": embeddings.op13_embeddings,
}

ORACLES = {
    "op1_lines": lines.OP1_SQL,
    "op3_licences": licences.OP3_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op12_middle": middle.OP12_SQL,
    "op13_embeddings": embeddings.OP13_SQL,
}
