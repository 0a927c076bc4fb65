import random

import pytest
from helpers import DOCS, some_words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect_in_order(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(150):
        good = k % 5 != 0
        text = "\n".join(some_words(rng, 25) if good else "buy!! now!! " * 12 for _ in range(3))
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(good), 0))
    item = some_words(rng, 14)
    rows.append((200, f"{some_words(rng, 20)} {item} {some_words(rng, 9)}", "en", "s0", 0))
    rows.append((201, rows[1][1], "en", "s0", 0))
    rows.append((202, f"{rows[2][1].splitlines()[0]}\n{some_words(rng, 30)}", "en", "s0", 0))
    rows.append((203, None, None, None, None))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not [k for k in kept[0] if k % 5 == 0 and k < 150] and len([k for k in kept[0] if k < 150]) == 120
    assert 201 not in kept[1] and rows[2][1].splitlines()[0] not in kept[1][202]
    assert 200 in kept[2] and 200 not in kept[3]
    assert set(kept[4]) < set(kept[3]) and len(kept[4]) > 20
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[4])
