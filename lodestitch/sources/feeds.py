"""Items of RSS, RDF and Atom feeds, parsed as they are read: a cut file gives the items before the cut, and is told."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as bl

#: The elements, by local name and in order of preference, that each field is taken from.
_FIELDS = {"title": ("title",), "published": ("pubDate", "published", "issued"), "summary": ("description", "summary", "encoded", "content"), "author": ("author", "creator")}
_ROOTS = ("rss", "RDF", "feed")


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _text(element: ElementTree.Element) -> str | None:
    return "".join(element.itertext()).strip() or None


def _link(found: list[ElementTree.Element]) -> str | None:
    """The text of a link, or the address of an Atom link, an alternate one before others."""
    for link in sorted(found, key=lambda x: x.get("rel", "alternate") != "alternate"):
        if address := (_text(link) or link.get("href")):
            return address
    return None


def _author(element: ElementTree.Element) -> str | None:
    names = {_local(x): _text(x) for x in element}
    return names.get("name") or names.get("email") or _text(element)


def entry(item: ElementTree.Element) -> dict[str, str]:
    children: dict[str, list[ElementTree.Element]] = {}
    for child in item:
        children.setdefault(_local(child), []).append(child)
    out = {"link": _link(children.get("link", []))}
    for field, names in _FIELDS.items():
        read = _author if field == "author" else _text
        out[field] = next((x for n in names for c in children.get(n, []) if (x := read(c))), None)
    return {k: out[k] for k in ("title", "link", "published", "summary", "author") if out[k] is not None}


def whole_file(file: str, raw: bytes | None) -> Iterator[tuple]:
    """file, position, payload {"entry": {...}} and error: a row for each item with a title or a link, and one where the file is no feed or breaks off."""
    n, root = 0, None
    try:
        for event, element in ElementTree.iterparse(io.BytesIO(raw or b""), ("start", "end")):
            if event == "start":
                root = root or _local(element)
            elif _local(element) in ("item", "entry"):
                found = entry(element)
                if "title" in found or "link" in found:
                    yield file, n, json.dumps({"entry": found}, ensure_ascii=False, separators=(",", ":")), None
                n += 1
                element.clear()
    except ElementTree.ParseError as error:
        yield file, n, None, f"not valid XML: {error}"
    else:
        if root not in _ROOTS:
            yield file, n, None, f"no feed: {root}"


def items(files: DataFrame) -> DataFrame:
    """file, position, payload and error of whole files (file, content)."""
    schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("payload", pa.string()), ("error", pa.string())])
    return files.select("file", "content").mapInArrow(bl.rows(whole_file, schema), "file string, position bigint, payload string, error string")
