"""Text of web pages and documents, and file names."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 5_000

#: What goes from HTML, in this order, and what stands for it.
_REMOVED = ((r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "))
_BLANKS = r"[ \t\r\n]+"


_CLOSED = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


def _unescaped_closed(text: str) -> str:
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] in html.entities.html5 else m[0], text)


def unescaped(c: Column, closed: bool = False) -> Column:
    """Text with all named and numeric entities of HTML 5 replaced, once each; with `closed`, only those that end in a semicolon."""
    replaced = _unescaped_closed if closed else html.unescape

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: replaced(t) if t is not None and "&" in t else t)

    return F.pandas_udf(run, "string")(c)


def _plain(c: Column, closed: bool) -> Column:
    return F.trim(F.regexp_replace(unescaped(c, closed), _BLANKS, " "))


def html_text(page: Column, most: int = MAX_CHARS, closed: bool = False) -> Column:
    """Visible text, blanks collapsed, cut to `most` characters; `closed` as in unescaped()."""
    for pattern, by in _REMOVED:
        page = F.regexp_replace(page, pattern, by)
    return F.substring(_plain(page, closed), 1, most)


def html_title(page: Column, url: Column, closed: bool = False) -> Column:
    """The first title, or the url; `closed` as in unescaped()."""
    return F.coalesce(F.nullif(_plain(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), closed), F.lit("")), url)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(c, _BLANKS, " ")) != "", c)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def joined_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """The page texts (page_no, text) of each document, joined by line breaks in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))
