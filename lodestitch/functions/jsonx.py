"""JSON payloads as Variant: presence, truthiness, text, timestamps and hashes.

A missing key is SQL NULL, a JSON null is a variant null; the two are kept
apart. Text that is no JSON, or has a key twice, parses to NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites, in this order, of ISO 8601 text into the form that ISO matches: basic dates, any sign before the time, basic times, missing minutes and seconds, comma fractions and their digits beyond six, basic offsets.
_ISO_STEPS = (
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3"),
    (r"(?s)^(\d{4}-\d{2}-\d{2})\D(?=\d{2})", "$1T"),
    (r"^(.{11})(\d{2})(\d{2})(\d{2})(?=[.,Z+-]|$)", "$1$2:$3:$4"),
    (r"^(.{11})(\d{2})(\d{2})(?=[Z+-]|$)", "$1$2:$3"),
    (r"^(.{10}T\d{2})(?=[Z+-]|$)", "$1:00"),
    (r"^(.{10}T\d{2}:\d{2})(?=[Z+-]|$)", "$1:00"),
    (r"^(.{19})[.,](\d{1,6})\d*", "$1.$2"),
    (r"^(.{19})[.,](?=[Z+-])", "$1"),
    (r"^(.{13,}[+-]\d{2})(\d{2})$", "$1:$2"),
    (r"^(.{13,}[+-]\d{2})$", "$1:00"),
)
ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)?)?$"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?:$|\D)"
#: Name of the column of opened fields.
OPENED = "opened"
#: JSON text of values that count as nothing.
_FALSY = r'^(null|false|""|\{\}|\[\]|-?0(\.0*)?([eE][+-]?\d+)?)$'


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(text: str | Column) -> Column:
    return F.try_parse_json(_col(text))


def opened(obj: str | Column, *keys: str) -> Column:
    """A struct of the named keys' values as Variants, read in one pass; NULL if obj is no object. As a column of its own it is computed once, however many expressions read its fields."""
    return F.try_variant_get(_col(obj), "$", "struct<" + ", ".join(f"`{k}`: variant" for k in keys or ("_",)) + ">")


def field(obj: str | Column, key: str) -> Column:
    """The value of a key as Variant, NULL if the key is missing or obj is no object. obj is a Variant, or the name OPENED of a column that opened() gave."""
    return F.col(OPENED)[key] if isinstance(obj, str) and obj == OPENED else F.try_variant_get(_col(obj), f"$.{key}", "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def text(value: Column) -> Column:
    """A value as text; NULL if missing or null. Objects and arrays as JSON."""
    return F.try_variant_get(value, "$", "string")


def truthy_text(value: Column) -> Column:
    """The text of a truthy value, else NULL: null, "", 0, false, {} and [] are falsy, "0" is not."""
    return F.when(~F.to_json(value).rlike(_FALSY), text(value))


def first_truthy(obj: str | Column, *keys: str) -> Column:
    """The text of the first key with a truthy value."""
    return F.coalesce(*(truthy_text(field(obj, k)) for k in keys))


def get_text(obj: str | Column, key: str, default: str | None = None) -> Column:
    """The text of a key; the default only where the key is missing, not where it is null."""
    value = field(obj, key)
    return text(value) if default is None else F.when(value.isNull(), F.lit(default)).otherwise(text(value))


def is_null_key(obj: str | Column, key: str) -> Column:
    """The key is there and its value is null."""
    return F.coalesce(F.is_variant_null(field(obj, key)), F.lit(False))


def pick(doc: str | Column, *keys: str) -> Column:
    """The value under the first present key, else an empty object."""
    return F.coalesce(*(field(doc, k) for k in keys), F.parse_json(F.lit("{}")))


def _week_date(value: Column) -> Column:
    """The text with a calendar date in the place of a week date that it begins with; NULL where there is none."""
    part = lambda n: F.regexp_extract(value, _WEEK, n)
    year, week, day = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    there = (year >= 1) & (week >= 1) & (F.date_add(monday, (week - 1) * 7) < F.date_sub(F.make_date(year + 1, F.lit(1), F.lit(4)), F.weekday(F.make_date(year + 1, F.lit(1), F.lit(4)))))
    date = F.date_format(F.date_add(monday, (week - 1) * 7 + day - 1), "yyyy-MM-dd")
    return F.when(there, F.concat(date, F.regexp_replace(value, r"^\d{4}-?W\d{2}(-?[1-7])?", "")))


def _extended(value: Column) -> Column:
    for pattern, by in _ISO_STEPS:
        value = F.regexp_replace(value, pattern, by)
    return F.regexp_extract(value, ISO, 0).try_cast("timestamp")


def iso_timestamp(value: Column) -> Column:
    """A timestamp from ISO text (UTC where it has no offset), NULL for anything else: dates of calendar and week, extended and basic forms."""
    return F.coalesce(_extended(value), F.when(value.rlike(_WEEK), _extended(_week_date(value))))


#: The zones that feeds name, and their offsets.
ZONES = {"UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_FEED = r"^\s*(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{2,4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+-]\d{4}|[A-Za-z]+))?)?\s*$"


def feed_timestamp(value: Column) -> Column:
    """A timestamp from RFC 822 text, such as "Tue, 02 Jan 2024 03:04:05 GMT" (years of two digits, times without seconds or zone, named zones), or from ISO text."""
    part = lambda n: F.regexp_extract(value, _FEED, n)
    year = part(3).try_cast("int")
    year = F.when(F.length(part(3)) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)
    time = F.concat(F.lpad(F.coalesce(F.nullif(part(4), F.lit("")), F.lit("0")), 2, "0"), F.lit(":"), F.coalesce(F.nullif(part(5), F.lit("")), F.lit("00")), F.lit(":"), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")))
    zones = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))
    zone = F.when(part(7).rlike("^[+-]"), part(7)).otherwise(F.coalesce(F.try_element_at(zones, F.upper(part(7))), F.lit("+0000")))
    written = F.concat_ws(" ", F.lpad(part(1), 2, "0"), F.initcap(part(2)), F.lpad(year.cast("string"), 4, "0"), time, zone)
    return F.coalesce(F.try_to_timestamp(F.when(value.rlike(_FEED), written), F.lit("dd MMM yyyy HH:mm:ss xx")), iso_timestamp(value))


def canonical(payload: str | Column) -> Column:
    """JSON text with sorted keys and no blanks; text that does not parse stays as it is."""
    return F.coalesce(F.to_json(parse(payload)), _col(payload))


def content_hash(payload: str | Column, preset: Column | None = None) -> Column:
    """sha256 of the canonical JSON; a preset checksum wins."""
    own = F.sha2(canonical(payload), 256)
    return own if preset is None else F.coalesce(preset, own)


def wrap_list(payload: str | Column) -> Column:
    """A list payload as {"items": list}, any other as it is."""
    return F.when(is_array(parse(payload)), F.concat(F.lit('{"items":'), _col(payload), F.lit("}"))).otherwise(_col(payload))


def row_json(columns: list[str]) -> Column:
    """{"row": {...}} of all given columns, nulls kept."""
    return F.to_json(F.struct(F.struct(*columns).alias("row")), {"ignoreNullFields": "false"})


def string_map(**values: Column) -> Column:
    pairs = reduce(lambda a, kv: [*a, F.lit(kv[0]), kv[1].cast("string")], values.items(), [])
    return F.create_map(*pairs)
