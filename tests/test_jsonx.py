import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import jsonx

FALSY = ["{}", '{"k":null}', '{"k":0}', '{"k":0.0}', '{"k":""}', '{"k":false}', '{"k":{}}', '{"k":[]}']
TRUTHY = {'"0"': "0", '"{}"': "{}", "1": "1", "-1": "-1", "0.10": "0.1", '"x"': "x", "true": "true", '{"a":1}': '{"a":1}', "[0]": "[0]"}


def test_truthiness(spark):
    rows = [(j, None) for j in FALSY] + [(f'{{"k":{j}}}', v) for j, v in TRUTHY.items()]
    df = spark.createDataFrame(rows, "j string, want string")
    got = df.select("j", "want", jsonx.first_truthy(jsonx.parse("j"), "k").alias("got")).collect()
    assert [(r.j, r.got) for r in got] == [(r.j, r.want) for r in got]


def test_presence_is_not_truthiness(spark):
    df = spark.createDataFrame([('{"k":null}',), ("{}",), ('{"k":"v"}',)], "j string")
    assert [r[0] for r in df.select(jsonx.get_text(jsonx.parse("j"), "k", "d")).collect()] == [None, "d", "v"]
    assert [r[0] for r in df.select(jsonx.is_null_key(jsonx.parse("j"), "k")).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2025-01-02T03:04:05", "2025-01-02 03:04:05"),
        ("2025-01-02T03:04:05Z", "2025-01-02 03:04:05"),
        ("2025-01-02T03:04:05-07:00", "2025-01-02 10:04:05"),
        ("2025-01-02 03:04:05.123", "2025-01-02 03:04:05.123"),
        ("2025-01-02", "2025-01-02 00:00:00"),
        ("2025-01-02T03", "2025-01-02 03:00:00"),
        ("20250102", "2025-01-02 00:00:00"),
        ("20250102T030405", "2025-01-02 03:04:05"),
        *((bad, None) for bad in ("2025-W54-1", "2025", "2025-01", "12:30", "2025-1-2", " 2025-01-02", "2025-01-02T24:00:00", "01/02/2025", "1700000000000", "2025-02-30", "", None)),
    ],
)
def test_iso_timestamps(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(jsonx.iso_timestamp(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_every_iso_form_equals_fromisoformat(spark):
    dates = ["2025-01-02", "20250102", "2025-W01-1", "2025W011", "2025-W53", "2020-W53-7", "2025-W00-1", "2025-1-2", "2025", "2025-01", "2024-02-30", "2025-W01", "2020W53"]
    times = ["", "03", "0304", "03:04", "030405", "03:04:05", "03:04:05.1", "03:04:05,123456", "030405.123456789", "03:04:05.", "24:00:00", "3:04"]
    zones = ["", "Z", "+07:00", "-0730", "+05", "+01:02:03", "+7"]
    texts = sorted({d + (s + t + z if t else "") for d in dates for s in "T x_" for t in times for z in zones})

    def want(text):
        try:
            at = dt.datetime.fromisoformat(text)
        except ValueError:
            return None
        return (at.astimezone(dt.UTC) if at.tzinfo else at).strftime("%Y-%m-%d %H:%M:%S.%f")

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.date_format(jsonx.iso_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()
    assert {r.t: r.at for r in rows} == {t: want(t) for t in texts}


@pytest.mark.parametrize(
    ("text", "want"),
    [("2 Jan 24 03:04 EST", "2024-01-02 08:04:00"), ("Tue, 2 Jan 2024 03:04:05 -0700", "2024-01-02 10:04:05"), ("02 January 2024 3:04:05", "2024-01-02 03:04:05"), ("Wed, 31 Dec 69 23:59:59 PDT", "1970-01-01 06:59:59"), ("Tue, 02 Jan 2024", "2024-01-02 00:00:00"), ("Tue, 32 Jan 2024 03:04:05 GMT", None)],
)
def test_rfc_822_in_full(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(jsonx.feed_timestamp(F.col("t")).cast("string")).first()[0] == want


def test_feed_dates(spark):
    rows = [("Tue, 02 Jan 2024 03:04:05 GMT",), ("2 Jan 2024 03:04:05 +0200",), ("2024-01-02",), ("soon",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(jsonx.feed_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00", None, None]


def test_hash_ignores_key_order_and_preset_wins(spark):
    df = spark.createDataFrame([('{"a":1,"b":2}', None), ('{ "b":2, "a":1.0 }', None), ("x", "preset")], "p string, c string")
    hashes = [r[0] for r in df.select(jsonx.content_hash("p", F.col("c"))).collect()]
    assert hashes[0] == hashes[1] and hashes[2] == "preset"


def test_lists_are_wrapped(spark):
    df = spark.createDataFrame([("[1,2]",), ('{"a":1}',), ("[]",)], "p string")
    assert [r[0] for r in df.select(jsonx.wrap_list("p")).collect()] == ['{"items":[1,2]}', '{"a":1}', '{"items":[]}']
    assert dt.datetime(2024, 1, 1)
