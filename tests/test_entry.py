import importlib
import sys

import pytest
from pyspark.sql import functions as F  # noqa: F401

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lodestitch.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.import_module("__spark_entry__")
    assert "map_use_of_force" in alone.queries() and not [n for n in alone.queries() if n.startswith("op")]


@pytest.mark.parametrize("name", ["map_use_of_force", "resolver_pass", "map_court_case", "feature_explode", "status_current", "page_text", "csv_drop", "json_drop", "ndjson_drop", "staging_updated", "court_case_stored", "catalog_run", "resolver_all_keys"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = __spark_entry__.queries()[name](spark, str(sf))
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want, key=key)
