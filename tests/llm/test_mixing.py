from helpers import DOCS

from lodestitch.llm import mixing


def _docs(spark):
    rows = []
    for k in range(300):
        source, lang = ("big", "en") if k % 3 else (f"s{k % 5}", "de" if k % 2 else "en")
        rows.append((k, ("word " * (1 + k % 9)) + ("@" if k % 7 == 0 else ""), lang, source, 0))
    return spark.createDataFrame(rows, DOCS)


def _margins(rows, tokens):
    out = {}
    for r in rows:
        for m in mixing.MARGINS:
            out[m, r[m]] = out.get((m, r[m]), 0) + tokens(r)
    return out


def test_production_sweeps_meet_the_targets(spark):
    cells = [(f"s{a}", f"l{b}", f"t{c}", 1 + (a * 7 + b * 5 + c * 3) % 11 * (9 if a == 0 else 1)) for a in range(5) for b in range(3) for c in range(3)]
    rows = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint"), keep=0.3).collect()
    kept = sum(r.tokens for r in rows) * 0.3
    assert {r.residual for r in rows} == {rows[0].residual} and rows[0].residual <= mixing.TOLERANCE and all(0 <= r.probability <= 1 for r in rows)
    got, has = _margins(rows, lambda r: r.probability * r.tokens), _margins(rows, lambda r: r.tokens)
    for m in mixing.MARGINS:
        own = {k: v**mixing.ALPHA for k, v in has.items() if k[0] == m}
        target = {k: v / sum(own.values()) * kept for k, v in own.items()}
        assert all(target[k] < has[k] and abs(got[k] - target[k]) <= mixing.TOLERANCE * kept + 1e-6 for k in own)


def test_contradicting_targets_are_told(spark):
    cells = [("a", "x", "t", 1000), ("b", "y", "t", 1), ("c", "y", "t", 1)]
    rows = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint"), keep=0.9).collect()
    assert all(0 <= r.probability <= 1 for r in rows) and rows[0].residual >= 0


def test_expected_tokens_and_a_given_topic(spark):
    rows = mixing.mixture(_docs(spark), keep=0.5).collect()
    assert len(rows) == 300 and all(0 <= r.probability <= 1 for r in rows)
    expected = sum(r.probability * r.n_tokens for r in rows)
    assert abs(expected / sum(r.n_tokens for r in rows) - 0.5) < 0.02
    again = mixing.mixture(_docs(spark).repartition(7), keep=0.5).collect()
    assert {(r.doc_id, r.sampled) for r in rows} == {(r.doc_id, r.sampled) for r in again}
    assert {r.topic for r in mixing.mixture(_docs(spark), topic="lang").collect()} == {"en", "de"}


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    _docs(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb_con = duckdb.connect()
    duckdb_con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in mixing.op7_mixing(spark, str(tmp_path)).collect())
    assert got == sorted(duckdb_con.sql(mixing.OP7_SQL).fetchall())


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, None, 0, 5), (1, "", "en", None, 0, 6), (1, "a b", None, "s", 0, 7), (2, "c " * 100_000, "en", "s", 0, 8)], DOCS + ", weight int").selectExpr("*", "1 as topic", "2 as probability", "3 as row")
    rows = mixing.mixture(df).collect()
    assert len(rows) == 4 and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.sample_documents(df).columns == df.columns
    assert sorted(mixing.sample_documents(df, probability="probability").columns) == sorted(df.columns)
    assert mixing.mixture(spark.createDataFrame([], DOCS)).count() == 0
    silent = spark.createDataFrame([(1, "", "en", "s", 0)], DOCS)
    assert mixing.mixture(silent).first().probability == 1.0


def test_rows_without_an_id_or_with_the_same_one_have_draws_of_their_own(spark):
    texts = [f"word{k} " * 5 for k in range(1_500)]
    groups = {"null": [(None, t) for t in texts], "same": [(7, t) for t in texts], "copies": [(None, "the same text " * 2)] * 1_500, "unique": list(enumerate(texts, 100))}
    for name, pairs in groups.items():
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in pairs], DOCS).repartition(3)
        rows = mixing.mixture(docs, keep=0.5, most=1).collect()
        p = rows[0].probability
        assert len(rows) == 1_500 and abs(p - 0.5) < 0.01
        share = sum(r.sampled for r in rows) / len(rows)
        assert abs(share - p) < 4 * (p * (1 - p) / len(rows)) ** 0.5, (name, share)
