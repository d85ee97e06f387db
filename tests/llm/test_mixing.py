import hashlib

import duckdb
from tests.llm.conftest import frame, prose

from weft.llm import mixing


def corpus():
    rows = []
    for k in range(300):
        source = "a" if k % 3 else f"s{k % 7}"
        lang = "en" if k % 4 else "fr"
        rows.append((k, prose(k, 20 + 37 * (k % 11)) + ("!!" if k % 5 == 0 else ""), lang, source))
    return rows


def test_report_equals_its_sql(spark, odd_rows):
    docs = frame(spark, corpus() + odd_rows)
    got = mixing.report(docs)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source", "lang").toArrow())
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({mixing.oracle()})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_margins_meet_their_targets(spark):
    docs = frame(spark, corpus())
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double")}
    cells = mixing.raked(mixing.cells_of(docs), sweeps=20, targets=targets).toPandas()
    share = cells.groupby("_lang").w.sum() / cells.w.sum()
    assert abs(share["en"] - 0.5) < 1e-3 and abs(cells.w.sum() - cells.t.sum()) < 1e-6 * cells.t.sum()


def test_the_sample_meets_the_targets(spark):
    """Shares of the tokens that are expected in the sample, and of those that are in it."""
    docs = frame(spark, [(k, *row[1:]) for k, row in enumerate(corpus() * 40)])
    given = {"lang": {"en": 0.4, "fr": 0.6}, "source": {"a": 0.5, **{f"s{k}": 0.5 / 7 for k in range(7)}}}
    targets = {name: spark.createDataFrame(list(shares.items()), "value string, share double") for name, shares in given.items()}
    rows = mixing.report(docs, targets=targets).toPandas()
    assert rows.probability.max() <= 1.0 and 0.2 < rows.sampled.mean() < 0.95
    expected, kept = rows.assign(tokens=rows.tokens * rows.probability), rows[rows.sampled]
    spread = (rows.tokens**2 * rows.probability * (1 - rows.probability)).sum() ** 0.5 / expected.tokens.sum()
    assert spread < 0.03
    for name, shares in given.items():
        for value, share in shares.items():
            for some, error in ((expected, 1e-3), (kept, 3 * spread)):
                assert abs(some[some[name] == value].tokens.sum() / some.tokens.sum() - share) < error, (name, value)


def test_own_shares_tempered_are_met_by_the_sample(spark):
    rows = mixing.report(frame(spark, corpus())).toPandas()
    for name, power in mixing.TEMPER.items():
        own = rows.groupby(name).tokens.sum() ** power
        got = (rows.tokens * rows.probability).groupby(rows[name]).sum()
        assert (abs(got / got.sum() - own / own.sum()) < 1e-3).all()


def test_sample_keeps_columns_and_decides_by_id(spark, odd_rows):
    docs = frame(spark, corpus() + odd_rows)
    report = {(str(r["doc_id"]), r["sampled"]) for r in mixing.report(docs).collect()}
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {str(r["doc_id"]) for r in kept.collect()} == {d for d, s in report if s}
    u = int(hashlib.md5(b"17").hexdigest()[:13], 16) / 2**52
    assert abs(spark.range(1).select(mixing.chance(mixing.F.lit(17)).alias("u")).first()["u"] - u) < 1e-15


def test_empty_table(spark):
    assert mixing.report(frame(spark, [])).count() == 0
    assert mixing.sample(frame(spark, [])).count() == 0
    assert mixing.report(frame(spark, [(1, None), (2, "")])).count() == 2
