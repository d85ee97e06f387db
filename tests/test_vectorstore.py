import random

from pyspark.sql import functions as F

from weft.operators import vectorstore


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    rnd = random.Random(3)
    store = spark.createDataFrame([(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(300)], "vec_id long, embedding array<double>")
    queries = store.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    whole = sorted(vectorstore.search(store, queries).collect())
    monkeypatch.setattr(vectorstore, "MOST_QUERIES", 8)
    assert sorted(vectorstore.search(store, queries).collect()) == whole and len(whole) == 15 * 5


def test_odd_vectors_and_copies(spark):
    """Equals scoring by expressions: nulls, other lengths, zero and non-finite vectors, ties."""
    rnd = random.Random(5)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(200)]
    rows += [(200 + k, rows[0][1]) for k in range(30)]
    rows += [(240, None), (260, []), (280, [0.0] * 8), (300, [float("nan")] * 8), (320, [1.0, None] * 4), (340, [1.0] * 3), (360, [float("inf")] + [0.5] * 7), (380, rows[20][1])]
    rows += [(k + 1, v) for k, v in rows[-8:]] + [(None, rows[0][1])]
    for element in ("double", "float"):
        store = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", f"CAST(embedding AS array<{element}>) AS embedding")
        for asked in (store.where("vec_id % 20 = 0"), store.where("vec_id IN (240, 300)"), store.where("vec_id < 0")):
            queries = asked.selectExpr("vec_id AS query_id", "embedding AS query")
            order = vectorstore.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            want = vectorstore._scored(store, queries, "vec_id", "embedding").withColumn("rank", F.row_number().over(order)).where("rank <= 5")
            key = lambda r: (r["query_id"], r["rank"])
            assert repr(sorted(vectorstore.search(store, queries).collect(), key=key)) == repr(sorted(want.collect(), key=key))
    named = spark.createDataFrame([(f"n{k}", v) for k, v in rows[:230]], "name string, embedding array<double>")
    found = vectorstore.search(named, queries := named.where("name = 'n0'").selectExpr("name AS query_id", "embedding AS query"), 3, "name").collect()
    assert sorted(r["name"] for r in found) == ["n0", "n200", "n201"] and queries.count() == 1


def test_no_pair_goes_through_expressions(spark):
    """Scored pair by pair in a join, the 125,000 queries of 1 GB take days of CPU time."""
    store = spark.range(2_000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> CAST(xxhash64(id, i) / 9.3e18 AS FLOAT)) AS embedding")
    found = vectorstore.search(store, store.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query"))
    assert len(found.collect()) == 100 * 5
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
