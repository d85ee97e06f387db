import pandas as pd
from pyspark.sql import functions as F

from weft.streaming import events as S


def test_dedup_over_batches(spark, tmp_path):
    a = "one two three four five six seven eight nine ten"
    b = "red orange yellow green blue indigo violet white black grey"
    source = tmp_path / "in"
    for k, rows in enumerate([[(1, a), (2, a), (3, b)], [(4, b), (5, "quite another text that nobody has seen in here before")]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        run = S.deduplicating(str(tmp_path / "index"), str(tmp_path / "kept"))
        stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert k in (0, 1)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3, 5]


def test_dedup_forgets_old_buckets(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    for number, ttl in enumerate(["30 days", "30 days", "0 seconds"]):
        S.deduplicating(str(tmp_path / "index"), str(tmp_path / "kept"), ttl=ttl)(spark.createDataFrame([(number, text)], "doc_id long, text string"), number)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [0, 2]


def rows_of(spark):
    rows = [("a", 0.0, 1), ("a", 1.0, 1), ("a", 2.0, 0), ("a", 3.0, 1), ("a", 4.0, 1), ("a", 5.0, 1), ("b", 0.0, 1), ("b", 6.0, 1), ("b", 7.0, 1), ("b", 8.0, 1), ("c", 0.0, 1), ("c", 40.0, 1), ("c", 41.0, 1), ("c", 42.0, 1)]
    return spark.createDataFrame(rows, "key string, seconds double, hit int"), {"a": 5.0, "b": 8.0}


def test_confirmation_in_batches(spark):
    rows, want = rows_of(spark)
    timed = rows.withColumn("at", F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long")))
    got = {r["key"]: r["s"] for r in S.confirmed(timed, "key", "at", F.col("hit") == 1).select("key", (F.unix_micros("confirmed_at") / 1e6).alias("s")).collect()}
    assert got == want


def test_confirmation_rule_of_the_stream(spark):
    """The processor over a state held here, in several calls."""

    class State:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    rows, want = rows_of(spark)
    data, got = rows.toPandas(), {}
    for key, part in data.groupby("key"):
        processor = S.Confirmation()
        processor.state = State()
        for k in range(0, len(part), 2):
            for out in processor.handleInputRows((key,), iter([part.iloc[k : k + 2]]), None):
                got |= {r.key: r.confirmed_at for r in out.itertuples()}
    assert got == want and isinstance(data, pd.DataFrame)


def test_windows_run_as_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 5}:10:00", "view", float(k), 1) for k in range(20)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    assert S.detections(stream, F.col("value")).isStreaming
    S.tumbling(stream, "2 hours").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sum(r["n"] for r in spark.table("tumbled").collect()) == 20
    assert S.sessions(events, "30 minutes").count() == 5
