"""Queries over the event stream's table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.plans.registry import query
from weft.session import table
from weft.streaming import events as S


@query("event_type_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def event_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_topk", "SELECT event_id, user_id, value FROM events WHERE value > 50 ORDER BY value DESC, event_id LIMIT 5")
def event_topk(spark, sf_dir):
    """The five largest over a limit: a top-k report."""
    return table(spark, sf_dir, "events").where("value > 50").orderBy(F.desc("value"), "event_id").limit(5).select("event_id", "user_id", "value")


@query("user_topk", "SELECT user_id, event_id, value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def user_topk(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("user_id", "event_id", "value", "rank")


@query("event_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    made = S.tumbling(table(spark, sf_dir, "events"), "6 hours")
    return made.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sliding", "SELECT CAST(epoch(b) AS BIGINT) + k * 3600 AS start_s, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, unnest([0, -1, -2]) AS k FROM events) GROUP BY ALL")
def event_sliding(spark, sf_dir):
    rows = S.timed(table(spark, sf_dir, "events")).groupBy(F.window("ts", "3 hours", "1 hour")).agg(F.count("*").alias("n"))
    return rows.select(F.unix_seconds("window.start").alias("start_s"), "n")


@query(
    "user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark, sf_dir):
    made = S.sessions(table(spark, sf_dir, "events"), "2 hours")
    return made.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _confirm_sql(below: int, hits: int, gap: int, end: int) -> str:
    return f"""WITH r AS (SELECT user_id, ts, epoch_us(ts) / 1e6 AS s, CAST(value < {below} AS INTEGER) AS hit FROM events),
    b AS (SELECT * FROM (SELECT *, min(s) OVER (PARTITION BY user_id) AS beg FROM r) WHERE s - beg <= {end}),
    l AS (SELECT *, last_value(CASE WHEN hit = 1 THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
    n AS (SELECT *, sum(CASE WHEN hit = 0 OR coalesce(s - prev, 0) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l),
    c AS (SELECT *, sum(hit) OVER (PARTITION BY user_id, run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
    SELECT user_id, epoch_us(min(ts)) AS confirmed_us FROM c WHERE k >= {hits} AND hit = 1 GROUP BY user_id"""


def _confirmed(spark, sf_dir, below, hits, gap, end):
    made = S.confirmed(table(spark, sf_dir, "events"), "user_id", "ts", F.col("value") < below, hits, gap, end)
    return made.select("user_id", F.unix_micros(F.col("confirmed_at").cast("timestamp")).alias("confirmed_us"))


@query("consecutive_confirm", _confirm_sql(45, 3, 86_400, 864_000))
def consecutive_confirm(spark, sf_dir):
    """Three values under 45 in a row, at most a day apart, within ten days of the first event."""
    return _confirmed(spark, sf_dir, 45, 3, 86_400, 864_000)


@query("second_look_confirm", _confirm_sql(55, 2, 43_200, 2_592_000))
def second_look_confirm(spark, sf_dir):
    """A second value under 55 at most half a day after the first."""
    return _confirmed(spark, sf_dir, 55, 2, 43_200, 2_592_000)


@query("counts_listing", "SELECT event_type, user_id, n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS INTEGER) AS place FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)")
def counts_listing(spark, sf_dir):
    """Counters by type, the largest first: the order of a listing."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return rows.withColumn("place", place).orderBy("event_type", F.desc("n"), "user_id")


@query("json_props", "SELECT event_type, count(*) AS n, count(DISTINCT json_keys(CAST(props AS JSON))[1]) AS first_keys FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.expr("json_object_keys(props)[0]")).alias("first_keys"))


@query("detector_hits", "SELECT event_id, user_id FROM events WHERE CAST(floor(value) AS BIGINT) % 7 - 3 >= 0")
def detector_hits(spark, sf_dir):
    return S.detections(table(spark, sf_dir, "events"), F.floor("value") % 7 - 3).select("event_id", "user_id")
