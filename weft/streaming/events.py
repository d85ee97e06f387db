"""Streams: deduplication against an index, consecutive confirmation, detectors, windows and last-n state.

Each function takes a batch or streaming frame where Spark allows both; the stateful ones
say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weft.operators import minhash as M


def deduplicating(index_path: str, output_path: str, key: str = "doc_id", text: str = "text", ttl: str = M.TTL) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps a batch's texts that share no bucket with kept ones of this or earlier batches.

    A bucket is forgotten when nothing was inserted into it for the time to live.

    Both tables are partitioned by batch and a batch overwrites its own part, so that a
    batch that is run again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        signed = batch.select("*", M.signature(F.coalesce(text, F.lit(""))).alias("_sig")).persist()
        banded = M.bands(signed, [key], "_sig")
        try:
            index = spark.read.parquet(index_path).where(F.col("batch") < number)
            known = M.seen(banded, M.live(index, F.current_timestamp(), ttl), key)
            banded = banded.join(known, key, "left_anti")
        except Exception as e:  # the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        kept = M.keep_first(banded, key).where("kept").select(key)
        # an overwrite may not read what it replaces; each batch has a folder of its own
        banded.join(kept, key).select("band", "bucket", key, F.current_timestamp().alias("inserted_at")).write.mode("overwrite").parquet(f"{index_path}/batch={number}")
        signed.drop("_sig").join(kept, key, "left_semi").write.mode("overwrite").parquet(f"{output_path}/batch={number}")
        signed.unpersist()

    return run


def detections(frame: DataFrame, index: Column) -> DataFrame:
    """Rows whose detector index is not negative; works on streams."""
    return frame.where(index >= 0)


def confirmed(frame: DataFrame, key: str, at: str, hit: Column, hits: int = 3, gap_seconds: int = 5, end_seconds: int = 30) -> DataFrame:
    """For each key the first time at which so many hits came in a row.

    A row that is no hit starts the count anew, as does a gap of more than
    ``gap_seconds`` since the last hit; rows later than ``end_seconds`` after the first
    don't count. A batch form with windows.
    """
    order = Window.partitionBy(key).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    rows = frame.select(key, at, seconds.alias("_s"), hit.cast("int").alias("_hit"))
    rows = rows.withColumn("_begin", F.min("_s").over(Window.partitionBy(key))).where(F.col("_s") - F.col("_begin") <= end_seconds)
    last = F.last(F.when(F.col("_hit") == 1, F.col("_s")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    anew = (F.col("_hit") == 0) | (F.coalesce(F.col("_s") - last, F.lit(0.0)) > gap_seconds)
    rows = rows.withColumn("_run", F.sum(F.when(anew, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    count = F.sum("_hit").over(Window.partitionBy(key, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", count).where((F.col("_n") >= hits) & (F.col("_hit") == 1)).groupBy(key).agg(F.min(at).alias("confirmed_at"))


class Confirmation(StatefulProcessor):
    """The same rule on a stream, for transformWithStateInPandas: rows of (key, seconds, hit) in; (key, confirmed_at) out once."""

    SCHEMA = "key string, confirmed_at double"

    def __init__(self, hits: int = 3, gap: float = 5.0, end: float = 30.0) -> None:
        self.hits, self.gap, self.end = hits, gap, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n int, last double, begin double, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last, begin, done = self.state.get() if self.state.exists() else (0, 0.0, -1.0, False)
        out = []
        for part in rows:
            for s, hit in part.sort_values("seconds")[["seconds", "hit"]].itertuples(index=False):
                begin = s if begin < 0 else begin
                if done or s - begin > self.end:
                    continue
                n = 0 if not hit or (n and s - last > self.gap) else n
                if hit:
                    n, last = n + 1, s
                    if n >= self.hits:
                        done = True
                        out.append({"key": str(key[0]), "confirmed_at": float(s)})
        self.state.update((int(n), float(last), float(begin), bool(done)))
        yield pd.DataFrame(out, columns=["key", "confirmed_at"])

    def close(self) -> None:
        pass


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """Event times as timestamps with a zone, which watermarks ask for."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Counts and sums by type in windows; works on streams."""
    rows = timed(events, at).withWatermark(at, late).groupBy(F.window(at, width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap; works on streams."""
    rows = timed(events, at).withWatermark(at, late).groupBy(F.session_window(at, gap), "user_id")
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
