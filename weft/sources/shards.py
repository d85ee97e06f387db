"""Text files and shards: one document a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.rounds import cut


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or more files (paths may hold wildcards), with the file that each is from."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def positions(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``position``, a row's place in the given order, from 0.

    Rows are dealt to ranges of the order, which are written down once, so that all that
    follows sees the same ranges; a running sum over the few range counts gives each range
    its start, so no task sorts the whole table.
    """
    ranged = cut(rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_start")
    return ranged.join(F.broadcast(starts), "_range").withColumn("position", at.cast("long")).drop("_range", "_start")


def numbered(docs: DataFrame, order: str, size: int = 100_000) -> DataFrame:
    """Adds the shard that a running count in the given order puts a row into."""
    return positions(docs, order).withColumn("shard", F.floor(F.col("position") / size).cast("int")).drop("position")


def write_shards(docs: DataFrame, path: str, text: str = "text", size: int = 100_000) -> None:
    """One line for each document, in files of a bounded number of lines."""
    line = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\r\n]+", " ").alias("value")
    docs.select(line).write.option("maxRecordsPerFile", size).mode("overwrite").text(path)
