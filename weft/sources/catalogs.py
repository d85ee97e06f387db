"""Catalog files: command tables in CSV, settings in JSON, and word dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import function_name


def commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands of one CSV file or a folder of them: rows that have both columns, with their file and line: in the order of both they come as they are written."""
    rows = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    names = {c.strip(): c for c in rows.columns}
    if not {"Task/Intent", "command"} <= names.keys():
        return spark.createDataFrame([], "task_intent string, command_text string, function_name string, file string, line long")
    intent, command = F.col(f"`{names['Task/Intent']}`"), F.col(f"`{names['command']}`")
    # a file's parts may be read in any order; within a part, rows come as they are written
    place = F.row_number().over(Window.partitionBy("file").orderBy("_part", "_at")).cast("long")
    picked = rows.select(intent.alias("task_intent"), command.alias("command_text"), function_name(intent).alias("function_name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"))
    picked = picked.withColumn("line", place).drop("_part", "_at")
    return picked.where("task_intent IS NOT NULL AND command_text IS NOT NULL")


def import_settings(spark: SparkSession, path: str) -> DataFrame:
    """A file of nested settings as (category, key, value)."""
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("category", "inner"))
    return outer.select("category", F.explode(F.from_json("inner", "map<string, string>")).alias("key", "value"))


def export_settings(settings: DataFrame, path: str) -> None:
    """(category, key, value) as one line of nested JSON. Settings fit on one line by their nature."""
    inner = settings.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    whole = inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "m")))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def dictionary(spark: SparkSession, path: str, default: int = 10) -> DataFrame:
    """Words with counts, one a line; a word without a number counts ten times. Compounds are joined by underscores."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    count = F.coalesce(F.element_at(parts, -1).try_cast("int") if hasattr(F.lit(1), "try_cast") else F.expr("try_cast(element_at(split(trim(value), '\\\\s+'), -1) AS int)"), F.lit(default))
    return rows.select(F.lower(F.element_at(parts, 1)).alias("word"), F.when(F.size(parts) > 1, count).otherwise(default).alias("count"))
