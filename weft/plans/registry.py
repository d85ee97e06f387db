"""Names of the queries, what runs them, and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its oracle."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query(
    "corpus_summary",
    """
    SELECT lang, count(*) AS n_docs, sum(length(text)) AS n_chars_total
    FROM documents WHERE length(text) >= 100 GROUP BY lang
    """,
)
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 100)
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars_total"))


#: Modules of this package that hold queries.
MODULES = ("text", "statistics", "dedup", "vectors", "catalog", "conversation", "events", "relational", "kernels")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"weft.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
