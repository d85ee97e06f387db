"""Exact cosine search over a table of vectors with metadata on the same row."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weft.functions.nearest import ROWS, Nearest, few_copies
from weft.functions.vectors import EPSILON, dot, normalized
from weft.operators.rounds import cut

#: Query vectors that may be broadcast at once; more are searched in blocks.
MOST_QUERIES = 10_000
#: Tasks that read the store for a block of queries, so that not too many best lists are shuffled.
TASKS_PER_CORE = 4


def add(store: DataFrame, more: DataFrame) -> DataFrame:
    return store.unionByName(more, allowMissingColumns=True)


def save(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clear(store: DataFrame) -> DataFrame:
    return store.where(F.lit(False))


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of two tables that have the same place in their orders, as far as the shorter goes; adds ``position``, from 0."""
    from weft.sources.shards import positions

    return positions(left, left_order).join(positions(right, right_order), "position")


def search(store: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of the store nearest to each query (query_id, query), best first; ties by key.

    Every query meets every row of the store; each task keeps its own best k of a query
    before anything is shuffled. Queries are dealt to blocks by a hash of their id, of half
    of what may be broadcast on average. Vectors of the usual length without nulls or
    non-finite numbers meet in matrix products; pairs of others, and all under keys that
    are no whole numbers, are scored by expressions, with the same sums.
    """
    n = queries.count()
    blocks = 1 if n <= MOST_QUERIES else -(-2 * n // MOST_QUERIES)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    first = queries.where(F.col("query").isNotNull()).select(F.size("query")).first()
    whole = store.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    if first is None or not first[0] or not whole:
        found = [_scored(store, queries.where(block == b), key, vector) for b in range(blocks)]
    else:
        usual, asked = _usual(F.col(vector), first[0]) & F.col(key).isNotNull(), _usual(F.col("query"), first[0])
        plain, rest, odd = store.where(usual), store.where(~usual), queries.where(~asked)
        found = [_met(plain, queries.where(asked & (block == b)), k, key, vector, blocks > 1) for b in range(blocks)]
        if not rest.isEmpty():
            found += [_scored(rest, queries.where(asked & (block == b)), key, vector) for b in range(blocks)]
        if not odd.isEmpty():
            found += [_scored(store, odd.where(block == b), key, vector) for b in range(blocks)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    scored = functools.reduce(DataFrame.unionByName, found)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usual(v: Column, length: int) -> Column:
    """Whether a vector has that length and finite numbers only."""
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) == length) & finite, F.lit(False))


def _scored(store: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """(query_id, key, score) of all pairs."""
    q = queries.select("query_id", normalized(F.col("query")).alias("q"))
    rows = store.select(key, normalized(F.col(vector)).alias("v"))
    return rows.join(F.broadcast(q)).select("query_id", key, dot(F.col("q"), F.col("v")).alias("score"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Normalized vectors as rows, with the sums of ``normalized``."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / (np.sqrt(_dots(x, x)) + EPSILON)[:, None]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of vectors with as many others, summed one number after the other, as ``dot`` does."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _met(store: DataFrame, queries: DataFrame, k: int, key: str, vector: str, apart: bool) -> DataFrame:
    """(query_id, key, score) of each task's best k of every query; all vectors are usual ones. apart: the result is written at
    once, so that the queries' broadcast can go."""
    spark = store.sparkSession
    kind = queries.schema["query_id"].dataType
    asked = queries.select("query_id", "query").toArrow().combine_chunks()
    if not asked.num_rows:
        return spark.createDataFrame([], StructType([StructField("query_id", kind), store.schema[key], StructField("score", DoubleType())]))
    names, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asked.columns)
    shared = spark.sparkContext.broadcast((names, _matrix(lists)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best = Nearest(q, lambda at, x: _dots(q[at], x), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
                some = few_copies(x, ids, k, once=False)
                best.see(ids[some], x[some], x[some])
        at, ids, scores = best.found()
        if len(at):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids), pa.array(scores)], names=["query_id", "key", "score"])

    cores = spark.sparkContext.defaultParallelism
    rows = store.select(F.col(key).cast("long"), vector).coalesce(TASKS_PER_CORE * cores)
    out = rows.mapInArrow(read, StructType([StructField("query_id", kind), StructField("key", LongType()), StructField("score", DoubleType())]))
    out = out.select("query_id", F.col("key").cast(store.schema[key].dataType).alias(key), "score")
    if apart:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        out = cut(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        shared.destroy()
    return out
