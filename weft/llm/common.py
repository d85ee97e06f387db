"""What the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.rounds import checkpoint_folder

#: Rows of an Arrow batch: texts of 100 kB each then still take tens of MB only.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def per_batch(function: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: a function from a batch to columns, applied to each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch), schema=schema)

    return run


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a checkpoint folder only where the session names none; a cluster must name one."""
    checkpoint_folder(spark)


#: Files of a table that is cut, for each core of the cluster.
FILES_PER_CORE = 4


def cut(df: DataFrame) -> DataFrame:
    """As ``written``, in no more files than the cluster's cores can use, however many partitions the frame has."""
    return written(df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))


def written(df: DataFrame) -> DataFrame:
    """Writes the frame as a table in the shared checkpoint folder and goes on from it.

    Unlike a checkpoint, which works its last stage out twice, this does so once, and the
    optimizer knows the table's size. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
