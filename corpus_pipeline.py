"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's documents. All but the last return the columns
of ``documents``:

1. toxicity: documents that reach the classifier's threshold go; it learns from ``labels``.
2. line_dedup: passages of 40 words or more that an earlier document has are taken out;
   documents of which nothing is left go.
3. near_dedup: of documents linked by a similarity of 0.8 over five-word shingles, the
   one with the least id stays.
4. mixing: documents are sampled to the raked weights of sources, languages and topics.
5. packing: what is left is tokenized and packed into sequences of 4,096 tokens.

Null, empty and very long texts, ties, repeated rows, empty tables and further columns,
also with the names that the stages use, are handled as each stage's operator says:
documents without words pass all stages but the sampling, and end as one end token;
rows equal in id and text share one fate; a first stage without labels rejects nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import common, linededup, mixing, neardup, packing, toxicity
from weft.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt = toxicity.fit(docs, table(spark, sf_dir, "labels"), common.crc_mod("doc_id", 4) != 2)
    return toxicity.clean(docs, learnt)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs, drop_emptied=True, count=None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def sample_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("near_dedup", drop_near_copies),
    ("mixing", sample_to_weights),
    ("packing", pack_sequences),
]

#: Classifier, rolling hashes, signatures and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what they hand on is kept in the session's checkpoint folder."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
