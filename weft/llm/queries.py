"""The queries of this subpackage by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import mixing, secrets
from weft.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weft.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.gif import features, store

    return features(store(table(spark, sf_dir, "documents")))


QUERIES["op4_gif_frames"] = op4_gif_frames
QUERIES["op3_best_fit_packing"] = op3_best_fit_packing


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.pii import personal_data, span_text

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", span_text())


QUERIES["op7_crf_pii"] = op7_crf_pii


def op9_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import crc_mod
    from weft.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    found = identify(docs, fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES["op9_language_centroids"] = op9_language_centroids


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import crc_mod
    from weft.llm.toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES["op1_counterfactual_toxicity"] = op1_counterfactual_toxicity


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.secrets import digests, secrets

    return digests(secrets(table(spark, sf_dir, "documents")))


QUERIES["op10_entropy_secrets"] = op10_entropy_secrets
ORACLES["op10_entropy_secrets"] = secrets.ORACLE


def op5_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


QUERIES["op5_raked_mixing"] = op5_raked_mixing
ORACLES["op5_raked_mixing"] = mixing.ORACLE


def op6_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op6_line_chunk_dedup"] = op6_line_chunk_dedup


def op2_lsh_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


QUERIES["op2_lsh_forest_dedup"] = op2_lsh_forest_dedup


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from weft.llm.multiindex import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op8_inverted_multi_index"] = op8_inverted_multi_index
