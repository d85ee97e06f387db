"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text's vector holds its byte 3- and 4-grams, hashed, as log term frequencies times
inverse document frequencies, of unit length. Each language has several centroids,
clustered from its sample by spherical k-means. A text gets the language of the centroid
of largest cosine; one farther off than nearly all of that centroid's own sample is
marked ``rejected``, its language still told. The classifier is fitted on a bounded
sample: at most ``SAMPLE_EACH`` labelled documents of a language, less where there are so
many languages that these were over ``SAMPLE_ALL``, but one at least: those that come
first by a hash of id and text. Every language is learned.

Cases: null texts and texts without letters are ``und`` with score 0, as is every text
when nothing is labelled; texts are read whole; equal texts are predicted alike; a
language null or blank is not learned from; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import per_batch, small_batches

BUCKETS = 1 << 14
CENTROIDS = 4
SAMPLE_EACH = 500
SAMPLE_ALL = 8_192
#: Languages whose limits may be broadcast.
MOST_BROADCAST = 100_000
#: Share of a centroid's sample that may lie beyond its limit.
REJECT = 0.005
UND = "und"


_OTHER = re.compile(r"[\W\d_]+")


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased words, all but letters blanked out, or None without a letter."""
    words = _OTHER.sub(" ", text.lower()).strip(" ") if text else ""
    if not any(map(str.isalpha, words)):  # numbers such as ² or ① may be left
        return None
    raw = np.frombuffer(f" {words} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    key = raw[:-1] << 8 | raw[1:]
    for more in (raw[2:], raw[3:]):
        key = key[: len(more)] << 8 | more
        if len(key):
            counts += np.bincount((key * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


class Centroids:
    """Centroids of all languages, with the least cosine that each accepts."""

    def __init__(self, idf: np.ndarray, matrix: np.ndarray, langs: list[str], limits: np.ndarray) -> None:
        self.idf, self.matrix, self.langs, self.limits = idf, matrix, langs, limits

    def vectors(self, counts: list[np.ndarray]) -> np.ndarray:
        return _unit(np.log1p(np.array(counts, dtype=np.float32)) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        counts = [gram_counts(t) for t in texts]
        some = [k for k, c in enumerate(counts) if c is not None]
        langs, scores, rejected = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for at in range(0, len(some) if self.langs else 0, 128):
            ks = some[at : at + 128]
            near = self.vectors([counts[k] for k in ks]) @ self.matrix.T
            best = near.argmax(axis=1)
            for k, j, cos in zip(ks, best.tolist(), near.max(axis=1).tolist()):
                langs[k], scores[k], rejected[k] = self.langs[j], min(1.0, max(0.0, cos)), cos < self.limits[j]
        return langs, scores, rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: each next start is the row least like those before."""
    starts = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    centres = x[starts]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.array([x[owner == j].mean(axis=0) if (owner == j).any() else centres[j] for j in range(len(centres))]))
    return centres, (x @ centres.T).argmax(axis=1)


def fit(docs: DataFrame, allowed: Column, each: int = SAMPLE_EACH, most: int = SAMPLE_ALL) -> Centroids:
    """Learns from the rows that ``allowed`` lets through and whose lang is set."""
    small_batches(docs.sparkSession)
    rows = docs.where(allowed & F.col("lang").isNotNull() & (F.trim("lang") != "")).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    languages = rows.select("lang").distinct().count()
    if not languages:
        return Centroids(np.zeros(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    share = max(1, min(each, most // languages))
    rows = rows.withColumn("turn", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(9)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    limits = rows.select("lang", "turn").withColumn("place", place).where(F.col("place") <= share).groupBy("lang").agg(F.max("turn").alias("last"))
    taken = rows.join(F.broadcast(limits) if languages <= MOST_BROADCAST else limits, "lang").where(F.col("turn") <= F.col("last"))
    # rows of one id and turn count once, however many there are
    taken = taken.groupBy("lang", "turn").agg(F.min("text").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def sparse(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "at": [], "n": []}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = gram_counts(text)
            if counts is not None:
                at = np.flatnonzero(counts)
                out["lang"].append(lang)
                out["at"].append(at)
                out["n"].append(counts[at])
        return out

    got = taken.select("text", "lang").mapInArrow(per_batch(sparse, schema), "lang string, at array<int>, n array<int>").toArrow()
    langs = got.column("lang").to_pylist()
    at, n = got.column("at").combine_chunks(), got.column("n").combine_chunks()
    ends = at.offsets.to_numpy() if len(langs) else np.zeros(1, int)
    where, counts = (np.asarray(x.values) for x in (at, n)) if len(langs) else (np.zeros(0, int), np.zeros(0))
    df = np.bincount(where, minlength=BUCKETS)
    idf = (np.log((1 + len(langs)) / (1 + df)) + 1).astype(np.float32)
    matrix, names, limits = [], [], []
    for lang in sorted(set(langs)):
        own = sorted((k for k, x in enumerate(langs) if x == lang), key=lambda k: (counts[ends[k] : ends[k + 1]].sum(), where[ends[k] : ends[k + 1]].tobytes(), counts[ends[k] : ends[k + 1]].tobytes()))
        x = np.zeros((len(own), BUCKETS), dtype=np.float32)
        for row, k in enumerate(own):
            x[row, where[ends[k] : ends[k + 1]]] = np.log1p(counts[ends[k] : ends[k + 1]])
        x = _unit(x * idf)
        centres, owner = _clusters(x, CENTROIDS)
        near = (x * centres[owner]).sum(axis=1)
        matrix.append(centres)
        names += [lang] * len(centres)
        limits += [float(np.quantile(near[owner == j], REJECT)) if (owner == j).any() else 0.0 for j in range(len(centres))]
    if not names:
        return Centroids(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    return Centroids(idf, np.concatenate(matrix).astype(np.float32), names, np.array(limits))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """Per document: doc_id, lang_pred, score (cosine to the nearest centroid) and rejected."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def predict(batch: pa.RecordBatch) -> dict:
        langs, scores, rejected = shared.value.predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": langs, "score": scores, "rejected": rejected}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(per_batch(predict, schema), "doc_id long, lang_pred string, score double, rejected boolean")
