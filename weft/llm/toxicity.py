"""Toxicity by a linear classifier with counterfactual regularisation.

A document's score is the logistic function of a bias and the sum, over its distinct
words, of the weights of the word and of its first four and five letters. In training,
each labelled text that names a group is scored again with the name swapped for each
other name of its kind and language; the squared change of the score is penalised, so
that a neutral mention of a group alone moves no score. Names that no labelled text has
are learned with those of their kind, by the swaps. The classifier is fitted on a bounded sample:
the ``SAMPLE_ROWS`` labelled documents that come first by a hash of their id, and the
``FEATURES`` features that differ most between the labels.

Cases: null and empty texts have no words and score as the bias says; texts are read
whole; equal texts score alike; of an id labelled more than once the larger label
counts, null labels none, and of its documents the first text; without labelled rows every score is 0; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, per_batch, small_batches

SAMPLE_ROWS = 10_000
FEATURES = 4_096
#: Least z-value of a feature's log-odds ratio between the labels.
LEAST_Z = 3.5
THRESHOLD = 0.3

# Names of groups by kind and language: swapped for each other in training.
IDENTITY = {
    "gender": "woman man women men girl boy girls boys female male lady gentleman",
    "faith": "muslim christian jewish hindu buddhist atheist muslims christians jews hindus buddhists atheists catholic protestant",
    "origin": "african asian european american mexican arab indian chinese turkish polish russian african-american immigrant immigrants refugee refugees foreigner foreigners",
    "orientation": "gay lesbian straight bisexual transgender queer heterosexual homosexual",
    "age": "old young elderly teenage",
    "ability": "disabled deaf blind autistic",
    "gender, de": "frau mann frauen männer mädchen junge jungen weiblich männlich",
    "faith, de": "muslim muslime christ christen jude juden hindu hindus buddhist buddhisten atheist atheisten muslimisch christlich jüdisch",
    "origin, de": "afrikaner asiate europäer amerikaner araber inder chinese türke türken pole polen russe russen ausländer einwanderer flüchtling flüchtlinge",
    "orientation, de": "schwul lesbisch bisexuell transgender heterosexuell homosexuell schwule lesben",
    "gender, fr": "femme homme femmes hommes fille garçon filles garçons",
    "faith, fr": "musulman musulmane musulmans chrétien chrétienne chrétiens juif juive juifs hindou bouddhiste athée athées",
    "origin, fr": "africain africains asiatique asiatiques européen européens américain arabe arabes indien chinois turc turcs immigré immigrés réfugié réfugiés étranger étrangers",
    "orientation, fr": "homosexuel homosexuelle hétérosexuel hétérosexuelle lesbienne bisexuel transgenre",
    "gender, es": "mujer hombre mujeres hombres niña niño niñas niños",
    "faith, es": "musulmán musulmana musulmanes cristiano cristiana cristianos judío judía judíos hindú budista ateo ateos",
    "origin, es": "africano africanos asiático asiáticos europeo europeos americano árabe árabes indio chino chinos turco inmigrante inmigrantes refugiado refugiados extranjero extranjeros",
    "orientation, es": "homosexual heterosexual lesbiana bisexual transgénero",
}
_KINDS_OF: dict[str, list[str]] = {}
for _kind, _names in IDENTITY.items():
    for _name in _names.split():
        _KINDS_OF.setdefault(_name, []).append(_kind)


def others(name: str) -> list[str]:
    """What a name is swapped for: all other names of its kinds."""
    return [x for kind in _KINDS_OF.get(name, ()) for x in IDENTITY[kind].split() if x != name]


_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features_of(word: str) -> tuple[str, ...]:
    """The word and, marked, its first letters. Names of groups stand for themselves only, so that a swap changes nothing else."""
    if word in _KINDS_OF or len(word) < 4:
        return (word,)
    return (word, f"4:{word[:4]}") if len(word) < 5 else (word, f"4:{word[:4]}", f"5:{word[:5]}")


class Weights(dict):
    """A word's weight: the sum of those of its features, kept for the words met first."""

    def __init__(self, of: dict[str, float], most: int = 300_000) -> None:
        self.of, self.most = of, most

    def __missing__(self, word: str) -> float:
        get = self.of.get
        weight = sum(get(f, 0.0) for f in features_of(word))
        if len(self) < self.most:
            self[word] = weight
        return weight


class Model:
    def __init__(self, bias: float | None, weights: dict[str, float]) -> None:
        self.bias, self.weights, self.by_word = bias, weights, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"by_word": None}

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        if self.by_word is None:
            self.by_word = Weights(self.weights)
        total = self.bias + math.fsum(map(self.by_word.__getitem__, words_of(text)))
        return 1 / (1 + math.exp(-total)) if total > -700 else 0.0


def train(rows: list[list[int]], labels: list[int], swaps: list[tuple[int, int, int]], size: int, balance: float = 30.0, decay: float = 0.02, rounds: int = 400, rate: float = 0.3) -> tuple[float, np.ndarray]:
    """Weights that minimise the mean logistic loss, a quadratic penalty, and ``balance`` times the mean squared change of the score over swaps.

    rows: each text's features, a feature as often as its words have it. swaps: a row, a
    feature of it and the one put in its place.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([f for r in rows for f in r], dtype=np.int64)
    y = np.array(labels, dtype=float)
    text, gone, come = np.array(swaps, dtype=np.int64).reshape(-1, 3).T
    w, bias = np.zeros(size), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    past, past_bias = np.full(size, 1e-8), 1e-8

    def logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    for _ in range(rounds):
        z = bias + np.bincount(owner, w[which], minlength=len(rows))
        p = logistic(z)
        slope = (p - y) / len(y)
        swapped = np.zeros(0)
        if len(text):
            # the swapped text's score, and how the squared change depends on the two logits
            q = logistic(z[text] + w[come] - w[gone])
            change = balance * 2 * (q - p[text]) / len(text)
            swapped = change * q * (1 - q)
            slope = slope + np.bincount(text, swapped - change * (p * (1 - p))[text], minlength=len(rows))
        g = np.bincount(which, slope[owner], minlength=size) + decay * w / len(y)
        g += np.bincount(come, swapped, minlength=size) - np.bincount(gone, swapped, minlength=size)
        past += g * g
        past_bias += slope.sum() ** 2
        w -= rate * g / np.sqrt(past)
        bias -= rate * slope.sum() / math.sqrt(past_bias)
    return bias, w


def _counted(labelled: DataFrame) -> DataFrame:
    """How many texts of each label have each feature; summed in each task first."""
    schema = pa.schema([("feature", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[label].update({f for w in words_of(text) for f in features_of(w)})
        names = sorted(by[0].keys() | by[1].keys())
        for at in range(0, len(names), 20_000):
            some = names[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"feature": some, "bad": [by[1][f] for f in some], "good": [by[0][f] for f in some]}, schema=schema)

    return labelled.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE_ROWS, balance: float = 30.0) -> Model:
    """Learns from the labelled documents that ``allowed`` (a test of doc_id) lets through."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    taken = marked.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample).collect()
    if not taken:
        return Model(None, {})
    some = docs.sparkSession.createDataFrame([tuple(r) for r in taken], "doc_id long, label int")
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), "doc_id")
    labelled = cut(labelled.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"))
    total = {0: 0, 1: 0}
    for row in taken:
        total[row["label"]] += 1
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(bad / (total[1] - F.col("bad") + 0.5)) - F.log(good / (total[0] - F.col("good") + 0.5))
    spread = F.sqrt(1 / bad + 1 / good)
    z = F.abs(odds) / spread
    enough = (F.col("bad") + F.col("good") >= 3) & (F.col("bad") <= total[1]) & (F.col("good") <= total[0])
    chosen = _counted(labelled).where(enough & ((z >= LEAST_Z) | F.col("feature").isin(*_KINDS_OF))).orderBy(F.desc(z), "feature").limit(FEATURES).select("feature").collect()
    names = [r["feature"] for r in chosen]
    names += sorted({x for n in names for x in others(n)} - set(names))
    number = {n: k for k, n in enumerate(names)}
    schema = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.int32()))])

    def read(batch: pa.RecordBatch) -> dict:
        found = [sorted(number[f] for w in words_of(t) for f in features_of(w) if f in number) for t in batch.column(0).to_pylist()]
        return {"label": batch.column(1), "features": found}

    got = labelled.mapInArrow(per_batch(read, schema), "label int, features array<int>").collect()
    got = sorted((list(r["features"]), r["label"]) for r in got)
    if not got:
        return Model(None, {})
    swaps = [(row, f, number[other]) for row, (feats, _) in enumerate(got) for f in sorted(set(feats)) for other in others(names[f])]
    bias, w = train([f for f, _ in got], [y for _, y in got], swaps, len(names), balance)
    return Model(bias, {n: float(v) for n, v in zip(names, w) if v})


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score and predicted of each document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def read(batch: pa.RecordBatch) -> dict:
        score = shared.value.score
        got = [score(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "score": got, "predicted": [int(s >= THRESHOLD) for s in got]}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(per_batch(read, schema), "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns as they are, that don't reach the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def passes(texts):  # noqa: ANN001, ANN202
        score = shared.value.score
        return texts.map(lambda t: score(t) < THRESHOLD)

    return docs.where(passes(F.col("text").cast("string")))
