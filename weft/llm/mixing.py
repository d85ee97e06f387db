"""Mixing to target weights by iterative proportional fitting, by DataFrame operations only.

Documents are summed into cells of source, language and topic. The cells' token weights
are raked: in turn, each margin's weights are scaled to its targets, in rounds of
``SWEEPS`` over all three until no margin is off by more than ``TOLERANCE``. A document's
calibration is its cell's raked weight over its cell's tokens; its probability is the
calibration over the largest one, so that none is over 1 and the tokens that are expected
in the sample have the raked shares: the cell that the corpus has least of is kept whole
and the others are thinned to match. A document is sampled by a hash of its id. Only cells
are ever grouped or joined to, never documents of one key; the cells are broadcast if
they are counted to be few, else they are joined by their key.

Targets default to the margin's own token shares, tempered: a share to the power of
``TEMPER``, scaled to 1. A topic is the first rule of ``TOPICS`` that a text meets. Tokens
are counted as parts between blanks.

Cases: null and empty texts have no tokens, topic ``empty`` and calibration and probability 1 when
their cell has no tokens; null sources and languages are a value of their own; rows of the same
id are sampled alike; margins whose targets can't all be met end after ``MOST_ROUNDS``
rounds; a target of 0 takes its documents out; an empty table gives no rows; columns of other names, also ``weight`` or ``topic``, stay as
they are in ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut

SWEEPS = 6
TOLERANCE = 1e-4
MOST_ROUNDS = 20
TEMPER = {"source": 0.9, "lang": 0.9, "topic": 1.0}
#: Cells that may be broadcast, some 60 bytes each.
MOST_BROADCAST = 100_000

# Topics by a pattern each, in this order; texts that meet none are "prose".
TOPICS = (
    ("notice", "reserved|[Ll]icen[cs]e|[Cc]opyright"),
    ("records", "[0-9]{4}"),
    ("table", " [|] "),
    ("shout", "!!"),
)


def topic(text: Column) -> Column:
    out = F.when(F.length(text) == 0, "empty")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, " "))).cast("long")


def keyed() -> list[Column]:
    """What a document is mixed by: its cell and its tokens. Null keys are a value of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("~null")).alias(f"_{c}") for c in ("source", "lang")]
    return [*keys, topic(text).alias("_topic"), tokens(text).alias("_tokens")]


KEYS = ["_source", "_lang", "_topic"]


def cells_of(docs: DataFrame) -> DataFrame:
    return docs.select(*keyed()).groupBy(*KEYS).agg(F.sum("_tokens").cast("double").alias("t"), F.count("*").alias("n"))


def raked(cells: DataFrame, temper: dict[str, float] | None = None, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells with their raked weight ``w``, which sums to all tokens.

    targets: for some of source, lang and topic, frames of (value, share); the others are tempered.
    """
    temper = TEMPER | (temper or {})
    out = cut(cells.where(F.col("t") > 0)).withColumn("w", F.col("t"))
    whole = out.agg(F.sum("t")).first()[0] or 0.0
    for name in temper:
        key = f"_{name}"
        own = out.groupBy(key).agg(F.sum("t").alias("m"))
        if targets and name in targets:
            given = targets[name].select(F.col("value").cast("string").alias(key), F.col("share").cast("double").alias("s"))
            own = own.join(given, key, "left").select(key, F.coalesce("s", F.lit(0.0)).alias("s"))
        else:
            own = own.select(key, F.pow(F.col("m"), temper[name]).alias("s"))
        shares = own.agg(F.sum("s")).first()[0] or 1.0
        out = out.join(own.select(key, (F.col("s") / shares * whole).alias(f"goal_{name}")), key)
    off = [F.when(F.col(f"goal_{name}") > 0, F.abs(F.sum("w").over(_by(f"_{name}")) / F.col(f"goal_{name}") - 1)).otherwise(0.0) for name in temper]
    for _ in range(MOST_ROUNDS):
        for name in [*temper] * sweeps:
            now = F.sum("w").over(_by(f"_{name}"))
            out = out.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"goal_{name}") / now).otherwise(0.0))
        out = cut(out)
        if (out.select(F.greatest(*off).alias("off")).agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return out.select(*KEYS, "t", "n", "w")


def _by(key: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key)


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) by the md5 of the id: 52 bits of it."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("~null")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def calibrated(docs: DataFrame, **how: object) -> DataFrame:
    """The documents with _source, _lang, _topic, _tokens, calibration, probability and sampled."""
    cells = cut(raked(cells_of(docs), **how).select(*KEYS, (F.col("w") / F.col("t")).alias("calibration")))
    largest = cells.agg(F.max("calibration")).first()[0] or 1.0
    if cells.count() <= MOST_BROADCAST:
        cells = F.broadcast(cells)
    rows = docs.select("*", *keyed()).join(cells, KEYS, "left")
    rows = rows.withColumn("probability", F.coalesce(F.col("calibration") / largest, F.lit(1.0)))
    rows = rows.withColumn("calibration", F.coalesce("calibration", F.lit(1.0)))
    return rows.withColumn("sampled", chance(F.col("doc_id")) < F.col("probability"))


def report(docs: DataFrame, **how: object) -> DataFrame:
    """Per document: its cell, tokens, calibration, probability and whether it is sampled."""
    only = docs.select("doc_id", "text", "source", "lang")
    rows = calibrated(only, **how)
    names = [F.col(f"_{c}").alias(c) for c in ("source", "lang", "topic", "tokens")]
    return rows.select("doc_id", *names, F.round("calibration", 6).alias("calibration"), F.round("probability", 6).alias("probability"), "sampled")


def sample(docs: DataFrame, **how: object) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    held = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang"), F.struct("*").alias("_doc"))
    return calibrated(held, **how).where("sampled").select("_doc.*")


def oracle(docs: str = "documents", temper: dict[str, float] | None = None, sweeps: int = SWEEPS) -> str:
    """The report in DuckDB SQL over a table of documents, each sweep spelt out."""
    temper = TEMPER | (temper or {})
    rules = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{name}'" for name, p in TOPICS)
    ctes = [
        f"d AS (SELECT doc_id, coalesce(source, '~null') AS source, coalesce(lang, '~null') AS lang, coalesce(text, '') AS x FROM {docs})",
        f"k AS (SELECT doc_id, source, lang, CASE WHEN x = '' THEN 'empty' {rules} ELSE 'prose' END AS topic, CAST(CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END AS BIGINT) AS tokens FROM d)",
        "c0 AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t FROM k GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for name, power in temper.items():
        ctes.append(f"g_{name} AS (SELECT {name}, pow(m, {power}) / sum(pow(m, {power})) OVER () * (SELECT sum(t) FROM c0) AS goal_{name} FROM (SELECT {name}, sum(t) AS m FROM c0 GROUP BY {name}))")
    ctes.append("w0 AS (SELECT source, lang, topic, t, t AS w, " + ", ".join(f"goal_{n}" for n in temper) + " FROM c0 " + " ".join(f"JOIN g_{n} USING ({n})" for n in temper) + ")")
    at = 0
    for _ in range(sweeps):
        for name in temper:
            ctes.append(f"w{at + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {name}) > 0 THEN w * goal_{name} / sum(w) OVER (PARTITION BY {name}) ELSE 0.0 END AS w) FROM w{at})")
            at += 1
    ctes.append(f"r AS (SELECT k.*, coalesce(w / t, 1.0) AS f, coalesce(w / t / (SELECT max(w / t) FROM w{at}), 1.0) AS p FROM k LEFT JOIN w{at} USING (source, lang, topic))")
    return f"""WITH {", ".join(ctes)}
    SELECT doc_id, source, lang, topic, tokens, round(f, 6) AS calibration, round(p, 6) AS probability,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~null')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled FROM r"""


ORACLE = oracle()
