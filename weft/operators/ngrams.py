"""Word and word-pair statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import collapse_spaces


def words(text: Column) -> Column:
    """The words of a text between blanks; none for an empty one."""
    flat = collapse_spaces(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def pairs(ws: Column) -> Column:
    """Adjacent pairs of an array, as structs of left and right."""
    left, right = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def unigrams(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bigrams(docs: DataFrame) -> DataFrame:
    found = docs.select(F.explode(pairs(words(F.col("text")))).alias("p"))
    return found.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.count("*").alias("n"))


def compounds(docs: DataFrame, min_count: int = 10, threshold: float = 0.0) -> DataFrame:
    """Pairs that occur often enough, with their pointwise mutual information above a threshold.

    All three probabilities are over the number of pairs, as the gluer defines them.
    """
    ones, twos = unigrams(docs), bigrams(docs)
    # the number of pairs follows from the lengths, without counting pairs a second time
    total = docs.agg(F.sum(F.greatest(F.size(words(F.col("text"))) - 1, F.lit(0)))).first()[0] or 0
    often = twos.where(F.col("n") >= min_count)
    a, b = (ones.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in ("left", "right"))
    pmi = F.log2(F.col("n").cast("double") * total / (F.col("n_left").cast("double") * F.col("n_right")))
    return often.join(a, "left").join(b, "right").select("left", "right", "n", pmi.alias("pmi")).where(F.col("pmi") > threshold)


def symbol_pairs(docs: DataFrame) -> DataFrame:
    """Adjacent symbols inside words, each word ending in ``</w>``, counted with the words' numbers."""
    symbols = F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit("</w>")))
    found = unigrams(docs).select("n", F.explode(pairs(symbols)).alias("p"))
    return found.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))


def characters(docs: DataFrame) -> DataFrame:
    """Distinct characters of all words."""
    return unigrams(docs).select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("ch")).distinct()


def let(value: Column, body) -> Column:  # noqa: ANN001
    """The body with the value bound, so that it is worked out once and not at every use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(parts: Column, n: int, sep: str) -> Column:
    """The n-grams of a bound array, in order."""
    at = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(parts, i, n), sep))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct word n-grams; of shorter texts distinct character n-grams; none if those are missing too."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    of_chars = let(chars, lambda cs: grams(cs, n, ""))
    return F.array_distinct(let(words(text), lambda ws: F.when(F.size(ws) >= n, grams(ws, n, " ")).otherwise(of_chars)))
