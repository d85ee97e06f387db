"""Conversations: token budgets, last turns, prompts, and shaping turns and tokens for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 4096


def rough_tokens(text: Column) -> Column:
    """A stand-in for a tokenizer: four characters a token, one at least."""
    return F.greatest(F.ceil(F.length(text) / 4), F.lit(1)).cast("long")


def within_budget(turns: DataFrame, tokens: Column, system_tokens: int, reserved: int = 0, budget: int = BUDGET) -> DataFrame:
    """The longest run of last turns that fits with the system prompt and what is reserved."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    held = turns.withColumn("tokens", tokens).withColumn("so_far", F.sum("tokens").over(order))
    return held.where(F.col("so_far") + system_tokens + reserved <= budget)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def trimmed(turns: DataFrame, group: str, order: str, most: int = 50, keep: int = 30) -> DataFrame:
    """Histories of more than ``most`` turns are cut to their last ``keep``; the others stay."""
    held = turns.withColumn("_n", F.count("*").over(Window.partitionBy(group))).withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order))))
    return held.where((F.col("_n") <= most) | (F.col("_at") <= keep)).drop("_n", "_at")


def prompts(turns: DataFrame, system: str) -> DataFrame:
    """One row for each conversation: its messages in order behind the system prompt."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return turns.groupBy("conv_id").agg(F.concat(first, body).alias("messages"))


def next_token_pairs(rows: DataFrame, ids: str) -> DataFrame:
    """Inputs and targets of sequences longer than one: all but the last, and all but the first."""
    n = F.size(ids)
    long = rows.where(n > 1)
    return long.withColumn("inputs", F.slice(ids, F.lit(1), n - 1)).withColumn("targets", F.slice(ids, F.lit(2), n - 1))


def micro_batches(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Numbers every n rows of a group as one step and leaves out a last step that isn't full."""
    held = rows.withColumn("step", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / n))
    return held.withColumn("_n", F.count("*").over(Window.partitionBy(group, "step"))).where(F.col("_n") == n).drop("_n")


def save_memory(store: DataFrame, more: DataFrame) -> DataFrame:
    """Adds texts, their personal data redacted."""
    from weft.functions.text import redact

    return store.unionByName(more.withColumn("text", redact(F.col("text"))), allowMissingColumns=True)


def forget(turns: DataFrame) -> DataFrame:
    """An empty history of the same columns."""
    return turns.where(F.lit(False))
