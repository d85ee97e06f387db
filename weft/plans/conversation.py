"""Queries of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import conversation as V
from weft.operators import ngrams as N
from weft.plans.registry import query
from weft.plans.statistics import WORDS_SQL
from weft.session import table

_TOK = "CAST(greatest(ceil(length(text) / 4), 1) AS BIGINT)"


@query("token_budget_history", f"SELECT conv_id, turn, tokens, so_far::BIGINT AS so_far FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS so_far FROM (SELECT conv_id, turn, {_TOK} AS tokens FROM conversations)) WHERE so_far + 40 + 20 <= 200")
def token_budget_history(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return V.within_budget(turns, V.rough_tokens(F.col("text")), 40, 20, 200).select("conv_id", "turn", "tokens", "so_far")


@query("last_n_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def last_n_turns(spark, sf_dir):
    return V.last_turns(table(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", "role")


@query("prompt_messages", "SELECT conv_id, 'system:Be brief.' || chr(10) || array_to_string(list(role || ':' || text ORDER BY turn), chr(10)) AS prompt FROM conversations GROUP BY conv_id")
def prompt_messages(spark, sf_dir):
    made = V.prompts(table(spark, sf_dir, "conversations"), "Be brief.")
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").alias("prompt"))


@query("history_trimmed", "SELECT user_id, event_id FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE n <= 50 OR place <= 30")
def history_trimmed(spark, sf_dir):
    return V.trimmed(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query(
    "prompt_within_budget",
    f"""SELECT conv_id, 'system:Be brief.' || chr(10) || array_to_string(list(role || ':' || text ORDER BY turn), chr(10)) AS prompt FROM
    (SELECT *, sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS so_far FROM conversations) WHERE so_far + 60 <= 200 GROUP BY conv_id""",
)
def prompt_within_budget(spark, sf_dir):
    """Messages of the turns that fit, behind the system prompt."""
    held = V.within_budget(table(spark, sf_dir, "conversations"), V.rough_tokens(F.col("text")), 40, 20, 200)
    made = V.prompts(held, "Be brief.")
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").alias("prompt"))


@query("next_token_pairs", f"SELECT conv_id, turn, array_to_string(w[1:len(w) - 1], ' ') AS inputs, array_to_string(w[2:len(w)], ' ') AS targets FROM (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations) WHERE len(w) > 1")
def next_token_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", N.words(F.col("text")).alias("ids"))
    return V.next_token_pairs(rows, "ids").select("conv_id", "turn", F.array_join("inputs", " ").alias("inputs"), F.array_join("targets", " ").alias("targets"))


@query("micro_batch_steps", "SELECT conv_id, CAST(step AS BIGINT) AS step, min(turn) AS first_turn, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, step) AS c FROM (SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS step FROM conversations)) WHERE c = 2 GROUP BY ALL")
def micro_batch_steps(spark, sf_dir):
    return V.micro_batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).groupBy("conv_id", "step").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("role_turns", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS convs, max(length(text)) AS longest FROM conversations GROUP BY role")
def role_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("convs"), F.max(F.length("text").cast("long")).alias("longest"))
