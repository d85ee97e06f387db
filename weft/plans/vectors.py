"""Queries of vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.functions import vectors as V
from weft.operators import vectorstore
from weft.plans.registry import query
from weft.session import table

_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_NORM = f"sqrt(list_sum(list_transform({_D}, lambda x: x * x)))"


@query("vector_norms", f"SELECT vec_id, round({_NORM}, 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("vector_normalized_sum", f"SELECT vec_id, round(list_sum(list_transform({_D}, lambda x: x / (n + 1e-9))), 6) AS s FROM (SELECT *, {_NORM} AS n FROM embeddings)")
def vector_normalized_sum(spark, sf_dir):
    unit = V.normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


_TOPK = f"""WITH v AS (SELECT vec_id, list_transform({_D}, lambda x: x / (n + 1e-9)) AS u FROM (SELECT *, {_NORM} AS n FROM embeddings)),
    q AS (SELECT vec_id AS query_id, u AS q FROM v WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, list_dot_product(q, u) AS score FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query("vector_topk", _TOPK)
def vector_topk(spark, sf_dir):
    """The five nearest, over all vectors, of every vector whose id is divisible by 20."""
    store = table(spark, sf_dir, "embeddings")
    asked = store.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectorstore.search(store, asked).withColumn("score", F.round("score", 6))


@query("vector_union_add", "SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids FROM (SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings) GROUP BY label")
def vector_union_add(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings")
    both = vectorstore.add(store, store.withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))


@query("vector_metadata_zip", "SELECT CAST(position AS BIGINT) AS position, vec_id, doc_id, lang FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) JOIN (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) USING (position)")
def vector_metadata_zip(spark, sf_dir):
    """Vectors and metadata that belong together by their place in two tables."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id")
    return vectorstore.zipped(vectors, "vec_id", table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("position", "vec_id", "doc_id", "lang")


@query("cross_entropy", "SELECT vec_id, round(log(list_sum(list_transform(e, lambda x: exp(x - m)))) - (e[t + 1] - m), 6) AS loss FROM (SELECT vec_id, label AS t, e, list_max(e) AS m FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))".replace("log(list_sum", "ln(list_sum"))
def cross_entropy(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.cross_entropy(logits, F.col("label")), 6).alias("loss"))


@query("perplexity", "SELECT label, round(exp(avg(loss)), 4) AS perplexity, count(*) AS n FROM (SELECT label, ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - (e[label + 1] - m) AS loss FROM (SELECT label, e, list_max(e) AS m FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))) GROUP BY label")
def perplexity(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    losses = table(spark, sf_dir, "embeddings").select("label", V.cross_entropy(logits, F.col("label")).alias("loss"))
    return losses.groupBy("label").agg(F.round(F.exp(F.avg("loss")), 4).alias("perplexity"), F.count("*").alias("n"))


@query("perplexity_of_first_steps", "SELECT label, round(exp(avg(loss)), 4) AS perplexity, count(*) AS n FROM (SELECT label, ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - (e[label + 1] - m) AS loss, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step FROM (SELECT vec_id, label, e, list_max(e) AS m FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))) WHERE step <= 20 GROUP BY label")
def perplexity_of_first_steps(spark, sf_dir):
    """An evaluation that ends after 20 steps of each label: the limit is the feature."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    step = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    losses = table(spark, sf_dir, "embeddings").withColumn("step", step).where("step <= 20").select("label", V.cross_entropy(logits, F.col("label")).alias("loss"))
    return losses.groupBy("label").agg(F.round(F.exp(F.avg("loss")), 4).alias("perplexity"), F.count("*").alias("n"))
