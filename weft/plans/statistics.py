"""Queries of corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import ngrams as N
from weft.plans.registry import query
from weft.session import table

WORDS_SQL = r"string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')"
_UNI = f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS word FROM documents) WHERE word <> '' GROUP BY word"
_BI = f"""SELECT w[i] AS "left", w[i + 1] AS "right", count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {WORDS_SQL} AS w FROM documents)) GROUP BY ALL"""


@query("unigram_counts", _UNI)
def unigram_counts(spark, sf_dir):
    return N.unigrams(table(spark, sf_dir, "documents"))


@query("bigram_counts", _BI)
def bigram_counts(spark, sf_dir):
    return N.bigrams(table(spark, sf_dir, "documents"))


@query(
    "pmi_compounds",
    f"""WITH u AS ({_UNI}), b AS ({_BI}), t AS (SELECT sum(n) AS total FROM b)
    SELECT b."left", b."right", b.n, round(log2(CAST(b.n AS DOUBLE) * total / (CAST(x.n AS DOUBLE) * y.n)), 6) AS pmi
    FROM b JOIN u x ON x.word = b."left" JOIN u y ON y.word = b."right", t
    WHERE b.n >= 5 AND log2(CAST(b.n AS DOUBLE) * total / (CAST(x.n AS DOUBLE) * y.n)) > 4.0""",
)
def pmi_compounds(spark, sf_dir):
    return N.compounds(table(spark, sf_dir, "documents"), 5, 4.0).withColumn("pmi", F.round("pmi", 6))


@query("char_vocab", f"SELECT ch, CAST(4 + row_number() OVER (ORDER BY encode(ch)) AS INTEGER) AS id FROM (SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM ({_UNI})) WHERE ch <> ''")
def char_vocab(spark, sf_dir):
    from pyspark.sql import Window

    return N.characters(table(spark, sf_dir, "documents")).select("ch", (F.row_number().over(Window.orderBy("ch")) + 4).alias("id"))


_SYM = f"""SELECT s[i] AS "left", s[i + 1] AS "right", CAST(sum(n) AS BIGINT) AS n FROM (SELECT s, n, unnest(range(1, len(s))) AS i FROM (SELECT n, list_concat(string_split(word, ''), ['</w>']) AS s FROM ({_UNI}))) GROUP BY ALL"""


@query("bpe_pair_counts", _SYM)
def bpe_pair_counts(spark, sf_dir):
    return N.symbol_pairs(table(spark, sf_dir, "documents"))


@query("bpe_first_merge", f"""SELECT * FROM ({_SYM}) ORDER BY n DESC, encode("left"), encode("right") LIMIT 1""")
def bpe_first_merge(spark, sf_dir):
    return N.symbol_pairs(table(spark, sf_dir, "documents")).orderBy(F.desc("n"), "left", "right").limit(1)


_SHINGLES_SQL = f"""SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN length(text) >= 5 THEN list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, CAST(i AS INTEGER), 5))) ELSE [] END AS s
    FROM (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents)"""


@query("shingle_counts", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_shingles FROM ({_SHINGLES_SQL})")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(N.shingles(F.col("text"))).alias("n_shingles"))


@query("word_length_histogram", f"SELECT length(word) AS len, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens FROM ({_UNI}) GROUP BY ALL")
def word_length_histogram(spark, sf_dir):
    return N.unigrams(table(spark, sf_dir, "documents")).groupBy(F.length("word").cast("long").alias("len")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"))


@query("token_throughput", f"SELECT source, CAST(sum(len({WORDS_SQL})) AS BIGINT) AS tokens, count(*) AS docs FROM documents GROUP BY source")
def token_throughput(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(F.size(N.words(F.col("text")))).alias("tokens"), F.count("*").alias("docs"))


@query("shard_counts", "SELECT CAST(floor((rn - 1) / 300) AS INTEGER) AS shard, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 100) GROUP BY ALL")
def shard_counts(spark, sf_dir):
    from weft.sources.shards import numbered

    docs = numbered(table(spark, sf_dir, "documents").where(F.length("text") >= 100), "doc_id", 300)
    return docs.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
