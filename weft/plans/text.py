"""Queries of filters, routing and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.plans.registry import query
from weft.session import table

_VN = T.VIETNAMESE_LETTERS


@query("doc_length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 100")
def doc_length_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") >= 100).select("doc_id", "n_chars")


@query("doc_normalize_ws", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS clean FROM documents")
def doc_normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_spaces(F.col("text")).alias("clean"))


@query("lang_route_counts", f"SELECT lang, regexp_matches(lower(text), '[{_VN}]') AS vn_like, count(*) AS n_docs FROM documents GROUP BY ALL")
def lang_route_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", T.is_vietnamese(F.col("text")).alias("vn_like")).agg(F.count("*").alias("n_docs"))


@query("mojibake_signal", "SELECT doc_id, regexp_matches(text, '[ÃÂá]') AS suspicious FROM documents")
def mojibake_signal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_misdecoded(F.col("text")).alias("suspicious"))


def _sql_entities(x: str) -> str:
    for name, sign in T.ENTITIES.items():
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x.replace("'&#39;'", "'&#39;'")


@query(
    "html_strip",
    "SELECT page_id, trim("
    + _sql_entities(r"regexp_replace(regexp_replace(html, '(?s)<script.*?>.*?</script>|<style.*?>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')")
    + r", E' \n\t\r' || chr(160)) AS body FROM pages",
)
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query(
    "html_clean_words",
    r"SELECT page_id, len(string_split(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?>.*?</script>|<style.*?>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS n_words FROM pages",
)
def html_clean_words(spark, sf_dir):
    bare = T.collapse_spaces(T.strip_html(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.split(bare, " ")).cast("long").alias("n_words"))


def _sql_redact() -> str:
    x = "text"
    for pattern, mark in T.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return x


@query("pii_redact", f"SELECT doc_id, {_sql_redact()} AS redacted FROM documents")
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query(
    "pii_redact_counts",
    f"WITH r AS (SELECT {_sql_redact()} AS x FROM documents) SELECT " + ", ".join(f"sum(CAST((length(x) - length(replace(x, '{m}', ''))) / {len(m)} AS BIGINT))::BIGINT AS n_{m[10:-1].lower()}" for _, m in T.REDACTIONS) + " FROM r",
)
def pii_redact_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(T.redact(F.col("text")).alias("x"))
    gone = [F.sum(((F.length("x") - F.length(F.replace("x", F.lit(m)))) / len(m)).cast("long")).alias(f"n_{m[10:-1].lower()}") for _, m in T.REDACTIONS]
    return rows.agg(*gone)


@query("content_md5", "SELECT doc_id, md5(text) AS content_id FROM documents")
def content_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_id"))


@query("case_fold", "SELECT doc_id, lower(text) AS folded FROM documents")
def case_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("folded"))


@query("strip_punctuation", r"SELECT item_id, trim(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', '', 'g')) AS bare FROM benchmark")
def strip_punctuation(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.strip_signs(F.col("text")).alias("bare"))


@query("function_names", "SELECT p_partkey, regexp_replace(lower(p_type), '[ /]', '_', 'g') AS fn FROM part")
def function_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.function_name(F.col("p_type")).alias("fn"))


PHRASES = [
    "play despacito on youtube", "Play  Bohemian Rhapsody  on YouTube", "find Anna on facebook", "send message to Bob Lee on Facebook",
    "search cats on google", "look up weather on google", "look for shoes on amazon", "listen to jazz on spotify", "watch Dune on netflix",
    "search on google", "play on youtube", "open chrome", "what is ai?", "tell me about rust", "teach you how to search on zing mp3",
    "call chau ngan now", "SHOW NGAN and chow ngan", "make a phone call to Minh", "restart the computer", "how to play on spotify please",
    "shutdown", "mở nhạc", "list commands", "is it late?", "turn it off", "please open the door",
]


def phrases(spark):
    return spark.createDataFrame([(k, p) for k, p in enumerate(PHRASES)], "id long, q string")


def phrases_sql() -> str:
    return "(VALUES " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(PHRASES)) + ") v(id, q)"


def _sql_capture(pattern: str, x: str = "q") -> str:
    return f"CASE WHEN regexp_matches({x}, '(?i){pattern}') THEN regexp_extract({x}, '(?i){pattern}', 1) END"


@query(
    "captured_terms",
    rf"SELECT CAST(id AS BIGINT) AS id, {_sql_capture(r'play\s+(.*?)\s+on\s+youtube')} AS yt, {_sql_capture(r'find\s+(.*?)\s+on\s+facebook')} AS fb_find, {_sql_capture(r'send\s+message\s+to\s+(.*?)\s+on\s+facebook')} AS fb_message FROM {phrases_sql()}",
)
def captured_terms(spark, sf_dir):
    q = F.col("q")
    return phrases(spark).select("id", T.youtube_term(q).alias("yt"), T.facebook_name(q, "find").alias("fb_find"), T.facebook_name(q, "message").alias("fb_message"))


def _sql_learned(verbs, platform):
    return "coalesce(" + ", ".join(f"nullif({_sql_capture(v + '(.*?)' + chr(92) + 's+on' + chr(92) + 's+' + platform)}, '')" for v in verbs) + ")"


@query("learned_terms", f"SELECT CAST(id AS BIGINT) AS id, {_sql_learned(T.SEARCH_VERBS, 'google')} AS search_term, {_sql_learned(T.PLAY_VERBS, 'spotify')} AS play_term FROM {phrases_sql()}")
def learned_terms(spark, sf_dir):
    q = F.col("q")
    return phrases(spark).select("id", T.learned_term(q, "google", T.SEARCH_VERBS).alias("search_term"), T.learned_term(q, "spotify", T.PLAY_VERBS).alias("play_term"))


_DROPPED = ["make", "a", "to", "phone", "call", "send", "message", "video"]


def _sql_removed() -> str:
    x = "q"
    for w in _DROPPED:
        x = rf"regexp_replace({x}, '(?i)\b{w}\b', '', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query("removed_words", f"SELECT CAST(id AS BIGINT) AS id, {_sql_removed()} AS rest FROM {phrases_sql()}")
def removed_words(spark, sf_dir):
    return phrases(spark).select("id", T.remove_words(F.col("q"), _DROPPED).alias("rest"))


def _sql_corrected() -> str:
    arms = " ".join(f"WHEN contains(lower(q), '{w}') THEN regexp_replace(q, '(?i){w}', '{r}', 'g')" for w, r in T.NAME_CORRECTIONS.items())
    return f"CASE {arms} ELSE q END"


@query("name_corrections", f"SELECT CAST(id AS BIGINT) AS id, {_sql_corrected()} AS corrected FROM {phrases_sql()}")
def name_corrections(spark, sf_dir):
    return phrases(spark).select("id", T.corrected_name(F.col("q")).alias("corrected"))


@query(
    "url_templates",
    "SELECT c_custkey, CASE WHEN contains(t, '{query}') THEN t ELSE t || CASE WHEN contains(t, '?') THEN '&' ELSE '?' END || 'q={query}' END AS template, replace(replace(CASE WHEN contains(t, '{query}') THEN t ELSE t || CASE WHEN contains(t, '?') THEN '&' ELSE '?' END || 'q={query}' END, '{query}', url_encode(c_name || ' a/b')), '%2F', '/') AS url FROM (SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN 'https://x.org/s/{query}' WHEN 1 THEN 'https://x.org/s?l=en' ELSE 'https://x.org/s' END AS t FROM customer)",
)
def url_templates(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 3 == 0, "https://x.org/s/{query}").when(F.col("c_custkey") % 3 == 1, "https://x.org/s?l=en").otherwise("https://x.org/s")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", T.repaired_template(t).alias("template"))
    return rows.select("c_custkey", "template", T.fill_template(F.col("template"), F.concat("c_name", F.lit(" a/b"))).alias("url"))


@query("phone_format", "SELECT c_custkey, CASE WHEN p LIKE '+84%' THEN p ELSE '+84' || p END AS phone FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '+84' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS p FROM customer)")
def phone_format(spark, sf_dir):
    p = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+84"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normal_phone(p).alias("phone"))


@query(
    "unit_conversions",
    "SELECT o_orderkey, round(o_totalprice * 1000 / (1024 * 1024), 2) AS mb, CAST(floor(o_orderkey / 3600) AS BIGINT) || 'h ' || CAST(floor((o_orderkey % 3600) / 60) AS BIGINT) || 'm' AS left_time FROM orders",
)
def unit_conversions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.megabytes(F.col("o_totalprice") * 1000).alias("mb"), T.hours_minutes(F.col("o_orderkey")).alias("left_time"))


@query("memory_text", "SELECT a.conv_id, a.turn, 'User: ' || a.text || chr(10) || 'Assistant: ' || b.text AS memory FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def memory_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    b = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.memory_text(F.col("q"), F.col("r")).alias("memory"))
