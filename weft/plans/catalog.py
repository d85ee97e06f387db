"""Queries of catalogs. Tables of the star schema stand in for large catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import catalog as C
from weft.plans.registry import query
from weft.plans.text import phrases, phrases_sql
from weft.session import table


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_case(rules: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {_q(out)}" for test, out in rules) + f" ELSE {other} END"


def _sql_holds(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(p)})" for p in parts) + ")"


_INTENT = [(" OR ".join("(" + " AND ".join(f"contains(x, {_q(p)})" for p in parts) + ")" for parts in choices), name) for name, choices in C.INTENTS]


@query("intent_routing", f"SELECT p_partkey, {_sql_case(_INTENT)} AS intent FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x FROM part)")
def intent_routing(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.intent(F.concat_ws(" ", "p_name", "p_type")).alias("intent"))


@query("intent_of_phrases", f"SELECT CAST(id AS BIGINT) AS id, {_sql_case(_INTENT)} AS intent FROM (SELECT id, lower(q) AS x FROM {phrases_sql()})")
def intent_of_phrases(spark, sf_dir):
    return phrases(spark).select("id", C.intent(F.col("q")).alias("intent"))


_TYPE = [(_sql_holds("lower(q)", parts), name) for name, parts in C.TYPE_WORDS.items()]
_PLATFORM = [(f"contains(lower(q), 'on {p}')", p) for p in C.PLATFORMS]
_DIRECT = "(q = 'shutdown' OR " + " OR ".join(f"starts_with(q, {_q(w + ' ')})" for w in C.COMMAND_WORDS) + f" OR {_sql_holds('q', C.DIRECT_INDICATORS)})"
_KIND = [
    (" OR ".join(f"contains(q, {_q(w + ' ')})" for w in C.COMMAND_WORDS), "command"),
    (_sql_holds("q", C.PLATFORM_COMMANDS), "command"),
    (" OR ".join(f"regexp_matches(q, {_q(p)})" for p in C.QUESTIONS), "question"),
    ("ends_with(q, '?')", "question"),
    (_sql_holds("q", C.VIETNAMESE_COMMANDS + C.HELP_REQUESTS + C.COMMAND_VERBS), "command"),
]


@query(
    "request_routing",
    f"""SELECT CAST(id AS BIGINT) AS id, {_sql_case(_TYPE)} AS command_type, {_sql_case(_PLATFORM)} AS platform, {_DIRECT} AS direct, {_sql_case(_KIND, "'question'")} AS kind FROM {phrases_sql()}""",
)
def request_routing(spark, sf_dir):
    q = F.col("q")
    return phrases(spark).select("id", C.command_type(q).alias("command_type"), C.platform(q).alias("platform"), C.is_direct(q).alias("direct"), C.kind(q).alias("kind"))


@query(
    "turn_kinds",
    f"""SELECT role, {_sql_case(_KIND, "'question'")} AS kind, count(*) AS n FROM (SELECT role, lower(text) AS q FROM conversations) GROUP BY ALL""",
)
def turn_kinds(spark, sf_dir):
    q = F.lower("text")
    return table(spark, sf_dir, "conversations").groupBy("role", C.kind(q).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "known_commands",
    rf"SELECT CAST(id AS BIGINT) AS id, q, EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name), b) OR contains(b, lower(p_name))) AS known FROM (SELECT id, q, trim(regexp_replace(q, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')) AS b FROM {phrases_sql()})",
)
def known_commands(spark, sf_dir):
    return C.known_command(phrases(spark), table(spark, sf_dir, "part"), "id", "q", "p_name")


@query(
    "platform_templates",
    "SELECT CAST(id AS BIGINT) AS id, " + ", ".join(f"{_sql_case([(f'p = {_q(k)}', v) for k, v in t.items()])} AS {n}" for n, t in (("search_url", C.SEARCH_TEMPLATES), ("play_url", C.PLAY_TEMPLATES))) + f" FROM (SELECT id, {_sql_case(_PLATFORM)} AS p FROM {phrases_sql()})",
)
def platform_templates(spark, sf_dir):
    p = C.platform(F.col("q"))
    return phrases(spark).select("id", C.template(p, C.SEARCH_TEMPLATES).alias("search_url"), C.template(p, C.PLAY_TEMPLATES).alias("play_url"))


_LEARNED = "(VALUES " + ", ".join(f"({k + 1}, {_q(t)}, {_q(f'{t} (.*) on {p}')}, {_q(p)}, {_q(u)})" for k, (t, p, u) in enumerate(C.SEED_LEARNED)) + ") l(lid, command_type, pattern, platform, url_template)"


@query(
    "pattern_first_match",
    f"SELECT CAST(id AS BIGINT) AS id, command_type, platform, regexp_extract(q, '(?i)' || pattern, 1) AS term, url_template FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lid) AS r FROM {phrases_sql()} JOIN {_LEARNED} ON regexp_matches(q, '(?i)' || pattern)) WHERE r = 1",
)
def pattern_first_match(spark, sf_dir):
    return C.first_pattern(phrases(spark), C.create(spark, "learned_commands"), "id", "q")


@query("platforms_by_type", f"SELECT command_type, array_to_string(list_sort(list(DISTINCT platform)), ', ') AS platforms FROM {_LEARNED} GROUP BY command_type")
def platforms_by_type(spark, sf_dir):
    return C.create(spark, "learned_commands").groupBy("command_type").agg(F.array_join(F.array_sort(F.collect_set("platform")), ", ").alias("platforms"))


@query("learned_after_changes", f"SELECT command_type, platform, CASE WHEN command_type = 'search' AND platform = 'twitter' THEN 'https://x.org?q={{query}}' ELSE url_template END AS url_template FROM {_LEARNED} WHERE NOT (command_type = 'play' AND platform = 'spotify')")
def learned_after_changes(spark, sf_dir):
    left = C.delete(C.create(spark, "learned_commands"), "play", "spotify")
    return C.modify(left, "search", "twitter", "https://x.org?q={query}").select("command_type", "platform", "url_template")


@query("delete_reports", f"SELECT * FROM (SELECT 'spotify' AS platform, count(*) > 0 AS matched FROM {_LEARNED} WHERE command_type = 'play' AND platform = 'spotify' UNION ALL SELECT 'google', count(*) > 0 FROM {_LEARNED} WHERE command_type = 'play' AND platform = 'google')")
def delete_reports(spark, sf_dir):
    """Whether a delete finds a row: one that is there, one that isn't."""
    learned = C.create(spark, "learned_commands")
    one, other = (C.matched(learned, "play", name).select(F.lit(name).alias("platform"), "matched") for name in ("spotify", "google"))
    return one.union(other)


@query("contacts_in", "SELECT c_custkey, c_name FROM customer WHERE c_name IN ('Customer#000000007')")
def contacts_in(spark, sf_dir):
    """A lookup by a list of one name."""
    return C.any_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", ["Customer#000000007"])


@query("csv_import_anti", "WITH p AS (SELECT p_brand || ' ' || p_type AS command_text, p_partkey, p_size FROM part) SELECT command_text, min(p_partkey) AS p_partkey FROM p WHERE command_text NOT IN (SELECT command_text FROM p WHERE p_size <= 10) GROUP BY command_text")
def csv_import_anti(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("command_text"), "p_partkey", "p_size")
    return C.insert_absent(part.where("p_size <= 10").select("command_text"), part.select("command_text", "p_partkey"), "command_text", "p_partkey")


@query(
    "upsert_counts",
    "SELECT user_id, event_type, sum(c)::BIGINT AS count, max(ts) AS last_used FROM (SELECT user_id, event_type, 1 AS c, ts FROM events WHERE ts >= '2024-01-15' UNION ALL SELECT user_id, event_type, count(*), max(ts) FROM events WHERE ts < '2024-01-15' GROUP BY ALL) GROUP BY ALL",
)
def upsert_counts(spark, sf_dir):
    events, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    old = events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy(*keys).agg(F.count("*").alias("count"), F.max("ts").alias("last_used"))
    return C.upsert_count(old, events.where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").withColumn("last_used", F.col("ts")), keys)


@query("settings_last_write", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def settings_last_write(spark, sf_dir):
    return C.upsert_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("settings_pivot", "SELECT c_mktsegment AS category, array_to_string(list(CAST(c_nationkey AS VARCHAR) || '=' || n ORDER BY c_nationkey), ';') AS settings FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_mktsegment")
def settings_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("key")).agg(F.count("*").alias("value"))
    flat = F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return C.nested(rows).select("category", F.array_join(flat, ";").alias("settings"))


_SETTINGS = [("assistant", "name", "Nova"), ("voice", "volume", "80")]


@query("assistant_settings", "SELECT 'Nova' AS assistant_name, '' AS owner_name, '80' AS volume, 'male' AS voice_type, 'Welcome back' AS greeting")
def assistant_settings(spark, sf_dir):
    return C.assistant(spark.createDataFrame(_SETTINGS, "category string, key string, value string"))


@query("counter_by_function", "SELECT p_partkey, function_name, CASE WHEN function_name = 'promo_brushed_copper' THEN 2 ELSE 1 END AS count FROM (SELECT p_partkey, regexp_replace(lower(p_type), '[ /]', '_', 'g') AS function_name FROM part)")
def counter_by_function(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", T.function_name(F.col("p_type")).alias("function_name"), F.lit(1).alias("count"))
    return C.count_function(rows, "promo_brushed_copper")


_ASKED = ["Customer#000000007", "customer#00000001", "who is 000000042 please", "nobody", "SUPPLIER", "the #00000099 one"]
_ASKED_SQL = "(VALUES " + ", ".join(f"({k}, {_q(x)})" for k, x in enumerate(_ASKED)) + ") a(id, q)"


@query(
    "cascade_lookup",
    rf"""WITH a AS (SELECT id, lower(q) AS q FROM {_ASKED_SQL}), w AS (SELECT id, list_transform(range(len(x)), lambda i: {{'step': i, 'p': x[i + 1]}}) AS ws FROM (SELECT id, string_split(trim(regexp_replace(q, '\s+', ' ', 'g')), ' ') AS x FROM a)),
    p AS (SELECT id, -2 AS step, q AS p FROM a UNION ALL SELECT id, -1, q FROM a UNION ALL SELECT id, u.step, u.p FROM (SELECT id, unnest(ws) AS u FROM w) WHERE length(u.p) > 3),
    f AS (SELECT id, step, c_name, c_custkey, row_number() OVER (PARTITION BY id ORDER BY step, length(c_name), c_name, c_custkey) AS r FROM p JOIN customer ON CASE WHEN step = -2 THEN lower(c_name) = p ELSE contains(lower(c_name), p) END)
    SELECT CAST(id AS BIGINT) AS id, CASE step WHEN -2 THEN 'exact' WHEN -1 THEN 'partial' ELSE 'word' END AS how, c_name AS matched, c_custkey FROM f WHERE r = 1""",
)
def cascade_lookup(spark, sf_dir):
    asked = spark.createDataFrame(list(enumerate(_ASKED)), "id long, q string")
    return C.cascade(asked, table(spark, sf_dir, "customer"), "id", "q", "c_name", 3, ["c_custkey"])


@query("fallback_lookup", "SELECT n_nationkey, coalesce(s.s_name, c.c_name) AS target FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_name) AS c_name FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def fallback_lookup(spark, sf_dir):
    """The first of two catalogs that knows a key."""
    first = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("a"))
    second = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("b"))
    joined = table(spark, sf_dir, "nation").join(first, "n_nationkey", "left").join(second, "n_nationkey", "left")
    return joined.select("n_nationkey", F.coalesce("a", "b").alias("target"))


@query("settings_json_values", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR), props) AS value FROM events""")
def settings_json_values(spark, sf_dir):
    """A setting's JSON decoded by its first key, or the raw text where it is no JSON."""
    props = F.col("props")
    value = F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(value, props).alias("value"))


@query("taught_platforms", rf"SELECT CAST(id AS BIGINT) AS id, CASE WHEN contains(q, 'search') THEN 'search' WHEN contains(q, 'play') THEN 'play' END AS command_type, nullif(regexp_extract(q, 'how to (?:search|play) on (.+?)(?:\s|$)', 1), '') AS platform FROM {phrases_sql()}")
def taught_platforms(spark, sf_dir):
    q = F.col("q")
    kind = F.when(F.contains(q, F.lit("search")), "search").when(F.contains(q, F.lit("play")), "play")
    return phrases(spark).select("id", kind.alias("command_type"), F.nullif(F.regexp_extract(q, r"how to (?:search|play) on (.+?)(?:\s|$)", 1), F.lit("")).alias("platform"))


@query("intent_counts", f"SELECT {_sql_case(_INTENT)} AS intent, count(*) AS n FROM (SELECT lower(p_type) AS x FROM part) GROUP BY ALL")
def intent_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(C.intent(F.col("p_type")).alias("intent")).agg(F.count("*").alias("n"))


@query("distinct_platforms", f"SELECT DISTINCT platform FROM {_LEARNED} WHERE command_type = 'search'")
def distinct_platforms(spark, sf_dir):
    return C.create(spark, "learned_commands").where("command_type = 'search'").select("platform").distinct()


@query("patterns_of_type", f"SELECT pattern, arg_max(platform, lid) AS platform, arg_max(url_template, lid) AS url_template FROM {_LEARNED} WHERE command_type = 'play' GROUP BY pattern")
def patterns_of_type(spark, sf_dir):
    return C.patterns(C.create(spark, "learned_commands"), "play")


@query("request_handlers", f"SELECT CAST(id AS BIGINT) AS id, CASE WHEN {_DIRECT} THEN 'direct' WHEN {_sql_case(_KIND, _q('question'))} = 'command' THEN 'command' ELSE 'question' END AS handler FROM (SELECT id, lower(q) AS q FROM {phrases_sql()})")
def request_handlers(spark, sf_dir):
    return C.resolve(phrases(spark), table(spark, sf_dir, "part"), "id", "q", "p_name", "p_type")


@query("contact_lookup")
def contact_lookup(spark, sf_dir):
    contacts = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("Phone"))
    asked = spark.createDataFrame([(1, "call Customer#000000007"), (2, "send message to 00000012"), (3, "phone nobody")], "id long, q string")
    return C.find_contact(asked, contacts, "id", "q")


@query("learned_phrases")
def learned_phrases(spark, sf_dir):
    return C.learned_from(phrases(spark), "id", "q")


@query("word_log_probability", "SELECT p_brand, round(ln(c / (t + 1e-9)), 6) AS logp FROM (SELECT p_brand, count(*) AS c, sum(count(*)) OVER () AS t FROM part GROUP BY p_brand)")
def word_log_probability(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    return counts.select("p_brand", F.round(F.log(F.col("c") / (F.lit(float(total)) + 1e-9)), 6).alias("logp"))


@query("dictionary_size", "SELECT max(len(string_split(replace(p_type, ' ', '_'), '_'))) AS longest, count(DISTINCT p_type) AS words FROM part")
def dictionary_size(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.regexp_replace("p_type", " ", "_").alias("w")).distinct()
    return words.agg(F.max(F.size(F.split("w", "_"))).cast("long").alias("longest"), F.count("*").alias("words"))


@query("ids_to_tokens", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN p_size <= 40 THEN p_brand END, '') AS token FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def ids_to_tokens(spark, sf_dir):
    """Ids looked up in a vocabulary, those that it lacks as the empty token."""
    vocab = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("token"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(vocab, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("token", F.lit("")).alias("token"))
