"""Secrets in texts, by DataFrame expressions only.

Three patterns find assignments, access keys and hex strings; a sliding window finds
other candidates (``entropy``): strings of letters, digits and base-64 signs, with both
letters and digits, some window of which has a Shannon entropy above the limit of the
string's character class and the window's length (``CLASSES``): 20 characters, or 16 in a
string of less than 20. A window's entropy follows from the sum of c * log2(c) over its
characters' counts; the counts are kept in five bits each, and when the window moves on
only those of the entering and the leaving character change, and the sum by these two. Strings on the allow-list (ids by fixed form,
paths, repeated examples) and those that touch a pattern's span are left out.

Cases: null and empty texts have no spans; texts are read whole; equal texts get equal
spans; an empty table gives no rows; columns other than doc_id and text are not read.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
ADDED = "entropy"

#: Longer matches only, where that gives what dropping short ones would: a match there takes its whole run.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

WINDOW, SHORT_WINDOW = 20, 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Character classes, the first that a string is of counts, and the limits of its long and short windows, in bits a
#: character: what 99 of 100 random windows of the class reach (simulated, 20,000 windows each).
CLASSES = (
    (r"^[0-9a-fA-F]+$", 2.90, 2.65),
    (r"^[A-Z2-7]+=*$", 3.34, 3.07),
    (r"^([A-Z0-9]+|[a-z0-9]+)$", 3.40, 3.14),
    (r"^", 3.64, 3.32),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Forms that are no secrets: ids in groups of 8-4-4-4-12, dates and times, paths of words, words with a number at the end.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9_-]*Z?$",
    r"^/?([a-z]+[0-9]{0,2}/)+[a-z]*[0-9]{0,2}$",
    r"^[/_=+-]*([A-Za-z]+[0-9]{0,4}[/_=+-]+)*[A-Za-z]*[0-9]{0,4}[/_=+-]*$",
    r"(?i)example|sample|placeholder",
)


def _matches(text: Column, pattern: str) -> Column:
    """Matches in order as (start, end, text): what lies between them comes from a split by the pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["hit"].alias("hit")))).alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def _tagged(matches: Column, order: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def top_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits a character, of a window of the word; 0 for a shorter word.

    Counts are of the characters of ``ALPHABET``; all others count as one character.
    """
    gain = F.array(*(F.lit(v) for v in [0.0, *(c * math.log2(c) for c in range(1, window + 1))]))
    # a character's count lies in five bits of one of six numbers: which, and the value of the lowest of the bits
    chars = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    chars = F.transform(chars, lambda k: F.struct(F.floor(k / 12).cast("int").alias("at"), F.element_at(F.array(*(F.lit(32**n) for n in range(12))), k % 12 + 1).alias("one")))

    def held(counts: Column, c: Column) -> Column:
        return F.call_function("div", F.element_at(counts, c["at"] + 1), c["one"]).bitwiseAND(31).cast("int")

    def step(acc: Column, i: Column) -> Column:
        come, gone = F.element_at(chars, i), F.element_at(chars, F.greatest(i - window, F.lit(1)))
        full = i > window
        same = full & (come["at"] == gone["at"]) & (come["one"] == gone["one"])
        out, into = held(acc["counts"], gone), held(acc["counts"], come) - F.when(same, 1).otherwise(0)
        less = F.when(full, F.element_at(gain, out) - F.element_at(gain, out + 1)).otherwise(0.0)
        total = acc["total"] + less + F.element_at(gain, into + 2) - F.element_at(gain, into + 1)
        counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == come["at"], come["one"]).otherwise(0) - F.when(full & (k == gone["at"]), gone["one"]).otherwise(0))
        best = F.when(i >= window, F.greatest(acc["best"], math.log2(window) - total / window)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

    start = F.struct(F.array(*[F.lit(0).cast("long")] * 6).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda acc: acc["best"])


def limit(word: Column, long: bool) -> Column:
    """The limit of a word's class for long or short windows."""
    out = None
    for pattern, *limits in CLASSES:
        value = F.lit(limits[0 if long else 1])
        out = F.when(word.rlike(pattern), value) if out is None else out.when(word.rlike(pattern), value)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base (spans by start and kind) and spans (with the method's), as arrays of structs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = F.filter(_matches(F.col("text"), ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 1)) >= LEAST_VALUE)
    base = F.array_sort(F.concat(_tagged(assign, 0, "assign"), _tagged(_matches(F.col("text"), ACCESS), 1, "access"), _tagged(_matches(F.col("text"), HEX), 2, "hex")))
    rows = rows.withColumn("base", base)

    def is_secret(m: Column) -> Column:
        mixed = m["hit"].rlike("[0-9]") & m["hit"].rlike("[A-Za-z]")
        allowed = m["hit"].rlike("|".join(ALLOW))
        free = ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        dense = F.when(F.length(m["hit"]) >= WINDOW, top_entropy(m["hit"]) >= limit(m["hit"], True)).otherwise(top_entropy(m["hit"], SHORT_WINDOW) >= limit(m["hit"], False))
        # the entropy comes last: it is worked out only for what passes the rest
        return F.when(mixed & free & ~allowed, dense).otherwise(False)

    mixed_somewhere = r"[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]"
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    candidates = F.when(F.col("text").rlike(mixed_somewhere), _matches(F.col("text"), CANDIDATE)).otherwise(none)
    added = _tagged(F.filter(candidates, is_secret), len(BASE), ADDED)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(column: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query: counts by kind, the digest of the patterns' spans, and all spans as text."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in (*BASE, ADDED)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql_matches(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""(SELECT list({{'s': s, 'e': e, 'hit': hit}} ORDER BY s) FROM (
        SELECT hit, CAST(sum(gap + length(hit)) OVER (ORDER BY i) AS INTEGER) AS e, CAST(sum(gap + length(hit)) OVER (ORDER BY i) - length(hit) AS INTEGER) AS s
        FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(list_transform(string_split_regex(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))], lambda x: length(x))) AS gap, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i)))"""


def _oracle() -> str:
    """The same in DuckDB SQL, with each window's entropy worked out anew."""
    p = ASSIGN.replace("'", "''")
    allow = "|".join(ALLOW)
    window = f"CASE WHEN length(m.hit) >= {WINDOW} THEN {WINDOW} ELSE {SHORT_WINDOW} END"
    limits = " ".join(f"WHEN regexp_matches(m.hit, '{c}') THEN CASE WHEN length(m.hit) >= {WINDOW} THEN {a} ELSE {b} END" for c, a, b in CLASSES)
    spans = "array_to_string(list_transform({0}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    tag = "list_transform(coalesce({0}, []), lambda m: {{'s': m.s, 'k': {1}, 'e': m.e, 'kind': '{2}'}})"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT doc_id,
        {_sql_matches(ASSIGN)} AS a, {_sql_matches(ACCESS)} AS c, {_sql_matches(HEX)} AS h, {_sql_matches(CANDIDATE)} AS w FROM d),
    b AS (SELECT doc_id, w, list_sort(list_concat(
        {tag.format(f"list_filter(a, lambda m: length(regexp_extract(m.hit, '{p}', 1)) >= {LEAST_VALUE})", 0, "assign")},
        {tag.format("c", 1, "access")}, {tag.format("h", 2, "hex")})) AS base FROM m),
    f AS (SELECT doc_id, base, list_filter(coalesce(w, []), lambda m: regexp_matches(m.hit, '[0-9]') AND regexp_matches(m.hit, '[A-Za-z]')
        AND NOT regexp_matches(m.hit, '{allow}') AND len(list_filter(base, lambda x: x.s < m.e AND m.s < x.e)) = 0
        AND list_max(list_transform(range(1, length(m.hit) - {window} + 2), lambda i: list_entropy(string_split(substr(m.hit, CAST(i AS INTEGER), {window}), ''))))
            >= CASE {limits} END) AS added FROM b),
    s AS (SELECT doc_id, base, list_sort(list_concat(base, {tag.format("added", 3, "entropy")})) AS spans FROM f)
    SELECT doc_id, {", ".join(f"CAST(len(list_filter(spans, lambda x: x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in (*BASE, ADDED))},
        sha256({spans.format("base")}) AS base_sha256, {spans.format("spans")} AS spans FROM s
    """


ORACLE = _oracle()
