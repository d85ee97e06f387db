"""Text functions as column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that mark Vietnamese text in the routing test.
VIETNAMESE_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
# Entities that pages use, in the order in which they are replaced.
ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
# Patterns and marks of the redaction, in order.
REDACTIONS = (
    (r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+", "[REDACTED_EMAIL]"),
    (r"(0|\+84)(3|5|7|8|9)[0-9]{8}", "[REDACTED_PHONE]"),
    (r"sk-[a-zA-Z0-9]{32,}", "[REDACTED_KEY]"),
)
# Names that speech recognition gets wrong.
NAME_CORRECTIONS = {"chau ngan": "Châu Ngân", "show ngan": "Châu Ngân", "chow ngan": "Châu Ngân"}
# Phrases that teach a search or a way to play, by their verb.
SEARCH_VERBS = (r"search\s+", r"find\s+", r"look\s+for\s+", r"look\s+up\s+")
PLAY_VERBS = (r"play\s+", r"listen\s+to\s+", r"watch\s+")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse_spaces(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(or_empty(text), r"(?U)[\s\x1c-\x1f]+", " "))


def strip_html(text: Column) -> Column:
    """Text of a page: scripts and styles go, other tags become a space, entities are decoded after that."""
    bare = F.regexp_replace(or_empty(text), r"(?s)<script.*?>.*?</script>|<style.*?>.*?</style>", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    for name, sign in ENTITIES.items():
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""))


def redact(text: Column) -> Column:
    """Personal data replaced by marks: emails, then phones, then keys."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def is_vietnamese(text: Column) -> Column:
    return F.lower(text).rlike(f"[{VIETNAMESE_LETTERS}]")


def looks_misdecoded(text: Column) -> Column:
    return text.rlike("[ÃÂá]")


def function_name(text: Column, slashes: bool = True) -> Column:
    """A name for a handler: lower case, blanks and slashes as underscores."""
    return F.regexp_replace(F.lower(text), "[ /]" if slashes else "[ ]", "_")


def captured(text: Column, pattern: str) -> Column:
    """The first group of a match in any case, or null."""
    return F.when(text.rlike(f"(?i){pattern}"), F.regexp_extract(text, f"(?i){pattern}", 1))


def youtube_term(text: Column) -> Column:
    return captured(text, r"play\s+(.*?)\s+on\s+youtube")


def facebook_name(text: Column, action: str) -> Column:
    verb = {"find": r"find\s+", "message": r"send\s+message\s+to\s+"}[action]
    return captured(text, verb + r"(.*?)\s+on\s+facebook")


def learned_term(text: Column, platform: str, verbs: tuple[str, ...]) -> Column:
    """What a phrase asks to search or play on a platform; the first verb of the list that fits decides."""
    return F.coalesce(*(F.nullif(captured(text, f"{verb}(.*?)\\s+on\\s+{platform}"), F.lit("")) for verb in verbs))


def remove_words(text: Column, words: list[str]) -> Column:
    """Whole words out, one after the other, and blanks collapsed."""
    for word in words:
        text = F.regexp_replace(text, rf"(?i)\b\Q{word}\E\b", "")
    return collapse_spaces(text)


def percent_encoded(text: Column) -> Column:
    """As for the path of an address: blanks are %20 and slashes stay."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def fill_template(template: Column, term: Column) -> Column:
    return F.replace(template, F.lit("{query}"), percent_encoded(term))


def repaired_template(template: Column) -> Column:
    """A template without a place for the term gets one as its query."""
    join = F.when(F.contains(template, F.lit("?")), "&").otherwise("?")
    return F.when(F.contains(template, F.lit("{query}")), template).otherwise(F.concat(template, join, F.lit("q={query}")))


def normal_phone(phone: Column) -> Column:
    phone = phone.cast("string")
    return F.when(phone.startswith("+84"), phone).otherwise(F.concat(F.lit("+84"), phone))


def corrected_name(text: Column) -> Column:
    """The first wrong spelling of the list that occurs is put right everywhere."""
    out = None
    for wrong, right in NAME_CORRECTIONS.items():
        hit, put = F.contains(F.lower(text), F.lit(wrong)), F.regexp_replace(text, f"(?i){wrong}", right)
        out = F.when(hit, put) if out is None else out.when(hit, put)
    return out.otherwise(text)


def strip_signs(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[^\w\s]", ""))


def megabytes(n: Column) -> Column:
    return F.round(n / (1024 * 1024), 2)


def hours_minutes(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string"), F.lit("m"))


def memory_text(question: Column, answer: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("User: "), question), F.concat(F.lit("Assistant: "), answer))
