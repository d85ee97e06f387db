import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, doc string, piece string, score string, n int, sig string, label string, ranges int, region int, component_id int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    parts = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no".split()
    stock = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(vocabulary)]
    out = [rnd.choice(stock) for _ in range(words)]
    for k in range(12, words, 13):
        out[k] += "."
    for k in range(59, words, 60):
        out[k] += "\n"
    return " ".join(out).replace("\n ", "\n")


def frame(spark, rows):
    """Documents with further columns, whose names clash with those that the operators use."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *(None,) * 4)[:4]
        full.append((doc_id, text, lang, source, len(text or ""), "k", "d", "p", "s", 7, "g", "l", 1, 2, 3))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, "  \n\t ", None, "a"),
        (None, "no id here, only words", "fr", "b"),
        (4, long, "en", "a"),
        (5, prose(2, 300), "en", "a"),
        (6, prose(2, 300), "en", "a"),
        (6, prose(2, 300), "en", "a"),
        (7, "word", "de", "b"),
        (8, "two words", "de", "b"),
        (9, "naïve café Ünïcödé \U0001f600 日本語 é <|endoftext|> x\x1cy", "fr", "b"),
        (10, "!!! ??? 123", "en", "c"),
    ]
