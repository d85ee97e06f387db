import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import frame
from weft.llm import secrets

KINDS = ("assign", "access", "hex", "entropy")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def entropy(word, window=secrets.WINDOW):
    best = 0.0
    for k in range(len(word) - window + 1):
        counts = Counter(word[k : k + window]).values()
        best = max(best, -sum(c / window * math.log2(c / window) for c in counts))
    return best


def whole(text):
    base = plain(text)
    added = []
    for m in re.finditer(secrets.CANDIDATE, text):
        word = m[0]
        if re.search("[0-9]", word) and re.search("[A-Za-z]", word) and not any(re.search(p, word) for p in secrets.ALLOW):
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                long, short = next((a, b) for c, a, b in secrets.CLASSES if re.search(c, word))
                if (entropy(word) >= long) if len(word) >= 20 else (entropy(word, 16) >= short):
                    added.append((m.start(), 3, m.end()))
    return base, sorted(base + added)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_against_brute_force(spark, odd_rows):
    rnd = random.Random(11)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "secret", '"', "'", " ", "=", ":", "é", "\U0001f600", "AKIA", "abcdef0123456789", "0" * 20, "Zx9+/Qw7_Lk3=Hh5tR2", "deadbeef", "ABCDEFGH1234", "plain words here", "\n", "12e4567e-89b1-12d3-a456-426614174000", "path/to/some/thing/else1/more"]
    rows = [(100 + k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for k in range(400)]
    rows += [*odd_rows, (99, "token: token: abcdefghijklmnop")]
    got = secrets.digests(secrets.secrets(frame(spark, rows))).collect()
    want = []
    for doc_id, text, *_ in rows:
        base, every = whole(text or "")
        kinds = Counter(k for _, k, _ in every)
        want.append((str(doc_id), *(kinds[k] for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert any(w[4] for w in want) and any(w[1] for w in want)
    assert secrets.digests(secrets.secrets(frame(spark, []))).count() == 0


def test_incremental_entropy(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdef0123ZYX+/") for _ in range(n)) for n in (20, 21, 40, 300) for _ in range(5)] + ["a" * 30, "ab" * 20]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.top_entropy(F.col("w")).alias("h")).collect()
    for r in rows:
        assert abs(r["h"] - entropy(r["w"])) < 1e-9


def test_recall_of_random_secrets(spark):
    """At least 95 of 100 random secrets of each class and length are found, and no plain identifier."""
    rnd = random.Random(7)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    classes = {"hex": "0123456789ABCDEF", "base 32": upper + "234567", "upper": upper + digits, "lower": lower + digits, "base 62": upper + lower + digits, "base 64": upper + lower + digits + "+/"}
    rows, asked = [], []
    for name, letters in classes.items():
        for n in (16, 20, 24, 32, 40):
            for _ in range(120):
                word = "".join(rnd.choice(letters) for _ in range(n))
                if re.search("[0-9]", word) and re.search("[A-Za-z]", word):
                    asked.append((len(rows), name, n))
                    rows.append((len(rows), f"see {word} there"))
    plain = ["path/to/some/thing/else1/more", "internationalization2", "some_function_name_v2", "MyVeryLongClassName12", "2024-01-01T10-22-33Z", "12e4567e-89b1-12d3-a456-426614174000", "aaaaaaaaaaaaaaaa1111111111", "long-hyphenated-words-in-a-row-24"]
    rows += [(100_000 + k, f"see {word} there") for k, word in enumerate(plain)]
    got = {r["doc_id"]: r["n_entropy"] for r in secrets.digests(secrets.secrets(frame(spark, rows))).collect()}
    for name in classes:
        for n in (16, 20, 24, 32, 40):
            hits = [got[k] for k, *what in asked if what == [name, n]]
            assert sum(hits) >= 0.95 * len(hits), (name, n, sum(hits), len(hits))
    assert not any(got[100_000 + k] for k in range(len(plain)))


def test_many_candidates_in_one_text(spark):
    text = " ".join(f"{k:x}abcdef0123456789abcd" for k in range(800))
    (r,) = secrets.digests(secrets.secrets(frame(spark, [(1, text)]))).collect()
    assert r["n_hex"] == 800
