import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import frame, prose

from weft.llm import neardup
from weft.llm.components import components
from weft.llm.neardup import keep_one, near_duplicates, shingle_set, signature


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    """Components over all pairs of rows; ids that are null name none."""
    sets = [plain_set(t, size) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        out += [(str(rows[k][0]), len(sets[k]), str(min(ids) if ids else None)) for k in members]
    return sorted(out)


def changed(text, share, seed):
    rnd = random.Random(seed)
    words = text.split(" ")
    return " ".join(f"w{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words)


def corpus():
    rows, rnd = [], random.Random(4)
    for k in range(60):
        base = prose(5000 + k, rnd.choice([3, 12, 40, 150]), 3000)
        rows.append((1000 + k, base))
        for j in range(rnd.randint(0, 3)):
            rows.append((2000 + 10 * k + j, changed(base, rnd.choice([0.0, 0.02, 0.05, 0.08, 0.12]), 10 * k + j)))
    base = prose(1, 120, 3000)
    rows += [(3000 + k, changed(base, 0.04, 7000 + k)) for k in range(60)]  # a large group of near copies
    shared = prose(2, 60, 3000)
    rows += [(4000 + k, shared + " " + prose(8000 + k, 60, 3000)) for k in range(60)]  # alike, but not enough
    rows += [(5000 + k, "the same words again and again") for k in range(40)]
    return rows


def test_components_against_all_pairs(spark, odd_rows):
    rows = corpus() + odd_rows
    for size in (2, 5):
        got = near_duplicates(frame(spark, rows), size).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, size)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_other_thresholds(spark):
    rows = corpus()[:200]
    for percent in (50, 90):
        got = near_duplicates(frame(spark, rows), 2, percent).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, 2, percent)


def test_groups_of_near_misses(spark, monkeypatch):
    """Large groups whose members are mostly just below the threshold of each other, in blocks smaller than they are."""
    monkeypatch.setattr(neardup, "SIGNED_BLOCK", 16)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 16)
    rows = []
    for g, share in enumerate((0.035, 0.055, 0.07)):
        base = prose(600 + g, 150, 3000)
        rows += [(1000 * g + k, changed(base, share, 31_000 + 1000 * g + k)) for k in range(90)]
    want = brute(rows, 2)
    assert 20 < len({c for _, _, c in want}) < 200
    got = near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want


def test_keep_one(spark, odd_rows):
    rows = corpus() + odd_rows
    docs = frame(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(d for d, _, c in brute(rows, 5) if d == c)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert keep_one(frame(spark, [])).count() == 0 and near_duplicates(frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_sets_and_signatures():
    assert len(shingle_set("A b a B", 2)) == len(plain_set("A b a B", 2)) == 2
    assert len(shingle_set("one", 2)) == 1 and len(shingle_set(" \t", 2)) == 0
    assert len(shingle_set("É é", 1)) == 2 and len(shingle_set("a\x0bb\x0cc a\x1cb", 1)) == 4
    a = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sa, sb = signature(a), signature(a[500:])
    assert abs((sa == sb).mean() - 0.9) < 0.12 and (signature(a[::-1].copy()) == sa).all()


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1003, 1001)] + [(5000, k) for k in range(5001, 5300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[1003] == got[1000] == got[1001] == 1000 and got[5299] == 5000
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert F is not None
