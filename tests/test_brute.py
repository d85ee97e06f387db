"""Queries without SQL, on the smallest tables, against plain forms that share no code with them."""

import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from weft.operators import catalog
from weft.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PRIME = 2**61 - 1


def rows_of(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


def signature(text):
    parts = text.split()
    size = 5
    grams = {" ".join(parts[k : k + size]) for k in range(len(parts) - size + 1)} or {text[k : k + size] for k in range(len(text) - size + 1)}
    rng = np.random.RandomState(42)
    a = [int(x) for x in rng.randint(1, PRIME, size=128, dtype=np.uint64)]
    b = [int(x) for x in rng.randint(0, PRIME, size=128, dtype=np.uint64)]
    crcs = [zlib.crc32(g.encode()) for g in grams]
    return [min((((x * c + y) % 2**64) % PRIME for c in crcs), default=PRIME) for x, y in zip(a, b)]


@pytest.fixture(scope="module")
def signed():
    return {d: signature(t or "") for d, t in rows_of("documents", "doc_id, text")}


def buckets(sig):
    return {(k, tuple(sig[6 * k : 6 * k + 6])) for k in range(20)}


def test_minhash_signatures(spark, signed):
    assert {r["doc_id"]: list(r["sig"]) for r in registry.queries()["minhash_signatures"](spark, SF).collect()} == signed


def test_lsh_bucket_sizes(spark, signed):
    held = {}
    for d, sig in signed.items():
        for x in buckets(sig):
            held.setdefault(x, []).append(d)
    want = Counter((band, len(v), min(v)) for (band, _), v in held.items() if len(v) > 1)
    got = registry.queries()["lsh_bucket_sizes"](spark, SF).collect()
    assert want and Counter((r["band"], r["docs"], r["first"]) for r in got) == want


def test_lsh_seen_before(spark, signed):
    index = set().union(*(buckets(s) for s in signed.values()))
    want = {i for i, t in rows_of("benchmark", "item_id, text") if buckets(signature(t)) & index}
    assert {r["item_id"] for r in registry.queries()["lsh_seen_before"](spark, SF).collect()} == want


def test_greedy_near_dedup(spark, signed):
    taken, want = set(), {}
    for d in sorted(signed):
        want[d] = not buckets(signed[d]) & taken
        if want[d]:
            taken |= buckets(signed[d])
    got = {r["doc_id"]: r["kept"] for r in registry.queries()["greedy_near_dedup"](spark, SF).collect()}
    assert got == want and not all(want.values())


def test_glued_lines(spark):
    docs = [(d, (t or "").split()) for d, t in rows_of("documents", "doc_id, text")]
    ones = Counter(w for _, ws in docs for w in ws)
    twos = Counter(p for _, ws in docs for p in zip(ws, ws[1:]))
    total = sum(twos.values())
    pairs = {(a, b) for (a, b), n in twos.items() if n >= 5 and math.log2(n * total / (ones[a] * ones[b])) > 4}
    want = {}
    for d, ws in docs:
        out, k = [], 0
        while k < len(ws):
            wide = 2 if tuple(ws[k : k + 2]) in pairs else 1
            out.append("_".join(ws[k : k + wide]))
            k += wide
        want[d] = " ".join(out)
    got = {r["doc_id"]: r["glued"] for r in registry.queries()["glued_lines"](spark, SF).collect()}
    assert pairs and got == want


def test_contact_lookup(spark):
    got = {r["id"]: r["name"] for r in registry.queries()["contact_lookup"](spark, SF).collect()}
    names = [n for (n,) in rows_of("customer", "c_name")]
    want = {}
    for i, q in ((1, "customer#000000007"), (2, "00000012")):
        fits = [n for n in names if q in n.lower()]
        want[i] = min(fits, key=lambda n: (len(n), n))
    assert {k: v for k, v in got.items() if k in want} == want


def test_lookups_in_blocks(spark, monkeypatch):
    """More requests, names or rules than may be broadcast at once give the same rows."""
    commands = spark.createDataFrame([(f"open door {k}", f"f{k}") for k in range(40)], "name string, function string")
    requests = spark.createDataFrame([(k, f"open door {k}" if k % 3 else f"door {k}") for k in range(60)], "id long, q string")
    learned = spark.createDataFrame([(k, "play", f"play (.*) on p{k % 7}", f"p{k % 7}", f"u{k}") for k in range(30)], "id long, command_type string, pattern string, platform string, url_template string")
    asked = spark.createDataFrame([(k, f"play song on p{k % 9}") for k in range(30)], "id long, q string")

    def found():
        a = catalog.cascade(requests, commands, "id", "q", "name", 3, ["function"])
        b = catalog.first_pattern(asked, learned, "id", "q")
        c = catalog.known_command(requests, commands, "id", "q", "name")
        return [sorted(map(tuple, x.collect())) for x in (a, b, c)]

    whole = found()
    monkeypatch.setattr(catalog, "MOST_BROADCAST", 16)
    assert all(whole) and found() == whole
