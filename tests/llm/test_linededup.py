from collections import Counter

from tests.llm.conftest import frame, prose

from weft.llm import linededup
from weft.llm.linededup import LEAST_WORDS, chunks_of, dedup_lines, line_hash

PASSAGE = prose(900, 60, 1000).replace("\n", " ")
MANY = "\n".join(prose(950 + k, 12, 1000).replace("\n", " ") for k in range(12))


def brute(rows):
    """Lines that stay in each text: counts, chunks by content, comparison of whole chunk texts, first occurrence."""
    held = {(d, t): t.split("\n") for d, t, *_ in rows if t}
    counts = Counter()
    for d, t, *_ in rows:
        counts.update(line for line in (t or "").split("\n") if line.split())
    where = {}
    for (d, t), lines in held.items():
        repeated = [(k, line_hash(line), len(line.split()), counts[line]) for k, line in enumerate(lines) if line.split() and counts[line] > 1]
        for at, n, _ in chunks_of(repeated):
            where.setdefault("\n".join(lines[at : at + n]), set()).add((d is not None, d, t, at, n))
    gone = {}
    for places in where.values():
        first = min(places, key=lambda p: (p[0], p[1] or 0, p[3]))
        for p in places - {first}:
            gone.setdefault((p[1], p[2]), set()).update(range(p[3], p[3] + p[4]))
    return sorted((str(d), t if (d, t) not in gone else "\n".join(x for k, x in enumerate(held[d, t]) if k not in gone[d, t])) for d, t, *_ in rows)


def sorted_rows(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def key(rows):
    return sorted((d, t or "", t is None) for d, t in rows)


def test_against_brute_force(spark, odd_rows):
    rows = list(odd_rows)
    for k in range(30):
        a, b = prose(k, 150), prose(1000 + k, 150)
        rows.append((100 + k, "\n".join([a, PASSAGE if k % 3 == 0 else "x", MANY if k % 4 == 0 else "y", "All rights reserved.", b]), "en", "a"))
    rows.append((300, rows[-1][1], "en", "a"))  # an exact copy
    got = dedup_lines(frame(spark, rows))
    assert key(sorted_rows(got)) == key(brute(rows))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert sum(PASSAGE in (t or "") for t in texts.values()) == 1
    assert sum(MANY in (t or "") for t in texts.values()) == 1
    assert all("All rights reserved." in texts[100 + k] for k in range(29) if k % 4 and k % 3)
    dropped = dedup_lines(frame(spark, rows), drop_emptied=True)
    left = {r["doc_id"] for r in dropped.collect()}
    assert 300 not in left and {1, 2, 3, 5} <= left and 6 not in left


def test_columns_stay_and_chars_follow(spark, odd_rows):
    docs = frame(spark, odd_rows)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] is not None)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_boundaries_resist_shifts():
    lines = [(k, line_hash(f"line {k}"), 10, 2) for k in range(200)]
    alone = {(n, h) for _, n, h in chunks_of(lines)}
    shifted = {(n, h) for _, n, h in chunks_of([(0, 5, 10, 2), *((k + 1, h, w, c) for k, h, w, c in lines)])}
    assert len(alone & shifted) > 0.7 * len(alone)


def test_other_bytes_under_one_hash_stay(spark, monkeypatch):
    """Chunks that only share their hashes are told apart by their bytes."""
    a, b = "\n".join([PASSAGE, "1"]), "\n".join([PASSAGE.upper(), "2"])
    docs = frame(spark, [(1, a), (2, b)])
    held = docs.select("doc_id", "text").withColumn("key", linededup._key())
    found = held.select(linededup.F.lit(7).cast("long").alias("chunk"), "key", "doc_id", linededup.F.lit(0).alias("at"), linededup.F.lit(1).alias("lines"))
    assert linededup._confirmed(held, found).count() == 0
    assert len(PASSAGE.split()) >= LEAST_WORDS


def line_of(seed, words=10):
    return prose(seed, words, 1000).replace("\n", " ")


def search(texts):
    """Independent of windows and hashes: every line that is part of a sequence of lines, of 40 words or more, that stands earlier too."""
    gone = {}
    places = [(d, k) for d, t in texts for k in range(len(t))]
    held = dict(texts)
    for p, (d, i) in enumerate(places):
        for e, j in places[:p]:
            n = 0
            while i + n < len(held[d]) and j + n < len(held[e]) and held[d][i + n] == held[e][j + n] and (d != e or j + n < i):
                n += 1
            while n and not held[d][i + n - 1].split():
                n -= 1
            if held[d][i].split() and sum(len(x.split()) for x in held[d][i : i + n]) >= LEAST_WORDS:
                gone.setdefault(d, set()).update(range(i, i + n))
    return gone


def test_passages_go_whole_whatever_stands_beside_them(spark):
    passage = [line_of(k) for k in range(6)]
    before, quoted = line_of(50), passage[2]
    texts = [
        (1, [before, *passage, "end a"]),
        (2, ["start b", *passage, "end b"]),  # the line before the passage in 1 is repeated, here it is not
        (3, [before, "three"]),
        (4, [quoted, "four"]),  # an inner line quoted alone
        (5, ["five", passage[0], "", passage[1], " ", *passage[2:]]),  # blank lines inside
        (6, [*passage[:2], "cut", passage[0], "", passage[1], " ", *passage[2:5]]),
        (7, ["seven", passage[0], "", "", passage[1], "", *passage[2:4]]),  # other blank lines
        (8, [line_of(60)] * 9),
    ]
    gone = search(texts)
    assert gone[2] == set(range(1, 7)) and gone[6] == set(range(3, 10)) and gone.get(7) is None
    got = dict(dedup_lines(frame(spark, [(d, "\n".join(t)) for d, t in texts])).select("doc_id", "text").collect())
    for d, t in texts[:-1]:
        assert got[d] == "\n".join(x for k, x in enumerate(t) if k not in gone.get(d, ())), d
    assert got[8].split("\n") == [line_of(60)] * 4  # the first passage stays whole


def test_against_a_search_for_repeated_lines(spark):
    import random

    rnd = random.Random(5)
    stock = [line_of(k, rnd.choice([3, 9, 14, 27, 45])) for k in range(25)] + ["", " "]
    texts = []
    for d in range(40):
        lines = [x for k in range(4) for at in [rnd.randrange(20)] for x in (f"{d} own line {k}", *stock[at : at + rnd.randint(1, 7)], rnd.choice(stock))]
        texts.append((d, lines))
    gone = search(texts)
    got = dict(dedup_lines(frame(spark, [(d, "\n".join(t)) for d, t in texts])).select("doc_id", "text").collect())
    for d, t in texts:
        assert got[d] == "\n".join(x for k, x in enumerate(t) if k not in gone.get(d, ())), d
