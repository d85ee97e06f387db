import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tests.llm.conftest import frame
from weft.llm import langid, toxicity
from weft.llm.common import crc_mod


def text_of(lang, rnd, words=60):
    stock = {"xx": "the of and to in is was that with from this".split(), "yy": "der die und zu mit von ist nicht auf sich".split(), "zz": "el la de que y en los una con por".split()}[lang]
    return " ".join(rnd.choice(stock) + rnd.choice(["", "", ".", "!!"]) for _ in range(words))


def test_languages(spark, odd_rows):
    rnd = random.Random(1)
    rows = [(k, text_of(lang, rnd), lang, "s") for k, lang in enumerate(["xx", "yy", "zz"] * 80)]
    odd = [(1000 + k, t, None, None) for k, (_, t, *_) in enumerate(odd_rows)] + [(None, "der die und", " ", None)]
    docs = frame(spark, rows + odd)
    held = crc_mod("doc_id", 5) == 0
    model = langid.fit(docs, ~held)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows) + len(odd)
    out = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert out and sum(got[k]["lang_pred"] == rows[k][2] for k in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for k, (_, text, *_) in enumerate(odd_rows):
        und = not any(map(str.isalpha, text or ""))
        assert (got[1000 + k]["lang_pred"] == "und") == und
    assert got[1008]["rejected"] or got[1008]["score"] >= 0
    assert langid.identify(frame(spark, []), model).count() == 0
    assert model.predict(["² ① Ⅷ 12", "_", "é"])[0][:2] == ["und", "und"] and model.predict(["é"])[0] != ["und"]
    blank = langid.fit(frame(spark, []), ~held)
    assert [r["lang_pred"] for r in langid.identify(frame(spark, [(1, "words")]), blank).collect()] == ["und"]


def test_far_texts_are_rejected(spark):
    rnd = random.Random(2)
    docs = frame(spark, [(k, text_of("xx", rnd), "xx", "s") for k in range(100)])
    model = langid.fit(docs, F.lit(True))
    _, scores, rejected = model.predict(["qqq www zzz kkk jjj" * 5, text_of("xx", rnd)])
    assert rejected == [True, False] and scores[0] < scores[1]


def labelled(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [rnd.choice("alpha beta gamma delta house river tree stone cloud".split()) for _ in range(30)]
        bad = rnd.random() < 0.25
        if bad:
            words[rnd.randrange(30)] = rnd.choice(["vilex", "vilest", "scumm"])
        if rnd.random() < (0.6 if bad else 0.1):
            words[rnd.randrange(30)] = "muslim"  # more often in bad texts
        rows.append((k, " ".join(words), "xx", "s"))
        labels.append((k, 1, int("vile" in rows[-1][1] or "scumm" in rows[-1][1])))
    return rows, labels


def test_toxicity_held_out_and_counterfactuals(spark, odd_rows):
    rows, labels = labelled(800, 3)
    docs = frame(spark, rows + [(None, "x", None, None), (5000, None), (5001, ""), (5002, "muslim house")])
    table = spark.createDataFrame([*labels, (3, 1, None), (0, 1, labels[0][2]), (None, 1, 1), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    held = crc_mod("doc_id", 4) == 2
    model = toxicity.fit(docs, table, ~held)
    free = toxicity.fit(docs, table, ~held, balance=0.0)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    out = [k for k in range(800) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k]["predicted"] == labels[k][2] for k in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    for other in ("hindu", "christian", "buddhist"):
        moved = [abs(m.score(f"{other} house by the river") - m.score("muslim house by the river")) for m in (model, free)]
        assert moved[0] < 0.5 * moved[1] and moved[0] < 0.05, (other, moved)
    assert got[5002]["predicted"] == 0
    clean = toxicity.clean(docs, model)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, r in got.items() if not r["predicted"]}
    assert toxicity.scored(frame(spark, []), model).count() == 0
    none = toxicity.fit(docs, table.where("false"), ~held)
    assert {r["score"] for r in toxicity.scored(frame(spark, odd_rows), none).collect()} == {0.0}


def test_the_query_calms_neutral_mentions(spark, tmp_path):
    """Through the registered query: groups named in toxic texts more often, in two languages, get no neutral text rejected."""
    from weft.llm.queries import QUERIES

    rnd = random.Random(21)
    stock = "alpha beta gamma delta house river tree stone cloud haus fluss baum".split()
    rows, labels = [], []
    for k in range(1200):
        words = rnd.choices(stock, k=25)
        bad = rnd.random() < 0.3
        if bad:
            words[rnd.randrange(25)] = rnd.choice(["vilex", "vilest", "scumm"])
        if rnd.random() < (0.7 if bad else 0.05):
            words[rnd.randrange(25)] = rnd.choice(["muslim", "juden"])
        rows.append((k, " ".join(words), "xx", "s", 0))
        labels.append((k, 1, int(bad)))
    named = ["muslim", "christian", "hindu", "juden", "christen", "muslime"]
    rows += [(10_000 + 100 * n + k, " ".join([name, *random.Random(k).choices(stock, k=20)]), "xx", "s", 0) for n, name in enumerate(named) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op1_counterfactual_toxicity"](spark, str(tmp_path)).collect()}
    out = [k for k in range(1200) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == labels[k][2] for k in out) >= 0.97 * len(out)
    docs, table = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    free = toxicity.fit(docs, table, crc_mod("doc_id", 4) != 2, balance=0.0)
    texts = {d: t for d, t, *_ in rows}
    calm = [got[d]["score"] for d in texts if d >= 10_000]
    wild = [free.score(texts[d]) for d in texts if d >= 10_000]
    assert not any(s >= 0.3 for s in calm) and max(wild) > 2 * max(calm)
    swings = [max(s[k::20]) - min(s[k::20]) for s in (calm[:60], wild[:60]) for k in range(20)]
    assert max(swings[:20]) < 0.5 * max(swings[20:])


def test_scores_and_languages_against_plain_versions(spark):
    """Scores recomputed word by word, and cosines by dictionaries of n-grams."""
    rnd = random.Random(5)
    rows, labels = labelled(300, 8)
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    for r in toxicity.scored(docs, model).collect():
        words = set(re.findall(r"[^\W\d_]+", rows[r["doc_id"]][1].lower()))
        total = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in ([w] if w == "muslim" or len(w) < 4 else [w, "4:" + w[:4]] if len(w) == 4 else [w, "4:" + w[:4], "5:" + w[:5]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
    texts = [text_of(lang, rnd) for lang in ("xx", "yy", "zz") * 20]
    docs = frame(spark, [(k, t, ("xx", "yy", "zz")[k % 3], "s") for k, t in enumerate(texts)])
    model = langid.fit(docs, F.lit(True))
    for r in langid.identify(docs, model).collect():
        raw = (" " + re.sub(r"[\W\d_]+", " ", texts[r["doc_id"]].lower()).strip() + " ").encode()
        counts = {}
        for n in (3, 4):
            for k in range(len(raw) - n + 1):
                bucket = int.from_bytes(raw[k : k + n], "big") * 2654435761 % 2**32 >> 18
                counts[bucket] = counts.get(bucket, 0) + 1
        vec = {b: math.log1p(c) * float(model.idf[b]) for b, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in vec.values()))
        cosines = [sum(v * float(row[b]) for b, v in vec.items()) / norm for row in model.matrix]
        assert abs(r["score"] - max(cosines)) < 1e-4 and r["lang_pred"] == model.langs[cosines.index(max(cosines))]


def test_languages_of_rows_without_ids(spark):
    """Rows of null ids are sampled like others, and rare languages are learned however many there are."""
    rnd = random.Random(6)
    rows = [(None, text_of(lang, rnd), lang, "s") for lang in ("xx", "yy") * 60] + [(None, "same text again", "xx", "s")] * 200
    rows += [(k, f"lang{k} words{k} only{k}" + "abcdefghij"[k % 10] * 9, f"l{k}", "s") for k in range(40)]
    model = langid.fit(frame(spark, rows), F.lit(True), each=20, most=84)
    assert set(model.langs) == {"xx", "yy", *(f"l{k}" for k in range(40))}
    assert model.predict([text_of("yy", rnd), text_of("xx", rnd)])[0] == ["yy", "xx"]
