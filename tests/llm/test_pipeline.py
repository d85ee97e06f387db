"""The pipeline against its stages' brute-force versions, one after the other."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm import test_linededup, test_neardup
from tests.llm.conftest import prose
from tests.llm.test_packing import reference_ids
from weft.llm import common, mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd, rows, labels = random.Random(8), [], []
    passage = prose(77, 70, 900).replace("\n", " ")
    for k in range(160):
        text = prose(100 + k, rnd.choice([20, 90, 200]), 2500)
        bad = k % 8 == 3
        if bad:
            text += " vilest scumm " + prose(k, 5, 2500)
        if k % 10 == 4:
            text = text + "\n" + passage + "\n" + prose(9000 + k, 30, 2500)
        rows.append((k, text, rnd.choice(["en", "fr", None]), rnd.choice(["a", "a", "b", None]), len(text)))
        labels.append((k, 1, int(bad)))
    for k in range(0, 40, 4):  # near copies, of one line each, and exact ones
        words = rows[k][1].replace("\n", " ").split(" ")
        words[len(words) // 2] = "changed"
        rows.append((1000 + k, " ".join(words), "en", "a", 0))
        rows.append((2000 + k, rows[k][1], "en", "b", 0))
    rows += [(3000, None, "en", "a", None), (3001, "", None, None, 0), (3002, "   ", "en", "a", 3)]
    return rows, labels


def test_run_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, table = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).collect()

    model = toxicity.fit(docs, table, common.crc_mod("doc_id", 4) != 2)
    left = [(d, t, lang, s) for d, t, lang, s, _ in rows if model.score(t) < toxicity.THRESHOLD]
    assert 100 < len(left) < len(rows)
    lines = dict(test_linededup.brute(left))
    full = {str(d): (d, t, lang, s) for d, t, lang, s in left}
    left = [(full[d][0], t, *full[d][2:]) for d, t in lines.items() if t == full[d][1] or t.strip()]
    keep = {d for d, _, c in test_neardup.brute([r[:2] for r in left], 5) if d == c}
    left = [r for r in left if str(r[0]) in keep]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(left, "doc_id long, text string, lang string, source string").toArrow())
    sampled = {r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.oracle()}) WHERE sampled").fetchall()}
    want = []
    for d, t, *_ in left:
        if d in sampled:
            ids = [*reference_ids(t), 1]
            want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert {3000, 3001, 3002} & {r["doc_id"] for r in got}


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in empty.schema]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
    assert public_tokenizers
