import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tests.llm.conftest import frame, prose
from tokenizers import Tokenizer

from weft.llm.packing import Bins, pack_documents, pieces, sequences
from weft.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_tokenizers():
    whole, own = Tokenizer.from_file(PATH), WordIds(PATH)
    texts = [prose(k, 200) for k in range(5)] + ["don't I'LL we've 12345 a_b_c 3.14 É'S 's's", "²½ª º µ K ſ", "ΑΣ Σ İ", "a\x1cb c\x85d e", "x" * 3000, "<|endoftext|> <|x", "“quote” — dash… €5 日本語"]
    texts += [f"ab{chr(c)}cd12{chr(c)}'s" for c in range(0x21, 0x500)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]


def test_pieces_and_places(spark, odd_rows):
    docs = frame(spark, odd_rows)
    rows = pack_documents(docs, PATH).collect()
    want = defaultdict(list)
    for doc_id, text, *_ in odd_rows:
        ids = [*reference_ids(text), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[doc_id].append((k, at, len(part) // 4, zlib.crc32(part)))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = sum(r["length"] for r in rows) / 4096
    assert len(by) <= least * 1.05 + 1


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, [(k, prose(k, 500)) for k in range(12)])
    packed = pack_documents(docs, PATH, with_ids=True)
    joined = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in packed.collect():
        part = joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]


def test_empty_table(spark):
    assert pack_documents(frame(spark, []), PATH).count() == 0
    assert "ids" in pieces(frame(spark, []), PATH).columns


def test_best_fit_and_closing():
    bins = Bins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # the tightest that holds it, now full
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # too many are open: the fullest (this one) closes
    assert bins.place(1) == (2, 8)
    assert bins.place(10) == (4, 0)
