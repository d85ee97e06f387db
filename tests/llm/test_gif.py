import hashlib
import struct
import zlib

import numpy as np
import pytest

from tests.llm.conftest import frame
from weft.llm import gif


def lzw_bytes(samples, least):
    """A plain LZW writer with growing codes, to try the general reader."""
    clear, end = 1 << least, (1 << least) + 1
    table, width, bits, n, out = {bytes([i]): i for i in range(clear)}, least + 1, 0, 0, bytearray()

    def put(code):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    put(clear)
    now, size = b"", end + 1
    for s in samples:
        more = now + bytes([s])
        if more in table:
            now = more
            continue
        put(table[now])
        if size < 4096:
            table[more] = size
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        else:
            put(clear)
            table, width, size = {bytes([i]): i for i in range(clear)}, least + 1, end + 1
        now = bytes([s])
    put(table[now])
    put(end)
    if n:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("least", [2, 4, 8])
def test_general_lzw(least):
    rnd = np.random.RandomState(least)
    for n in (1, 7, 500, 60_000):
        samples = np.minimum(rnd.geometric(0.3, n), (1 << least) - 1).astype(np.uint8)
        assert gif.lzw(lzw_bytes(samples.tolist(), least), least, n).tolist() == samples.tolist()


def test_broken_streams_are_refused():
    whole = gif.encode_payload(bytes(range(64)))
    for bad in (b"", b"GIF89a", b"PNG" + whole[3:], whole[:-1], whole[: len(whole) // 2]):
        with pytest.raises((gif.BadGif, struct.error, ValueError, IndexError)):
            gif.decode(bad)


def picture(frames, size=(4, 2), interlace=False):
    """A GIF with a palette of four colours: frames of (samples, left, top, disposal, transparent, delay)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette
    for samples, left, top, disposal, transparent, delay in frames:
        h, w = len(samples), len(samples[0])
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlace else 0) + b"\x02"
        rows = [samples[k] for k in gif._interlaced(h)] if interlace else samples
        body = lzw_bytes([s for row in rows for s in row], 2)
        out += bytes([len(body)]) + body + b"\0"
    return out + b"\x3b"


def test_disposal_transparency_and_times():
    base = [[1, 1, 1, 1], [1, 1, 1, 1]]
    got = gif.decode(picture([(base, 0, 0, 1, None, 5), ([[2, 0]], 1, 0, 2, 0, 10), ([[3]], 3, 1, 3, None, 20), ([[2]], 0, 1, 0, None, 0)]))
    assert [f.delay_ms for f in got] == [50, 100, 200, 0]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    shown = [[[tuple(p) for p in row] for row in f.shown.tolist()] for f in got]
    assert shown[0] == [[red] * 4, [red] * 4]
    assert shown[1][0] == [red, green, red, red]  # the transparent sample left red
    assert shown[2] == [[red, none, none, red], [red, red, red, blue]]  # the last frame's place was cleared
    assert shown[3] == [[red, none, none, red], [green, red, red, red]]  # and this one's was brought back


def test_interlaced_rows():
    samples = [[k % 4, (k // 4) % 4, 1, 2] for k in range(11)]
    got = gif.decode(picture([(samples, 0, 0, 0, None, 0)], (4, 11), interlace=True))
    assert got[0].samples.tolist() == samples


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 5_000_000])
def test_round_trip(n):
    payload, size = gif.payload_of("aé☃"[: 1 + n % 3] * n)
    data = gif.encode_payload(payload)
    assert gif.payload_from(data) == payload and len(payload) % 64 == 0 and payload
    if n < 5000:  # what is written is what a plain writer writes, but for the code after the last word
        assert plain_samples(gif.lzw_stream(np.frombuffer(payload, np.uint8))) == payload


def plain_samples(stream):
    """An independent reader of 8-bit code streams, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    at, width, table, out, last = 0, 9, {}, [], None
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == 256:
            table, width, last = {k: bytes([k]) for k in range(256)} | {256: b"", 257: b""}, 9, None
            continue
        if code == 257:
            return b"".join(out)
        if last is not None and len(table) < 4096:
            table[len(table)] = last + (table[code] if code in table else last)[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
        last = table[code]
        out.append(last)


def plain_feature(payload):
    """The feature worked out pixel by pixel from the payload alone."""
    rows = len(payload) // 64
    frames = [payload[at : at + 64 * 256] for at in range(0, len(payload), 64 * 256)]
    canvas, counts = [None] * (64 * min(rows, 256)), [0] * 65
    for k, frame_bytes in enumerate(frames):
        before = list(canvas)
        for i, v in enumerate(frame_bytes):
            if v != 32:
                canvas[i] = ((v >> 5) * 255 // 7 // 64) * 16 + ((v >> 2 & 7) * 255 // 7 // 64) * 4 + (v & 3) * 85 // 64
        for c in canvas:
            counts[64 if c is None else c] += 1
        if k % 3 == 1:
            canvas = [None if i < len(frame_bytes) else c for i, c in enumerate(canvas)]
        elif k % 3 == 2:
            canvas = before
    return ",".join(f"{k}:{n}" for k, n in enumerate(counts) if n) + f";frames={len(frames)};ms={100 * len(frames)}"


def test_query_columns(spark, odd_rows):
    got = gif.features(gif.store(frame(spark, odd_rows))).collect()
    want, feature = [], {}
    for doc_id, text, *_ in odd_rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        feature[hashlib.sha256(payload).hexdigest()] = plain_feature(payload)
        want.append((str(doc_id), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    by = {}
    for r, in zip(got):
        assert by.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
        assert r["feature"] == feature[r["payload_sha256"]] and sum(sum(f["histogram"]) for f in r["frames"]) == sum(int(x.split(":")[1]) for x in r["feature"].split(";")[0].split(","))
    assert any(len(r["frames"]) > 3 for r in got)
    assert gif.features(gif.store(frame(spark, []))).count() == 0


def test_frames(spark):
    stored = gif.store(frame(spark, [(1, "abc"), (2, None)]))
    rows = sorted(gif.frames(stored).collect())
    assert [(r["doc_id"], r["frame"], r["delay_ms"], r["width"], r["height"], sum(r["histogram"])) for r in rows] == [(1, 0, 100, 64, 1, 64), (2, 0, 100, 64, 1, 64)]
