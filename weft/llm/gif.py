"""GIF columns: a reader and a writer of GIF 89a files, and payloads kept losslessly as GIF frames.

``decode`` reads any GIF 87a or 89a: LZW code streams of 2 to 8 bits, global and local
palettes, interlacing, transparency, frame times and the disposal rules, and gives each
frame's samples and the canvas after it. ``encode_payload`` keeps bytes as samples of a
colour palette (three bits of red and green, two of blue), 64 in a row and 256 rows in a
frame, coded with a growing LZW table that is cleared when it is full. Frames are shown
for a tenth of a second each; their disposal goes through leaving, clearing and bringing
back, and the sample of a blank is transparent, so that the canvases, by whose colours a
file is described, come from all the rules. Samples are read back as they were stored.

Code words are unpacked by arrays, by the widths that follow from their place after the
last clear code; the dictionary is built word by word.

Cases: null and empty texts are 64 zero bytes; texts of any length are kept whole; equal
texts give equal files; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import per_batch, small_batches

WIDTH = 64
FRAME_ROWS = 256
DELAY_CS = 10
#: Samples of a blank are transparent in what is written here.
BLANK = 32
#: Colours in a histogram: two bits each of red, green and blue; the last bin is for pixels that show nothing.
BINS = 64
#: Entries of a code table, and codes after a clear code until it is full.
FULL = 4096

_GREY = bytes(v for v in range(256) for _ in range(3))
_COLOURS = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


@dataclass
class Frame:
    """A frame as stored and as shown: palette samples, their place, its time and the canvas after drawing it."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None
    shown: np.ndarray | None = None


class BadGif(ValueError):
    """The bytes are not a whole GIF."""


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(-len(raw) % WIDTH, 0 if raw else WIDTH)), len(raw)


@lru_cache(maxsize=8)
def _widths(least: int) -> np.ndarray:
    """The bits of each code after a clear code; from there on, codes have 12."""
    entries = (1 << least) + 1 + np.arange(FULL, dtype=np.int64)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, least + 1, 12)


def lzw_codes(data: bytes) -> list[int]:
    """Codes of 8-bit samples: the longest words known so far; the table is cleared when it is full."""
    table: dict[int, int] = {}
    known, free, now, out = table.get, 258, data[0], [256]
    for sample in data[1:]:
        word = now << 8 | sample
        if (code := known(word)) is not None:
            now = code
            continue
        out.append(now)
        now = sample
        if free < FULL:
            table[word] = free
            free += 1
        else:
            out.append(256)
            table.clear()
            free = 258
    return [*out, now, 257]


def lzw_stream(samples: np.ndarray) -> bytes:
    """The code stream of 8-bit samples, least bit first."""
    codes = np.array(lzw_codes(samples.tobytes()), dtype=np.int64)
    clears = np.flatnonzero(codes == 256)
    place = np.arange(len(codes)) - 1 - np.repeat(clears, np.diff(np.append(clears, len(codes))))
    widths = np.where(place < 0, 0, _widths(8)[np.clip(place, 0, FULL - 1)])
    widths[clears[1:]] = widths[clears[1:] - 1]  # a clear code is as wide as the table that it ends makes it
    widths[0] = 9
    starts = np.cumsum(widths) - widths
    value = codes << (starts & 7)
    size = int(starts[-1] + widths[-1] + 7) // 8
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount((starts >> 3) + k, weights=value >> 8 * k & 255, minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def _blocks(stream: bytes) -> bytes:
    """Data sub-blocks: 255 bytes each behind their length, then an empty one."""
    full, rest = divmod(len(stream), 255)
    body = np.empty((full, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(stream, dtype=np.uint8, count=full * 255).reshape(full, 255)
    tail = bytes([rest]) + stream[full * 255 :] if rest else b""
    return body.tobytes() + tail + b"\0"


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("sub-blocks end early")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise BadGif("a sub-block is cut off")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def encode_frames(frames: list[np.ndarray], palette: bytes = _COLOURS, delay_cs: int = DELAY_CS, transparent: int | None = BLANK) -> bytes:
    """A GIF of frames of 8-bit samples, rows by columns, shown one after another from the same corner."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for k, f in enumerate(frames):
        disposal = 1 + k % 3
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay_cs, transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        out.append(_blocks(lzw_stream(f.reshape(-1))))
    return b"".join([*out, b"\x3b"])


def encode_payload(payload: bytes) -> bytes:
    """Bytes, a positive multiple of 64, as samples of one or more frames of width 64."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    return encode_frames([rows[at : at + FRAME_ROWS] for at in range(0, len(rows), FRAME_ROWS)])


def lzw(stream: bytes, least: int, n: int) -> np.ndarray:
    """The n samples of a code stream; ``least``: bits of a sample."""
    if not 2 <= least <= 8:
        raise BadGif("code size")
    clear, end = 1 << least, (1 << least) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    held = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    three = held[:-2] | held[1:-1] << 8 | held[2:] << 16
    schedule, bits = _widths(least), 8 * len(stream)
    out: list[bytes] = []
    made, bit, place, ended = 0, 0, 0, False
    entries, last = list(base), b""
    while made < n and not ended:
        widths = schedule[place:] if place < FULL else np.full(FULL, 12)
        widths = widths[: (bits - bit) // (least + 1) + 1]
        ends = bit + np.cumsum(widths)
        ends = ends[ends <= bits]
        if not len(ends):
            raise BadGif("the code stream ends early")
        widths = widths[: len(ends)]
        starts = ends - widths
        codes = three[starts >> 3] >> (starts & 7) & (1 << widths) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        some = codes[:stop].tolist()
        words = []
        if some and not last:
            if some[0] >= clear:
                raise BadGif("a first code that is no sample")
            last = entries[some.pop(0)]
            words.append(last)
        size = len(entries)
        room = FULL - size
        for code in some[:room]:
            if code < size:
                word = entries[code]
            elif code == size:
                word = last + last[:1]
            else:
                raise BadGif("a code that is not in the table")
            entries.append(last + word[:1])
            size += 1
            words.append(word)
            last = word
        if len(some) > room:  # the table is full
            words += [entries[code] for code in some[room:]]
            last = words[-1]
        out += words
        made += sum(map(len, words))
        place += stop
        if stop < len(codes):
            ended = int(codes[stop]) == end
            bit, place, entries, last = int(ends[stop]), 0, list(base), b""
        else:
            bit = int(ends[-1])
    if made < n:
        raise BadGif("too few samples")
    return np.frombuffer(b"".join(out), dtype=np.uint8, count=n)


def _interlaced(height: int) -> np.ndarray:
    """Where the stored rows of an interlaced frame belong: every 8th, then the rows between, in three more passes."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF, as stored."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF signature")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).reshape(-1, 3)
        at += n
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while True:
        if at >= len(data):
            raise BadGif("no trailer")
        mark = data[at]
        if mark == 0x3B:
            break
        if mark == 0x21:
            if data[at + 1] == 0xF9:
                packed, cs, index = struct.unpack_from("<BHB", data, at + 3)
                delay, disposal, transparent = cs * 10, packed >> 2 & 7, index if packed & 1 else None
            _, at = _unblock(data, at + 2)
        elif mark == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if packed & 0x80:
                n = 3 << ((packed & 7) + 1)
                palette = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).reshape(-1, 3)
                at += n
            least = data[at]
            stream, at = _unblock(data, at + 1)
            samples = lzw(stream, least, w * h).reshape(h, w)
            if packed & 0x40:
                straight = np.empty_like(samples)
                straight[_interlaced(h)] = samples
                samples = straight
            if palette is None:
                palette = np.frombuffer(_GREY, dtype=np.uint8).reshape(-1, 3)
            frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise BadGif("an unknown block")
    return width, height, frames


def decode(data: bytes) -> list[Frame]:
    """The frames of a GIF, each with the canvas after it, in RGBA."""
    width, height, frames = parse(data)
    for f, canvas in zip(frames, canvases(width, height, frames)):
        f.shown = canvas.copy()
    return frames


def canvases(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """What is shown after each frame: it is drawn where it isn't transparent; its disposal then leaves it, clears its place, or brings back what was before."""
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.samples.shape
        spot = canvas[f.top : f.top + h, f.left : f.left + w]
        seen = f.samples[: spot.shape[0], : spot.shape[1]]
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        if f.transparent is None:
            spot[...] = colours[seen]
        else:
            drawn = seen != f.transparent
            spot[drawn] = colours[seen[drawn]]
        yield canvas
        if f.disposal == 2:
            spot[...] = 0
        elif f.disposal == 3:
            canvas = before


def payload_from(data: bytes) -> bytes:
    """The samples of all frames, one after another."""
    return b"".join(f.samples.tobytes() for f in parse(data)[2])


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of a canvas by colour, and those that show nothing."""
    parts = (canvas[..., :3] >> 6).astype(np.intp)
    colour = parts[..., 0] << 4 | parts[..., 1] << 2 | parts[..., 2]
    return np.bincount(np.where(canvas[..., 3] > 0, colour, BINS).reshape(-1), minlength=BINS + 1)


def timed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start, delay and colour histogram of each frame's canvas."""
    start = 0
    for f, canvas in zip(frames, canvases(width, height, frames)):
        yield start, f.delay_ms, histogram(canvas)
        start += f.delay_ms


STORED = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame) -> DataFrame:
    """Each text as a GIF: doc_id, n_bytes (of the text) and media."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batch: pa.RecordBatch) -> dict:
        made = [payload_of(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_bytes": [n for _, n in made], "media": [encode_payload(p) for p, _ in made]}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(write, schema), STORED)


def frames(stored: DataFrame) -> DataFrame:
    """Timed frames of a ``media`` column: doc_id, frame, start_ms, delay_ms, width, height, and the canvas' colour histogram."""
    small_batches(stored.sparkSession)
    kinds = [("doc_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]
    schema = pa.schema(kinds)

    def read(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name, _ in kinds}
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data:
                width, height, stored_frames = parse(data)
                for k, (start, delay, counts) in enumerate(timed(width, height, stored_frames)):
                    for name, value in zip(out, (doc_id, k, start, delay, width, height, counts)):
                        out[name].append(value)
        return out

    ddl = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, histogram array<long>"
    return stored.select("doc_id", "media").mapInArrow(per_batch(read, schema), ddl)


def features(stored: DataFrame) -> DataFrame:
    """Digests of what the stored files hold, read back from their bytes, and their timed frames.

    feature: pixels by colour over all canvases (colour:pixels of those that occur), the
    number of frames and their time. frames: start_ms, delay_ms and histogram of each.
    """
    small_batches(stored.sparkSession)
    frame = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))])
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "frames": pa.list_(frame)}
    schema = pa.schema(list(names.items()))

    def read(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in names}
        for doc_id, n_bytes, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            width, height, got = parse(data)
            payload = b"".join(f.samples.tobytes() for f in got)
            shown = list(timed(width, height, got))
            counts = sum(h for _, _, h in shown)
            pixels = ",".join(f"{k}:{counts[k]}" for k in np.flatnonzero(counts))
            feature = f"{pixels};frames={len(got)};ms={sum(d for _, d, _ in shown)}"
            each = [{"start_ms": s, "delay_ms": d, "histogram": h.tolist()} for s, d, h in shown]
            row = (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature, each)
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<start_ms:long,delay_ms:long,histogram:array<long>>>"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(per_batch(read, schema), ddl)
