"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with the same set of word shingles are one class. A class's signature gives
``TREES`` labels: sequences of MinHash values in orders of their own. Classes whose
labels in a tree share their first ``DEPTH`` values are in one region of it.

First, in each region all are compared with its least member, which joins large groups
of copies by few links. Where a region still holds several groups, the forest goes
deeper, by the lengths in ``DEEPER``, until prefixes part the groups: in each tree, every
class is compared with the neighbour of another group that it has the longest prefix in
common with, the first or last there in an order of the tree's own.

What is still apart in a region after that is compared whole: the members of a region
that are not of its largest group are laid out in blocks, and meet the blocks of all its
members; a task holds two blocks and tells only which groups come near each other by
their signatures. Groups that are near each other, in whatever region, form a cluster,
and the clusters' members are compared in blocks in the same way, now on their full
shingle sets, until each block's groups are one or proven apart. No pairs are listed, no
group is gathered in one task, and no candidate is dropped for their number: the
components are those of all pairs that share a region. The work of this last step grows
with the members outside a region's largest group times its members, but only where
these are near the threshold of each other without being linked.

The number of trees and their depth follow from the threshold: a pair at it shares a
region of some tree but for odds of 1 in a million (``MISSED``). Candidates pass an
exact test of set sizes and a test of signatures, six deviations below what a true pair
has; what is left is confirmed on the sets of both texts. Groups are the connected
components of the links.

Cases: null and empty texts, and texts of blanks, have no shingles and are linked with
nothing; texts with fewer words than a shingle have one, of all their words; equal texts
are one class whatever their number; rows of a null id join groups but name none; rows
with one id and different texts are different documents; texts are read whole; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, per_batch, small_batches, written
from weft.llm.components import components

VALUES = 128
#: Odds that a pair at the threshold shares no region.
MISSED = 1e-6
#: Trees beyond which a shorter prefix is taken.
MOST_TREES = 40
#: Prefix lengths of dense regions, beyond the least.
DEEPER = (6, 8, 10, 13, 17, 24)
#: Classes of a block: by their signatures, and by their texts.
SIGNED_BLOCK, TEXT_BLOCK = 256, 256
#: Ids that may be broadcast, 8 bytes each.
MOST_BROADCAST = 500_000

_RANDOM = np.random.RandomState(20_240_607)
_A = (_RANDOM.randint(1, 1 << 31, VALUES, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
_B = _RANDOM.randint(0, 1 << 32, VALUES, dtype=np.int64).astype(np.uint32)[:, None]
_ORDERS_SEED = 20_240_608
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Forest:
    """How many trees there are, how deep regions begin, and what signatures of linked classes have in common at least."""

    percent: int
    depth: int
    trees: int
    least_equal: int
    least_nibbles: int

    @classmethod
    def of(cls, percent: int) -> Forest:
        p = min(max(percent / 100, 0.01), 0.999)

        def trees(depth: int) -> int:
            return math.ceil(math.log(MISSED) / math.log1p(-(p**depth)))

        def least(share: float) -> int:
            return max(0, math.floor(VALUES * share - 6 * math.sqrt(VALUES * share * (1 - share))))

        depth = max([2, *(d for d in range(2, min(DEEPER)) if trees(d) <= MOST_TREES)])
        return cls(percent, depth, trees(depth), least(p), least(p + (1 - p) / 16))

    @property
    def depths(self) -> tuple[int, ...]:
        return (self.depth, *DEEPER)

    def orders(self) -> np.ndarray:
        """Which values of a signature make each tree's label, in order."""
        return _orders(self.trees)


@lru_cache(maxsize=8)
def _orders(trees: int) -> np.ndarray:
    random = np.random.RandomState(_ORDERS_SEED)
    return np.array([random.permutation(VALUES)[: max(DEEPER)] for _ in range(trees)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[2]
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh64_intdigest(word)
        if len(self) < 60_000:
            self[word] = got
        return got


_words = _Words()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Letters A-Z count as a-z, words end at ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(len(h), size)):
        out = _mix(out * _K[0] + h[k : k + n] * _K[1])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16 low bits of each least value, of VALUES orders of the shingles."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(VALUES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[at : at + 2048] * _A + _B).min(axis=1))
    return _mix(least.astype(np.uint64)).astype(np.uint16)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    import xxhash

    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("more", pa.int64()), ("sig", pa.binary()), ("short", pa.binary())])

    def read(batch: pa.RecordBatch) -> dict:
        n, node, more, sig, short = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            shingles = shingle_set(text, size)
            n.append(len(shingles))
            if len(shingles):
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                node.append(int.from_bytes(digest[:8], "big", signed=True))
                more.append(int.from_bytes(digest[8:], "big", signed=True))
                made = signature(shingles)
                sig.append(made.tobytes())
                short.append(nibbles(made[None, :]).tobytes())
            else:
                for x in (node, more, sig, short):
                    x.append(None)
        return {"key": batch.column(0), "doc_id": batch.column(1), "n": n, "node": node, "more": more, "sig": sig, "short": short}

    return docs.select("key", "doc_id", "text").mapInArrow(per_batch(read, schema), "key long, doc_id long, n long, node long, more long, sig binary, short binary")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint16).reshape(-1, VALUES)


def nibbles(sigs: np.ndarray) -> np.ndarray:
    """Four bits of each value of the signatures, two values a byte."""
    low = (sigs & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def _prefix_keys(sigs: np.ndarray, trees: np.ndarray, depths: tuple[int, ...], orders: np.ndarray) -> list[np.ndarray]:
    """Keys of each row's label in its tree, cut at the depths."""
    key = _mix(trees.astype(np.uint64) + _K[1])
    out, rows = [], np.arange(len(sigs))
    for d in range(max(depths)):
        key = _mix(key * _K[0] + sigs[rows, orders[trees, d]].astype(np.uint64))
        if d + 1 in depths:
            out.append(_mix(key + np.uint64(d)))
    return out


def _regions(classes: DataFrame, forest: Forest) -> DataFrame:
    """(region, tree, node) of every class in every tree."""
    schema = pa.schema([("region", pa.int64()), ("tree", pa.int16()), ("node", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, sigs = batch.column(0).to_numpy(), _matrix(batch.column(1))
                trees = np.repeat(np.arange(forest.trees), len(nodes))
                keys = _prefix_keys(np.tile(sigs, (forest.trees, 1)), trees, (forest.depth,), forest.orders())[0]
                yield pa.RecordBatch.from_pydict({"region": _signed(keys), "tree": trees.astype(np.int16), "node": np.tile(nodes, forest.trees)}, schema=schema)

    return classes.select("node", "sig").mapInArrow(read, "region long, tree short, node long")


def _deeper(members: DataFrame, forest: Forest) -> DataFrame:
    """(region, tree, depth, node, component, turn): the prefixes of each member at every depth; turn: its place in the tree's own order."""
    kinds = {"region": pa.int64(), "tree": pa.int16(), "depth": pa.int16(), "node": pa.int64(), "component": pa.int64(), "turn": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                trees, nodes, comps = (batch.column(i).to_numpy() for i in range(3))
                turn = _signed(_mix(nodes.view(np.uint64) + _mix(trees.astype(np.uint64) + _K[2])))
                keys = _prefix_keys(_matrix(batch.column(3)), trees.astype(np.int64), forest.depths, forest.orders())
                for depth, regions in zip(forest.depths, keys):
                    yield pa.RecordBatch.from_pydict({"region": _signed(regions), "tree": trees, "depth": np.full(len(nodes), depth, np.int16), "node": nodes, "component": comps, "turn": turn}, schema=schema)

    return members.select("tree", "node", "component", "sig").mapInArrow(read, "region long, tree short, depth short, node long, component long, turn long")


def _neighbours(deep: DataFrame) -> DataFrame:
    """(u, v): in each tree, every class and the neighbour of another group at its greatest depth with one."""
    who = F.struct("turn", "node", "component")
    stars = deep.groupBy("region").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("region", "lo", "hi")
    met = deep.join(cut(stars), "region")
    end = F.when(F.col("lo.component") != F.col("component"), F.col("lo.node")).when(F.col("hi.component") != F.col("component"), F.col("hi.node"))
    nearest = met.select("tree", "node", "depth", end.alias("end")).where("end IS NOT NULL").groupBy("tree", "node").agg(F.max_by("end", "depth").alias("end"))
    return nearest.select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v")).distinct()


def _alike(pairs: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """Pairs that pass the tests of sizes and signatures."""
    side = classes.select("node", "n", "sig")
    a, b = (side.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "uv")
    fits = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * forest.percent
    both = pairs.join(a, "u").join(b, "v").where(fits).select("u", "v", "su", "sv")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1) >= forest.least_equal
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(equal)) for i in (0, 1)], schema=schema)

    return both.mapInArrow(read, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection size >= percent * union size."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of classes, by their least document."""
    wanted = cut(nodes.join(classes.select("node", F.col("key")), "node"))
    few = wanted.count() <= MOST_BROADCAST
    texts = docs.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key").select("node", "text").dropDuplicates(["node"])
    return cut(texts)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are as similar as asked for."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    texts = _texts(nodes, classes, docs)
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "tu", "tv")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: str) -> np.ndarray:
            if (got := lately.get(node)) is None:
                got = lately[node] = shingle_set(text, size)
                if len(lately) > 16:
                    lately.popitem(last=False)
            else:
                lately.move_to_end(node)
            return got

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            found = [(u, v) for u, v, tu, tv in rows if similar(of(u, tu), of(v, tv), percent)]
            if found:
                yield pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]}, schema=schema)

    return cut(both.mapInArrow(read, "u long, v long"))


class _Groups:
    """Which groups have become one; a group is named by its least member."""

    def __init__(self) -> None:
        self.of: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.of.get(x, x)) != x:
            self.of[x] = x = self.of.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.of[y] = x


def _blocks(members: DataFrame, key: str, block: int) -> DataFrame:
    """Deals the members (key, node, component) of each key that has several components into pairs of blocks.

    Members of the key's largest component have blocks of their own, which meet only
    those of the rest. Adds i and j, the pair of blocks, and own, the member's block.
    """
    sizes = members.groupBy(key, "component").agg(F.count("*").alias("m"))
    by_key = sizes.groupBy(key).agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.sum("m").alias("all"), F.max("m").alias("most"))
    mixed = cut(by_key.where("all > most").select(key, "largest", F.ceil((F.col("all") - F.col("most")) / block).alias("rest"), F.ceil(F.col("most") / block).alias("main"), (F.col("all") <= block).alias("one")))
    at = F.xxhash64("node", F.lit(5))
    own = F.when(F.col("one"), 0).when(F.col("component") == F.col("largest"), F.col("rest") + F.pmod(at, "main")).otherwise(F.pmod(at, "rest"))
    placed = members.join(mixed, key).withColumn("own", own.cast("int"))

    def pair(other: Column) -> Column:
        return F.struct(F.least("own", other).cast("int").alias("i"), F.greatest("own", other).cast("int").alias("j"))

    last = F.when(F.col("own") >= F.col("rest"), F.col("rest")).otherwise(F.col("rest") + F.col("main")) - 1
    meets = F.when(F.col("one"), F.array(pair(F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), last.cast("int")), pair))
    return placed.withColumn("block", F.explode(meets)).select(key, "block.i", "block.j", "own", "node", "component")


def _apart(own: np.ndarray, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member with the members that it is to meet: all after it in one block, or those of the other block."""
    if i == j:
        for a in range(len(own) - 1):
            yield a, np.arange(a + 1, len(own))
    else:
        there = np.flatnonzero(own == j)
        for a in np.flatnonzero(own == i):
            yield int(a), there


class _Fits:
    """Which classes may be linked to one, by their sizes and four bits of each signature value."""

    def __init__(self, n: np.ndarray, short: list[bytes], forest: Forest) -> None:
        packed = np.frombuffer(b"".join(short), dtype=np.uint8).reshape(-1, VALUES // 2)
        self.n, self.values, self.forest = n, np.concatenate([packed >> 4, packed & 15], axis=1), forest

    def __call__(self, a: int, others: np.ndarray) -> np.ndarray:
        n = self.n[others]
        others = others[np.minimum(n, self.n[a]) * 100 >= np.maximum(n, self.n[a]) * self.forest.percent]
        return others[(self.values[others] == self.values[a]).sum(axis=1) >= self.forest.least_nibbles]


def _near_groups(members: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """(node, component, label) of classes near another group in their region; near groups of a block have one label."""
    signed = _blocks(members, "region", SIGNED_BLOCK).join(classes.select("node", "n", "short"), "node")
    dealt = signed.groupBy("region", "i", "j").agg(F.collect_list(F.struct("own", "node", "component", "n", "short")).alias("rows"))
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("label", pa.int64())])

    def near(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        for k in range(batch.num_rows):
            rows = batch.column(2)[k].values
            own, nodes, comps, n = (rows.field(c).to_numpy() for c in ("own", "node", "component", "n"))
            fits, groups, active = _Fits(n, rows.field("short").to_pylist(), forest), _Groups(), np.zeros(len(n), dtype=bool)
            for a, others in _apart(own, batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                met = fits(a, others[comps[others] != comps[a]])
                if len(met):
                    active[a] = active[met] = True
                    for c in set(comps[met].tolist()):
                        groups.join(int(comps[a]), c)
            for a in np.flatnonzero(active):
                out["node"].append(int(nodes[a]))
                out["component"].append(int(comps[a]))
                out["label"].append(groups.find(int(comps[a])))
        return out

    return dealt.select("i", "j", "rows").mapInArrow(per_batch(near, schema), "node long, component long, label long")


def _links_within(clusters: DataFrame, classes: DataFrame, docs: DataFrame, size: int, forest: Forest) -> DataFrame:
    """Links that join the groups of each cluster (cluster, node, component), as far as the full sets have them."""
    texts = _texts(clusters.select("node").distinct(), classes, docs).join(classes.select("node", "n", "short"), "node")
    dealt = _blocks(clusters, "cluster", TEXT_BLOCK).join(cut(texts), "node")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own, nodes, comps, n = (rows.column(c).to_numpy() for c in ("own", "node", "component", "n"))
        sets = [shingle_set(t, size) for t in rows.column("text").to_pylist()]
        fits, groups, links = _Fits(n, rows.column("short").to_pylist(), forest), _Groups(), []
        for a, others in _apart(own, key[1].as_py(), key[2].as_py()):
            for b in fits(a, others[comps[others] != comps[a]]).tolist():
                if groups.find(int(comps[a])) != groups.find(int(comps[b])) and similar(sets[a], sets[b], forest.percent):
                    groups.join(int(comps[a]), int(comps[b]))
                    links.append((int(nodes[a]), int(nodes[b])))
        return pa.Table.from_pydict({"u": [u for u, _ in links], "v": [v for _, v in links]}, schema=schema)

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "u long, v long")


def keyed(docs: DataFrame) -> DataFrame:
    """key (of id and text), doc_id and text of each row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("key"), "doc_id", "text")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Per row: key, doc_id, n_shingles, component_id (least id of its group, itself included) and kept."""
    small_batches(docs.sparkSession)
    forest = Forest.of(percent)
    docs = keyed(docs)
    rows = written(_signatures(docs, size))
    by_class = rows.where("n > 0").groupBy("node", "more").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short"))
    classes = cut(by_class.drop("more"))

    regions = _regions(classes, forest)
    # cut, so that the join has its own exchange on either side and can split a very large region
    shared = cut(regions.groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1"))
    members = cut(regions.join(shared, "region"))
    pairs = members.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    links = _confirmed(_alike(pairs, classes, forest), classes, docs, size, percent)
    groups = components(links)

    def still_open(groups: DataFrame) -> DataFrame:
        """Members, with their components, of the regions in which a pair may not have met."""
        found = members.where("size > 2").select("region", "tree", "node").join(groups, "node", "left")
        return found.withColumn("component", F.coalesce("component", "node"))

    def with_links(groups: DataFrame, links: DataFrame) -> DataFrame:
        return groups if links.isEmpty() else components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))

    open_members = still_open(groups)
    several = open_members.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("region")
    spread = open_members.join(several, "region", "left_semi").select("tree", "node", "component")
    deep = cut(_deeper(spread.join(classes.select("node", "sig"), "node"), forest))
    fresh = _neighbours(deep).join(pairs.select("u", "v"), ["u", "v"], "left_anti")
    groups = with_links(groups, _confirmed(_alike(fresh, classes, forest), classes, docs, size, percent))

    near = cut(_near_groups(still_open(groups).select("region", "node", "component"), classes, forest))
    named = components(near.select(F.col("component").alias("u"), F.col("label").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    clusters = cut(near.select("node", "component").distinct().join(named, "component"))
    groups = with_links(groups, cut(_links_within(clusters, classes, docs, size, forest)))

    named = groups.join(classes.select("node", "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = named.join(names, "component").select("node", "component_id")
    of_class = classes.select("node", "least").join(joined, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("key", "doc_id", F.col("n").alias("n_shingles"), "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("key", "doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, less those that aren't the first of their group."""
    found = cut(near_duplicates(docs, size, percent).where(~F.col("kept")).select("key").distinct())
    away = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    held = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).alias("key"))
    return held.join(away, "key", "left_anti").select("doc.*")
