"""Near-duplicates by min-max hashing, with every link confirmed on the full shingle sets.

Each permutation gives two signature values, the smallest and the largest image of
the set, so 64 permutations make 128 values: 32 bands of 4. A pair at similarity 0.8
shares no band with probability (1 - 0.8**4)**32, under 5e-8.

How hot groups are kept from growing quadratically:

* documents with the same set are one class, found by the set's digest; only one
  document of each class goes on;
* a bucket has a centre: the member that shares most bands with most documents. Its
  members are tested against the centre alone, after a look at sketches, two bits of
  every signature value; those linked get a common root;
* only members that the centre's root didn't take are left to compare with the others of
  the centre's buckets. Those outside are cut into blocks by the bytes of their sets; a
  block's sets are put into inverted lists, and the other members pass by one after the
  other, so a task holds a block and one set more however large the group. A set is sent
  once for each block, not for each pair, and what comes back is a forest: a link is
  returned only if it joins what the task had not joined before. Every pair that shares
  a bucket is then confirmed, refuted or known to be connected;
* roots are found by contracting the link graph in written tables. Nothing of it
  reaches the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, ship

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Words of a shingle, where nothing else is asked for.
WIDTH = 5
#: Bytes of sets and documents of a block of those outside, and documents that pass by in one task.
BLOCK_BYTES, BLOCK, AGAINST = 4 * 2**20, 1024, 4096
#: Two bits of each signature value, 32 values to a long, and how many values may differ in them. At similarity 0.8
#: 19 of 128 differ on average, with a deviation of 4: more than 42 with a probability near 1e-8.
SKETCH = 2 * PERMUTATIONS // 32
DIFFERENT = 42
#: Words remembered by a Python worker, so that a frequent word is hashed once.
WORD_CACHE = 200_000

_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _STEPS = _mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * _G)
_A, _B = _STEPS[:PERMUTATIONS] | np.uint64(1), _STEPS[PERMUTATIONS:]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of a shorter text the whole sequence is the only one."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.array(list(map(_words.__getitem__, words)), np.uint64)
    take = min(width, len(one))
    got = np.full(len(one) - take + 1, np.uint64(take), np.uint64)
    for k in range(take):
        got = _mix(got * _G + one[k : len(one) - take + 1 + k])
    return np.unique(got)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, each a hash of the minimum and maximum under two permutations and of the band's number; and the sketch."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        images = _A[:, None] * shingles[None, at : at + 4096] + _B[:, None]
        low, high = np.minimum(low, images.min(axis=1)), np.maximum(high, images.max(axis=1))
    rows = np.stack([low, high], axis=1).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * _G + rows[:, k])
    bits = (_mix(rows.ravel()) & np.uint64(3)).reshape(SKETCH, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return key, np.bitwise_or.reduce(bits, axis=1)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch); the last three are null for an empty set."""

    def run(batches):
        for batch in batches:
            n, ids, bands, sketches = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(text, width)
                n.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys, sketch = (x.view(np.int64) for x in signature(found)) if len(found) else (None, None)
                bands.append(keys)
                sketches.append(sketch)
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "bands", "sketch"])

    return _picked(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(cid, shingles) of every row."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t, width).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cid", "shingles"])

    return _picked(docs).mapInArrow(run, "cid long, shingles array<long>")


def _picked(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def different(a: str, b: str) -> Column:
    """Values that differ in two sketches, whose longs are the columns a0, a1, ... and b0, b1, ..."""
    found = F.lit(0)
    for k in range(SKETCH):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        found = found + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return found


def linked(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that isn't its own root; root: the smallest node reachable.

    Each step points every node at its smallest smaller neighbour, shortens the
    pointers to their ends by doubling, and goes on with the edges between the ends.
    """
    roots, left = None, scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    while not left.isEmpty():
        up = scratch.table(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "up")
        up = flatten(up, scratch)
        further = up.select(F.col("node").alias("from"), F.col("root").alias("to"))
        step = left.join(further.withColumnsRenamed({"from": "a", "to": "ra"}), "a", "left").join(further.withColumnsRenamed({"from": "b", "to": "rb"}), "b", "left")
        step = step.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
        left = scratch.table(step.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        roots = up if roots is None else merge_roots(roots, up, scratch)
    return roots if roots is not None else scratch.table(left.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")


def flatten(up: DataFrame, scratch: Scratch) -> DataFrame:
    """Replace each pointer's end by the end's own pointer until none has one."""
    while True:
        end = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = scratch.table(up.join(end, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        up = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return up


def merge_roots(roots: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """``more`` maps some roots, and nodes that had none, further; both have no chains."""
    end = more.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = roots.join(end, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.table(moved.unionByName(more), "roots")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if ``100 * intersection >= percent * union`` of their
    sets; component_id is the smallest doc_id reachable. A null or blank text has an
    empty set and is linked with nothing. Rows that repeat a doc_id are one node: they
    share links and verdict. A row with a null doc_id keeps a null component_id and is
    kept. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    signed = scratch.table(signatures(docs, width), "signed")
    known = signed.filter("doc_id IS NOT NULL AND set_id IS NOT NULL")

    # One document for each distinct set; its links are those of all its copies.
    classes = scratch.table(known.groupBy("set_id").agg(F.min("doc_id").alias("cid")), "classes")
    first = known.select("set_id", F.col("doc_id").alias("cid"), "n_shingles", "bands", "sketch").join(classes, ["set_id", "cid"], "left_semi")
    first = scratch.table(first, "first")
    members = first.select("cid", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("key")
    shared = scratch.table(shared, "shared")
    open_ = scratch.table(members.join(shared, "key").distinct(), "members")
    sketches = first.select("cid", "n_shingles", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]).dropDuplicates(["cid"])
    sketches = scratch.table(sketches, "sketches")

    # Whoever shares many bands with many is near the middle of its group, and a good centre for all of its buckets.
    counts = scratch.table(open_.groupBy("key").agg(F.count("*").alias("n")), "counts")
    middle = scratch.table(open_.join(counts, "key").groupBy("cid").agg(F.sum("n").alias("middle")), "middle")
    open_ = scratch.table(open_.join(middle, "cid"), "members")

    wanted = scratch.table(open_.select("cid").distinct(), "wanted")
    again = docs.join(wanted, docs["doc_id"] == wanted["cid"], "left_semi")
    texts = scratch.table(sets(again, width).distinct(), "sets")

    # Rows that repeat a doc_id with another text: the id links their classes.
    twice = known.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo <> hi").select("doc_id")
    twice = known.select("doc_id", "set_id").join(scratch.table(twice, "twice"), "doc_id", "left_semi")
    roots = contract(twice.join(classes, "set_id").select(F.col("cid").alias("a"), F.col("doc_id").alias("b")), scratch)

    # Each bucket's centre, and the centre's members over all its buckets.
    best = F.max(F.struct("middle", (-F.col("cid")).alias("cid")))["cid"]
    centers = scratch.table(open_.groupBy("key").agg((-best).alias("center")), "centers")
    own = sketches.withColumnsRenamed({"cid": "center", "n_shingles": "center_n"} | {f"s{k}": f"t{k}" for k in range(SKETCH)})
    crowd = scratch.table(open_.select("key", "cid").join(centers, "key").filter("cid <> center").select("center", "cid").distinct(), "crowd")

    near = crowd.join(sketches, "cid").join(own, "center")
    sizes = 100 * F.least("n_shingles", "center_n") >= percent * F.greatest("n_shingles", "center_n")
    tests = scratch.table(near.filter(sizes & (different("s", "t") <= DIFFERENT)).select("center", "cid"), "tests")
    with_center = tests.join(texts.select(F.col("cid").alias("center"), F.col("shingles").alias("sa")), "center")
    links = with_center.join(texts.select("cid", F.col("shingles").alias("sb")), "cid").filter(linked(F.col("sa"), F.col("sb"), percent))
    roots = _linked_roots(roots, links.select(F.col("center").alias("a"), F.col("cid").alias("b")), scratch)

    # Members outside their centre's root, against all members of the centre.
    placed = _with_roots(_with_roots(crowd, roots).select(F.col("center").alias("cid"), F.col("cid").alias("member"), F.col("root").alias("member_root")), roots)
    placed = placed.select(F.col("cid").alias("center"), F.col("member").alias("cid"), (F.col("root") != F.col("member_root")).alias("outside"))
    placed = scratch.table(placed.join(sketches.select("cid", "n_shingles"), "cid"), "placed")
    heavy = F.sum(F.when(F.col("outside"), 8 * F.col("n_shingles")))
    parts = placed.groupBy("center").agg(F.count("*").alias("n"), F.count_if("outside").alias("out"), heavy.alias("bytes")).filter("out > 0 AND n > 1")
    blocks = F.ceil(F.greatest(F.col("out") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    parts = scratch.table(parts.select("center", blocks.alias("blocks"), F.ceil(F.col("n") / AGAINST).cast("int").alias("against")), "parts")
    spot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = placed.join(parts, "center")
    left = dealt.filter("outside").select("center", "cid", spot("blocks").alias("block"), every("against").alias("other"), F.lit(0).alias("side"))
    right = dealt.select("center", "cid", every("blocks").alias("block"), spot("against").alias("other"), F.lit(1).alias("side"))
    dealt = scratch.table(left.unionByName(right), "dealt").join(texts, "cid")
    links = _block_links(dealt, percent)
    roots = _linked_roots(roots, links, scratch)
    component = scratch.table(_with_roots(classes, roots).select("set_id", "root"), "components")
    scratch.keep(signed, component)
    return signed.join(component, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce("root", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _linked_roots(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots`` after the links (a, b) between documents."""
    links = scratch.table(links.select("a", "b"), "links")
    ends = _with_roots(links.select(F.col("a").alias("cid"), "b"), roots).select(F.col("root").alias("a"), F.col("b").alias("cid"))
    return merge_roots(roots, contract(_with_roots(ends, roots).select("a", F.col("root").alias("b")), scratch), scratch)


class Block:
    """Some sets, to be compared with others one by one: counts come from the inverted lists of the sets' values."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def linked(self, other: np.ndarray) -> list[int]:
        """Places of the block's sets that are linked with ``other``."""
        low, high = np.searchsorted(self.values, other, "left"), np.searchsorted(self.values, other, "right")
        n = high - low
        some = n > 0
        low, n = low[some], n[some]
        if not len(n):
            return []
        places = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owners[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= self.percent * (self.sizes + len(other) - both)).tolist()


class Forest(dict):
    """Which documents a task has found to be connected."""

    def end(self, a: int) -> int:
        while (up := self.get(a, a)) != a:
            self[a] = a = self.get(up, up)
        return a

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart; they aren't any more."""
        a, b = self.end(a), self.end(b)
        self[a] = b
        return a != b


def _block_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) of linked documents of (center, block, other), side 0 against side 1: as many links as connect them."""
    spark = dealt.sparkSession
    keys = ["center", "block", "other"]

    def run(batches):
        now, ids, sets_, block, forest = None, [], [], None, Forest()
        for batch in batches:
            values, ends = batch.column("shingles").flatten().to_numpy(), batch.column("shingles").value_lengths().to_numpy(zero_copy_only=False).cumsum()
            found, start = [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in (*keys, "side", "cid")), ends.tolist(), strict=True)
            for center, part, other, side, cid, end in rows:
                own, start = values[start:end], end
                if (center, part, other) != now:
                    now, ids, sets_, block, forest = (center, part, other), [], [], None, Forest()
                if side == 0:
                    ids.append(cid)
                    sets_.append(own.copy())
                elif ids:
                    if block is None:
                        block, sets_ = Block(sets_, percent), []
                    found += [(ids[i], cid) for i in block.linked(own) if forest.join(ids[i], cid)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.select(*keys, "side", "cid", "shingles").repartition(parts, *keys).sortWithinPartitions(*keys, "side")
    return sorted_.mapInArrow(run, "a long, b long")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_groups(docs, width=2)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, the one with the smallest id."""
    gone = near_groups(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(docs.sparkSession, "near").table(gone, "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
