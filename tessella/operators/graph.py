"""Co-occurrence of labels, its normal forms, and propagation of labels along similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.base import label_counts, pair_counts
from tessella.plans.scratch import Scratch
from tessella.sources.model import MultiLabelFrame

#: Instances that a task of ``propagate`` holds, and those that it takes at a time; what it holds of labels is dense for the latter only.
BLOCK_ROWS, STRIP = 100_000, 128


def cooccurrence(d: MultiLabelFrame) -> DataFrame:
    """edges(a, b, w): instances with both labels, in both directions and on the diagonal."""
    half = pair_counts(d).select("a", "b", F.col("n11").alias("w"))
    turned = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    diagonal = label_counts(d).filter("c > 0").select(F.col("label_id").alias("a"), F.col("label_id").alias("b"), F.col("c").alias("w"))
    return half.unionByName(turned).unionByName(diagonal)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matrix product of (a, b, w) and (a, b, w): both are joined on the inner index and summed."""
    inner = left.select("a", F.col("b").alias("_k"), F.col("w").alias("_u")).join(right.select(F.col("a").alias("_k"), "b", F.col("w").alias("_v")), "_k")
    return inner.groupBy("a", "b").agg(F.sum(F.col("_u") * F.col("_v")).alias("w"))


def normalized_laplacian(edges: DataFrame, sigma: float = 2.0, return_adj: bool = False, norm_adj: bool = False) -> DataFrame:
    """(a, b, w) without its diagonal, as it is, normalised by degrees, or as the normalised Laplacian over sigma squared.

    ``sigma`` only scales the Laplacian. Nodes without edges have no entries.
    """
    sigma = 2.0 if sigma < 0 else sigma
    off = edges.filter("a <> b")
    if return_adj and not norm_adj:
        return off.select("a", "b", F.col("w").cast("double").alias("w"))
    degree = off.groupBy("a").agg(F.sum("w").cast("double").alias("d")).filter("d > 0")
    both = off.join(degree.withColumnRenamed("d", "da"), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    scaled = both.select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))
    if return_adj:
        return scaled
    scale = 1 / sigma**2
    diagonal = degree.select("a", F.col("a").alias("b"), F.lit(scale).alias("w"))
    return scaled.select("a", "b", (-scale * F.col("w")).alias("w")).unionByName(diagonal)


def upper_triangle(edges: DataFrame) -> DataFrame:
    return edges.filter("a <= b")


def unit_rows(x: DataFrame, names: list[str], *more: str) -> DataFrame:
    """(instance_id, u), and columns ``more``: rows scaled to length 1; a row of zeros stays."""
    v = F.array(*[F.col(c).cast("double") for c in names])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return x.select("instance_id", F.transform(v, lambda e: F.coalesce(F.try_divide(e, norm), F.lit(0.0))).alias("u"), *more)


def cosine_pairs(x: DataFrame, names: list[str], blocks: int = 16, rows: int = 4096) -> DataFrame:
    """(a, b, w) of all a <= b. The result is quadratic by definition.

    Rows are dealt to ``blocks`` blocks, or more where those would be beyond ``rows`` rows.
    Two blocks meet in one task, once, and are multiplied as matrices, a few rows of the
    one with all of the other at a time; so a task holds two blocks and a strip of the
    result however many rows there are.
    """
    blocks = max(blocks, -(-x.count() // rows))
    unit = unit_rows(x, names).filter("instance_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("instance_id"), F.lit(blocks)).cast("int"))
    # A block meets those before it as ``q`` and itself and those after it as ``p``; its rows go once to each meeting.
    meetings = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q")))
    dealt = unit.withColumn("m", F.explode(meetings)).select("m.p", "m.q", "block", "instance_id", "u")
    strip, width = max(1, (1 << 19) // rows), len(names)
    integral = x.schema["instance_id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)).combine_chunks()
        p, q = found["p"][0].as_py(), found["q"][0].as_py()
        block, ids = found["block"].to_numpy(), found["instance_id"].to_numpy()
        u = found["u"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        b, ub = ids[right], u[right].T.copy()
        for lo in range(0, len(left), strip):
            at = left[lo : lo + strip]
            w, a = u[at] @ ub, ids[at][:, None]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if p == q:
                once = a <= b
                low, high, w = low[once], high[once], w[once]
            yield pa.RecordBatch.from_arrays([pa.array(low.ravel()), pa.array(high.ravel()), pa.array(w.ravel())], names=["a", "b", "w"])

    return dealt.groupBy("p", "q").applyInArrow(meet, f"a {integral}, b {integral}, w double")


def propagate(d: MultiLabelFrame, alpha: float = 0.2, epochs: int = 3) -> DataFrame:
    """(instance_id, label_id, value): labels spread along cosine similarity, from later instances to earlier ones.

    Each epoch sets D to ``alpha P D + (1 - alpha) y``, where P is the upper triangle of
    the similarity without its diagonal, normalised by degrees; rows whose degree isn't
    positive get nothing. P is never made: its row times D is the row's unit vector times
    the sum, over later instances, of unit vectors times D. Going from the last instance
    to the first, an instance needs one such sum for each epoch, so one sweep does all
    epochs. A block of instances changes the sums that come to it by a linear map, which
    a first sweep finds for all blocks at once; a second one starts each block with its
    sums. So the work is two passes, however many epochs, and linear in the instances.
    Instances without a feature or label value carry zeros.
    """
    d = d.hold()
    names, labels = d.feature_names(), [r["label_id"] for r in d.labels.select("label_id").orderBy("label_id").collect()]
    scratch = Scratch(d.spark, "propagate")
    width, many, known = len(names), len(labels), np.array(labels, dtype=np.int64)
    rows = d.held.filter("described").select("instance_id", "has", *[F.col(f"x_{c}").alias(c) for c in names])
    parts = max(int(d.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))
    rows = unit_rows(rows, names, "has").repartitionByRange(parts, "instance_id").withColumn("block", F.spark_partition_id())
    rows = scratch.table(rows, "rows")
    total = np.array([float(v or 0.0) for v in rows.agg(*[F.sum(F.get("u", F.lit(k))) for k in range(width)]).first()])

    def sweep(found: pa.Table, sums: list[np.ndarray]):
        """Ids and values of the last epoch, a few instances at a time, from the last on. ``sums``, one for each epoch, go on to the block before."""
        found = found.sort_by("instance_id").combine_chunks()
        u, has = found["u"].combine_chunks().flatten().to_numpy().reshape(-1, width), found["has"].combine_chunks()
        degree = u @ total - (u * u).sum(1)
        v = u * np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)[:, None]
        places = np.searchsorted(known, ones := has.flatten().to_numpy())
        places = np.where(known[np.minimum(places, many - 1)] == ones, places, -1) if many else places
        ends = np.concatenate([[0], np.cumsum(has.value_lengths().fill_null(0).to_numpy())])
        for lo in range((len(v) - 1) // STRIP * STRIP, -1, -STRIP):
            vs = v[lo : lo + STRIP]
            at, owners = places[ends[lo] : ends[lo + len(vs)]], np.repeat(np.arange(len(vs)), np.diff(ends[lo : lo + len(vs) + 1]))
            y = np.zeros((len(vs), sums[0].shape[1]))
            y[owners[at >= 0], at[at >= 0]] = 1
            near, now = np.triu(vs @ vs.T, 1), y
            for s in sums:
                after = alpha * (vs @ s + near @ now) + (1 - alpha) * y
                s += vs.T @ now
                now = after
            yield found["instance_id"].slice(lo, len(vs)), now

    def change(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        # Beside the labels, a unit for each feature comes in with the first epoch's sum: what becomes of it is the map.
        sums = [np.zeros((width, many + width)) for _ in range(epochs)]
        sums[0][:, many:] = np.eye(width)
        for _ in sweep(found, sums):
            pass
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([np.stack(sums).ravel()], pa.list_(pa.float64()))})

    def values(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [s.copy() for s in coming[key[0].as_py()]]
        for ids, now in sweep(pa.Table.from_batches(list(batches)), sums):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(now) + 1) * many, pa.int32()), pa.array(now.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([ids.combine_chunks(), lists], names=["instance_id", "d"])

    coming, sums = {}, np.zeros((epochs, width, many))
    maps = {r["block"]: np.array(r["s"]).reshape(epochs, width, many + width) for r in rows.groupBy("block").applyInArrow(change, "block int, s array<double>").collect()}
    for block in sorted(maps, reverse=True):
        coming[block], own, turn = sums, maps[block][:, :, :many], maps[block][:, :, many:]
        sums = np.stack([own[e] + sum(turn[e - k] @ sums[k] for k in range(e + 1)) for e in range(epochs)])
    found = rows.groupBy("block").applyInArrow(values, f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, d array<double>")
    cells = F.arrays_zip(F.array(*map(F.lit, labels)).alias("label_id"), F.col("d").alias("value"))
    return found.select("instance_id", F.explode(cells).alias("c")).select("instance_id", "c.label_id", "c.value")
