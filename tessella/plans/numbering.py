"""Row numbers and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.scratch import Scratch


def running(df: DataFrame, group: list[str], order: list[str], sums: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row within its group, and for each of ``sums`` a column
    ``<sum>_before``: the sum over the rows of the group that come before. Without ``group``, all rows are one.

    A group may hold a third of all rows, so it isn't sorted in one task: rows are dealt
    by ranges of (group, order) and numbered within each range; what the group has in
    earlier ranges are running sums over ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    dealt = Scratch(df.sparkSession, "running").table(dealt, "dealt")
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_n_{s}") for s in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    counts = counts.select(*group, "_part", before("_n").alias("_before"), *[before(f"_n_{s}").alias(f"_before_{s}") for s in sums])
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    sooner = within.rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.select("*", F.row_number().over(within).alias("_at"), *[F.coalesce(F.sum(s).over(sooner), F.lit(0)).alias(f"_at_{s}") for s in sums])
    joined = numbered.join(counts, [*group, "_part"])
    added = [(F.col("_before") + F.col("_at")).alias(name), *[(F.col(f"_before_{s}") + F.col(f"_at_{s}")).alias(f"{s}_before") for s in sums]]
    return joined.select(*df.columns, *added)


def kth(df: DataFrame, column: str, k: int) -> tuple | None:
    """(value, less, equal) of a numeric column: its k-th smallest value, and how many rows are below it and at it; None beyond the rows.

    Rows are counted in buckets between the ends, then the bucket with the k-th in finer
    ones, so nothing is sorted or shuffled but counts, some thousand at a time. Every
    count is a pass over ``df``: give it as a written table.
    """
    c = F.col(column)
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).first()
    lo, hi, n, less = ends["lo"], ends["hi"], ends["n"], 0
    if not 1 <= k <= n:
        return None
    while lo != hi:
        if isinstance(lo, int):
            bucket = F.shiftright(c, max(0, (hi - lo).bit_length() - 10))
        else:
            bucket = F.floor((c - lo) / (hi - lo) * 1024)
        inside = df.filter(c.between(lo, hi)).groupBy(bucket.alias("b")).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"))
        for r in sorted(inside.collect(), key=lambda r: r["b"]):
            if less + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            less += r["n"]
    return lo, less, n


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row within its group."""
    return running(df, group, order, name=name)
