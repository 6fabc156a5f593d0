"""Randomness that depends on a seed, a tag and an id alone: the same in any plan and on any rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def key(seed: int, tag: str, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[i.cast("string") for i in ids]))


def u01(seed: int, tag: str, *ids: Column) -> Column:
    """A number in [0, 1): the first eight digits of the key."""
    return F.conv(F.substring(key(seed, tag, *ids), 1, 8), 16, 10).cast("double") / float(2**32)


def shuffled(df: DataFrame, id_col: str, seed: int, tag: str = "shuffle") -> DataFrame:
    """Rows with ``shuffle_key``; sorting by it (then by id) is a random order. Nothing is sorted here."""
    return df.withColumn("shuffle_key", key(seed, tag, F.col(id_col)))


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``position``, 0 to n-1 in order of id.

    Ids are dealt by ranges and numbered within each; the rows before a range are a
    running sum over ranges, one row each.
    """
    from tessella.plans.scratch import Scratch

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, id_col).withColumn("_part", F.spark_partition_id())
    dealt = Scratch(df.sparkSession, "numbered").table(dealt, "dealt")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(id_col)) - 1
    joined = dealt.withColumn("_at", within).join(counts.withColumn("_before", before), "_part")
    return joined.withColumn("position", F.col("_before") + F.col("_at")).drop("_part", "_n", "_before", "_at")


def bootstrap(spark: SparkSession, ids: DataFrame, id_col: str, draws: int, seed: int) -> DataFrame:
    """``draws`` draws with replacement: (draw, id_col)."""
    at = numbered(ids.select(id_col), id_col)
    n = at.count()
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.floor(u01(seed, "bootstrap", F.col("id")) * n).cast("long").alias("position"))
    return picks.join(at, "position").select("draw", id_col)


def sample(df: DataFrame, id_col: str, k: int, seed: int, tag: str = "sample") -> DataFrame:
    """k rows without replacement, all equally likely."""
    return df.orderBy(key(seed, tag, F.col(id_col)), id_col).limit(k)


def weighted_sample(df: DataFrame, id_col: str, weight: Column, k: int, seed: int, tag: str = "weighted") -> DataFrame:
    """k rows without replacement, drawn in turn with chances by weight: the smallest exponential clocks."""
    u = (u01(seed, tag, F.col(id_col)) * (2**32) + 1) / float(2**32 + 1)
    clock = F.round(F.try_divide(-F.ln(u), weight), 9)
    return df.withColumn("clock", clock).filter(F.col("clock").isNotNull()).orderBy("clock", id_col).limit(k)
