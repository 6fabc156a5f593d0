"""Counts that the metrics share. Labels without instances and instances without labels are in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.model import MultiLabelFrame


def label_counts(d: MultiLabelFrame) -> DataFrame:
    """c(label_id, c)."""
    counts = d.y.groupBy("label_id").agg(F.count("*").alias("c"))
    return d.labels.select("label_id").join(counts, "label_id", "left").select("label_id", F.coalesce("c", F.lit(0)).alias("c"))


def cardinalities(d: MultiLabelFrame) -> DataFrame:
    """k(instance_id, k)."""
    counts = d.y.groupBy("instance_id").agg(F.count("*").alias("k"))
    return d.instances.join(counts, "instance_id", "left").select("instance_id", F.coalesce("k", F.lit(0)).alias("k"))


def row_labelsets(d: MultiLabelFrame) -> DataFrame:
    """(instance_id, labelset): the sorted label ids of each instance."""
    sets = d.y.groupBy("instance_id").agg(F.sort_array(F.collect_list("label_id")).alias("labelset"))
    return d.instances.join(sets, "instance_id", "left").select("instance_id", F.coalesce("labelset", F.array().cast("array<int>")).alias("labelset"))


def labelsets(d: MultiLabelFrame) -> DataFrame:
    """ls(labelset, cnt, first_seen, w): how often, its smallest instance, and the sum of its labels' counts.

    Instances are reduced to distinct sets before labels' counts are joined.
    """
    sets = row_labelsets(d).groupBy("labelset").agg(F.count("*").alias("cnt"), F.min("instance_id").alias("first_seen"))
    one = sets.withColumn("label_id", F.explode_outer("labelset")).join(label_counts(d), "label_id", "left")
    return one.groupBy("labelset", "cnt", "first_seen").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("w"))


def pair_counts(d: MultiLabelFrame) -> DataFrame:
    """(a, b, n11) of labels a < b that share an instance; equal labelsets are counted once, weighted."""
    sets = row_labelsets(d).groupBy("labelset").agg(F.count("*").alias("cnt"))
    a = sets.select("labelset", "cnt", F.posexplode("labelset").alias("at", "a"))
    b = a.withColumn("b", F.explode(F.slice("labelset", F.col("at") + 2, F.size("labelset"))))
    return b.groupBy("a", "b").agg(F.sum("cnt").alias("n11"))


def label_pairs(d: MultiLabelFrame) -> DataFrame:
    """Every pair of labels a < b with n11, c_a, c_b. L(L-1)/2 rows, of the size of the label dimension squared."""
    c = label_counts(d)
    # Every task has some of the first labels, and all labels, one row of the label dimension's size, to pair them with.
    every = c.agg(F.sort_array(F.collect_list(F.struct("label_id", "c"))).alias("all")).withColumn("_k", F.lit(0))
    parts = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
    first = c.select(F.col("label_id").alias("a"), F.col("c").alias("c_a"), F.lit(0).alias("_k")).repartitionByRange(parts, "a")
    pairs = first.join(F.broadcast(every), "_k").select("a", "c_a", F.explode(F.filter("all", lambda x: x["label_id"] > F.col("a"))).alias("y"))
    pairs = pairs.select("a", F.col("y.label_id").alias("b"), "c_a", F.col("y.c").alias("c_b"))
    return pairs.join(pair_counts(d), ["a", "b"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)))
