"""Reports that compare the complete data with the two sides of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.scratch import Scratch
from tessella.sources.model import MultiLabelFrame

#: The report's rows, in order.
PROPERTIES = (
    "Number of examples",
    "Number of labels",
    "Label cardinality",
    "Label density",
    "Distinct labels",
    "Distinct label sets",
    "Frequency of distinct label sets",
    "Mean imbalance ratio intra-class",
    "Mean imbalance ratio inter-class",
    "Mean imbalance ratio labelsets",
    "Labels in the tail",
    "Labels beyond the tail",
    "KL divergence",
)


def _both() -> Column:
    """The complete data and the row's side, if it has one."""
    return F.explode(F.array_compact(F.array(F.lit("complete"), F.col("split"))))


def _sides(frame: DataFrame, split: DataFrame) -> DataFrame:
    """Each row once for the complete data and once for its side, if it has one."""
    return frame.join(split, "instance_id", "left").withColumn("dataset", _both()).drop("split")


def label_frequency(d: MultiLabelFrame, split: DataFrame) -> DataFrame:
    """(label_id, dataset, n) of labels that occur, zeros included."""
    counts = _sides(d.y, split).groupBy("label_id", "dataset").agg(F.count("*").alias("n"))
    return _with_zeros(counts)


def _with_zeros(counts: DataFrame) -> DataFrame:
    """(label_id, dataset, n) of every label that is counted somewhere, on all sides."""
    grid = counts.select("label_id").distinct().withColumn("dataset", F.explode(F.array(*map(F.lit, ("complete", "train", "test")))))
    return grid.join(counts, ["label_id", "dataset"], "left").select("label_id", "dataset", F.coalesce("n", F.lit(0)).alias("n"))


def tails(d: MultiLabelFrame, split: DataFrame, num_tails: int = 2) -> DataFrame:
    """(dataset, tail, beyond): labels with some but at most ``num_tails`` instances, and with more."""
    f = label_frequency(d, split).filter("n > 0")
    return f.groupBy("dataset").agg(F.count_if(F.col("n") <= num_tails).alias("tail"), F.count_if(F.col("n") > num_tails).alias("beyond"))


def divergence(d: MultiLabelFrame, split: DataFrame) -> DataFrame:
    """(dataset, kl): how the side's distribution over labels diverges from the complete one, in nats."""
    return _divergence(label_frequency(d, split))


def _divergence(f: DataFrame) -> DataFrame:
    totals = f.groupBy("dataset").agg(F.sum("n").alias("total"))
    share = f.join(totals, "dataset").select("label_id", "dataset", F.try_divide("n", "total").alias("p"))
    whole = share.filter("dataset = 'complete'").select("label_id", F.col("p").alias("q"))
    rows = share.join(whole, "label_id").groupBy("dataset")
    return rows.agg(F.round(F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("q")))), F.lit(0.0)), 6).alias("kl"))


def properties(d: MultiLabelFrame, split: DataFrame, num_tails: int = 2) -> DataFrame:
    """(position, property, complete, train, test): the thirteen properties of each.

    Instances are read once and counted for the complete data and their side together.
    Labelsets are counted before anything else is derived from them.
    """
    d = d.hold()
    n_labels = F.lit(d.labels.count())
    # Equal sets on the same side are one row from here on; nothing below sees an instance.
    placed = d.held.join(split, "instance_id", "left").groupBy("has", "listed", "split").agg(F.count("*").alias("cnt"), F.min("instance_id").alias("first_seen"))
    placed = Scratch(d.spark, "report").table(placed, "placed")
    both = placed.withColumn("dataset", _both())
    ls = both.filter("listed").withColumn("labelset", F.coalesce("has", F.array().cast("array<int>"))).groupBy("dataset", "labelset").agg(F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"))
    f = both.filter("has IS NOT NULL").select("dataset", F.explode("has").alias("label_id"), "cnt").groupBy("label_id", "dataset").agg(F.sum("cnt").alias("n"))
    f = _with_zeros(f)
    sizes = ls.groupBy("dataset").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.size("labelset")).alias("ones"), F.count("*").alias("sets"))

    every = F.explode(F.array(*map(F.lit, ("complete", "train", "test"))))
    ones = ls.select("dataset", F.explode("labelset").alias("label_id"), "cnt").groupBy("dataset", "label_id").agg(F.sum("cnt").alias("c"))
    c = d.labels.select("label_id").withColumn("dataset", every).join(ones, ["dataset", "label_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    c = c.join(sizes.select("dataset", "n"), "dataset").join(c.groupBy("dataset").agg(F.max("c").alias("top")), "dataset")
    intra = F.when(F.least("c", "n") < 1, 0.0).otherwise(F.try_divide(F.greatest("c", "n"), F.least("c", "n")))
    inter = F.when(F.col("c") < 1, 0.0).otherwise(F.try_divide("top", "c"))
    of_labels = c.groupBy("dataset").agg(
        F.count_if(F.col("c") > 0).alias("distinct"), F.avg(intra).alias("intra"), F.avg(inter).alias("inter"),
        F.count_if((F.col("c") > 0) & (F.col("c") <= num_tails)).alias("tail"), F.count_if(F.col("c") > num_tails).alias("beyond"),
    )

    w = ls.withColumn("label_id", F.explode_outer("labelset")).join(c.select("dataset", "label_id", "c"), ["dataset", "label_id"], "left")
    w = w.groupBy("dataset", "labelset", "first_seen").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("w"))
    heavy = w.groupBy("dataset").agg(F.max_by("first_seen", F.struct("w", -F.col("first_seen"))).alias("seen"))
    place = w.join(heavy, "dataset").filter("first_seen < seen").groupBy("dataset").agg(F.count("*").alias("place"))
    ratio = F.when(F.col("w") <= 0, 0.0).otherwise(F.coalesce("place", F.lit(0)) / (F.col("w") / n_labels))
    of_sets = w.join(place, "dataset", "left").groupBy("dataset").agg(F.avg(ratio).alias("ir_sets"))

    wide = sizes.join(of_labels, "dataset").join(of_sets, "dataset").join(_divergence(f), "dataset")
    values = F.array(*[
        v.cast("double")
        for v in (
            F.col("n"), F.col("ones"), F.try_divide("ones", "n"), F.try_divide("ones", F.col("n") * n_labels), F.col("distinct"), F.col("sets"), F.try_divide("sets", "n"),
            F.col("intra"), F.col("inter"), F.col("ir_sets"), F.col("tail"), F.col("beyond"), F.col("kl"),
        )
    ])
    names = F.array(*map(F.lit, PROPERTIES))
    long = wide.select("dataset", F.posexplode(values).alias("position", "v")).withColumn("property", F.get(names, F.col("position")))
    return long.groupBy("position", "property").pivot("dataset", ["complete", "train", "test"]).agg(F.round(F.first("v"), 5))


def chart_rows(d: MultiLabelFrame, split: DataFrame) -> DataFrame:
    """(place, label_id, dataset, n): the bars of a chart, labels in order of their count."""
    f = label_frequency(d, split)
    order = f.filter("dataset = 'complete'").select("label_id", F.struct("n", "label_id").alias("o"))
    place = order.select("label_id", (F.row_number().over(Window.orderBy("o")) - 1).alias("place"))
    return f.join(place, "label_id").select("place", "label_id", "dataset", "n")
