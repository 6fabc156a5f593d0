"""The base splitters. Each returns ``split(instance_id, split)`` with 'train' and 'test'."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.rand import key, u01
from tessella.operators.base import label_counts
from tessella.operators.params import Params
from tessella.plans.numbering import kth, ranked
from tessella.plans.scratch import Scratch
from tessella.sources.model import MultiLabelFrame

log = logging.getLogger(__name__)


def naive(d: MultiLabelFrame, params: Params = Params()) -> DataFrame:
    """Per label, in order of id: batches of instances; of those that no earlier label has placed, the first j are train and the next j test.

    j is the batch's open instances times the train share, half to even. Instances
    beyond 2j are left out unless ``drop_excess`` is off, as are those without labels.
    Batches are cut before placed instances are taken out, so every batch stands alone.
    """
    log.info("naive split: %s", params)
    if d.held is not None:
        y = d.held.filter("has IS NOT NULL").select("instance_id", F.explode("has").alias("label_id"), F.array_min("has").alias("first_label"))
    else:
        y = d.y.join(d.y.groupBy("instance_id").agg(F.min("label_id").alias("first_label")), "instance_id")
    at = ranked(y, ["label_id"], ["instance_id"], "place").filter("label_id = first_label")
    rows = at.withColumn("batch", F.floor((F.col("place") - 1) / F.lit(params.batch_size)).cast("long"))
    order = [key(params.seed, "naive", F.col("instance_id")), "instance_id"] if params.shuffle else ["instance_id"]
    batch = Window.partitionBy("label_id", "batch")
    rows = rows.withColumn("rn", F.row_number().over(batch.orderBy(*order))).withColumn("m", F.count("*").over(batch))
    j = F.rint(F.col("m") * F.lit(params.split_size))
    side = F.when(F.col("rn") <= j, "train").when(F.lit(not params.drop_excess) | (F.col("rn") <= 2 * j), "test")
    return rows.select("instance_id", side.alias("split")).filter("split IS NOT NULL")


def desired_labels(d: MultiLabelFrame, params: Params = Params()) -> DataFrame:
    """(side, label_id, desired): the label's count times the side's share, half to even."""
    sides = F.array(F.struct(F.lit("train").alias("side"), F.lit(params.split_size).alias("r")), F.struct(F.lit("test").alias("side"), F.lit(1 - params.split_size).alias("r")))
    return label_counts(d).withColumn("s", F.explode(sides)).select("s.side", "label_id", F.rint(F.col("c") * F.col("s.r")).cast("long").alias("desired"))


def desired_examples(d: MultiLabelFrame, params: Params = Params()) -> DataFrame:
    """(side, desired): the instances times the side's share, half to even."""
    sides = F.array(F.struct(F.lit("train").alias("side"), F.lit(params.split_size).alias("r")), F.struct(F.lit("test").alias("side"), F.lit(1 - params.split_size).alias("r")))
    return d.instances.agg(F.count("*").alias("n")).withColumn("s", F.explode(sides)).select("s.side", F.rint(F.col("n") * F.col("s.r")).cast("long").alias("desired"))


def iterative(d: MultiLabelFrame, params: Params = Params()) -> DataFrame:
    """Labels from the rarest on: each open instance of the label goes to the side that lacks more of it.

    An instance's turn is its rarest label. Within a turn the choice has a closed form:
    with d more wanted on one side, the first |d| go there, and the rest alternate,
    beginning with train. So a turn is a comparison with the instance's place, and only
    the wanted counts, two per label, pass between turns.
    """
    log.info("iterative split: %s", params)
    scratch = Scratch(d.spark, "iterative")
    counts = sorted((r["c"], r["label_id"]) for r in label_counts(d).collect())
    want = {label: [float(round(c * params.split_size)), float(round(c * (1 - params.split_size)))] for c, label in counts}
    if not counts:
        return d.instances.select("instance_id", F.lit("train").alias("split")).limit(0)
    ranks = d.spark.createDataFrame([(label, k) for k, (_, label) in enumerate(counts)], "label_id int, turn int")
    turns = d.y.join(F.broadcast(ranks), "label_id").groupBy("instance_id").agg(F.min("turn").alias("turn"), F.collect_list("label_id").alias("labels"))
    if params.shuffle:
        turns = turns.withColumn("order", key(params.seed, "iterative", F.col("instance_id")))
        turns = ranked(turns, ["turn"], ["order", "instance_id"], "k").drop("order")
    else:
        turns = ranked(turns, ["turn"], ["instance_id"], "k")
    path = scratch.path("turns")
    turns.write.partitionBy("turn").parquet(path)
    turns = d.spark.read.schema("instance_id long, labels array<int>, k long, turn int").parquet(path)

    bounds = []
    for turn, (_, label) in enumerate(counts):
        more = want[label][0] - want[label][1]
        bounds.append((turn, more))
        used = turns.filter(F.col("turn") == turn).select(_train(F.col("k"), F.lit(more)).alias("train"), F.explode("labels").alias("label_id"))
        for r in used.groupBy("label_id").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test")).collect():
            want[r["label_id"]][0] -= r["train"]
            want[r["label_id"]][1] -= r["test"]
    more = d.spark.createDataFrame(bounds, "turn int, more double")
    return turns.join(F.broadcast(more), "turn").select("instance_id", F.when(_train(F.col("k"), F.col("more")), "train").otherwise("test").alias("split"))


def _train(k: Column, more: Column) -> Column:
    """Whether the k-th of a turn is train, where train lacks ``more`` more than test."""
    beyond = F.pmod(k - F.abs(more).cast("long"), F.lit(2)) == 1
    return F.when(k <= F.abs(more), more >= 0).otherwise(beyond)


# --- extreme ---


def initial_sides(d: MultiLabelFrame, params: Params) -> DataFrame:
    """(instance_id, is_test): test by chance, with its share."""
    return d.instances.select("instance_id", (u01(params.seed, "init", F.col("instance_id")) > params.split_size).cast("int").alias("is_test"))


def label_scores(y: DataFrame, sides: DataFrame, params: Params, average: float) -> DataFrame:
    """(label_id, train, test, label_score): how far the label's test share is from the wanted one, more at the extremes."""
    return _score_of(y.join(sides, "instance_id"), params, average)


def _score_of(y: DataFrame, params: Params, average: float) -> DataFrame:
    """``label_scores`` from (label_id, is_test)."""
    t, p = 1 - params.split_size, params.split_size
    counts = y.groupBy("label_id").agg(F.sum("is_test").alias("test"), F.count("*").alias("n"))
    q = F.col("test") / F.col("n")
    over = (q - t) / p + F.when(q > 0.999, average).otherwise(0.0)
    under = (q - t) / t - F.when(q < 0.001, average).otherwise(0.0)
    score = F.when(F.col("n") <= 1, 0.0).when(q >= t, over).otherwise(under)
    return counts.select("label_id", (F.col("n") - F.col("test")).alias("train"), "test", score.alias("label_score"))


def instance_scores(y: DataFrame, sides: DataFrame, labels: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(instance_id, is_test, score): the sum of its labels' scores, positive if a move to the other side would help, and its own score if given."""
    sums = y.join(labels.select("label_id", "label_score"), "label_id").groupBy("instance_id").agg(F.sum("label_score").alias("s"))
    rows = sides.join(sums, "instance_id", "left")
    total = F.when(F.col("is_test") == 1, 1).otherwise(-1) * F.coalesce("s", F.lit(0.0))
    if scores is not None:
        rows = rows.join(scores, "instance_id", "left")
        total = total + F.coalesce("uncertainty", F.lit(0.0))
    return rows.select("instance_id", "is_test", F.round(total, 9).alias("score"))


def threshold(scored: DataFrame, params: Params, average: float, epoch: int, distinct: bool = False) -> float:
    """The quantile of scores below the average beyond which an instance may move, 0 at least.

    Equal scores are counted first. Without scores of the instances' own there are as
    many as labelsets, and they meet in one task; where each instance has its own
    (``distinct``), the two between which the quantile lies are searched for by counts.
    """
    share = 1 - params.threshold_proportion / (1 + params.decay) ** epoch
    if not distinct:
        counts = scored.filter(F.col("score") < average).groupBy("score").agg(F.count("*").alias("n"))
        return max(round(counts.agg(F.percentile("score", F.lit(share), F.col("n"))).first()[0] or 0.0, 9), 0.0)
    below = Scratch(scored.sparkSession, "threshold")
    rows = below.table(scored.filter(F.col("score") < average).select("score"), "scores")
    at = share * (rows.count() - 1)
    if at < 0:
        return 0.0
    low, before, equal = kth(rows, "score", math.floor(at) + 1)
    high = low if math.ceil(at) < before + equal else rows.filter(F.col("score") > low).agg(F.min("score")).first()[0]
    below.keep()
    return max(round(low + (at - math.floor(at)) * (high - low), 9), 0.0)


def swapped(scored: DataFrame, params: Params, average: float, limit: float, epoch: int) -> DataFrame:
    """The rows, without their score, after some of those with high scores have changed sides."""
    u = u01(params.seed, f"swap{epoch}", F.col("instance_id"))
    chance = F.when(F.col("score") >= average, 0.25 / 1.05**epoch).when(F.col("score") > limit, params.swap_probability / (1 + params.decay) ** epoch).otherwise(-1.0)
    return scored.withColumn("is_test", F.when(u <= chance, 1 - F.col("is_test")).otherwise(F.col("is_test"))).drop("score")


def extreme(d: MultiLabelFrame, params: Params = Params(), scores: DataFrame | None = None, keep_best: bool = False) -> DataFrame:
    """A random split, improved for a number of epochs by moving instances whose labels lie on the wrong side.

    ``scores``: (instance_id, uncertainty) added to the instances' scores. ``keep_best``
    returns the epoch with the lowest sum of label deviations instead of the last.
    """
    log.info("extreme split: %s", params)
    scratch = Scratch(d.spark, "extreme")
    # A row for each instance with its labels is all that epochs read and write: labels are summed from it, and their
    # scores come back to it as one array of the label dimension's size, so an epoch joins nothing.
    if d.held is not None:
        rows = d.held.filter("has IS NOT NULL").select("instance_id", F.col("has").alias("labels"))
    else:
        rows = d.y.groupBy("instance_id").agg(F.collect_list("label_id").alias("labels"))
    rows = rows.select("instance_id", "labels", (u01(params.seed, "init", F.col("instance_id")) > params.split_size).cast("int").alias("is_test"))
    if scores is not None:
        rows = rows.join(scores.select("instance_id", "uncertainty"), "instance_id", "left")
    own = F.lit(0.0) if scores is None else F.coalesce("uncertainty", F.lit(0.0))
    rows = scratch.table(rows.withColumn("own", own).drop("uncertainty"), "rows")
    sums = rows.agg(F.sum(F.size("labels")).alias("ones"), F.count("*").alias("n")).first()
    average, best = float(sums["ones"] or 0) / max(sums["n"], 1), None
    for epoch in range(params.num_epochs):
        scored = _scored(rows, params, average)
        limit = threshold(scored, params, average, epoch, scores is not None)
        log.info("epoch %d of %d: instances with a score above %s may move", epoch + 1, params.num_epochs, limit)
        after = scratch.table(swapped(scored, params, average, limit, epoch), "rows")
        if keep_best:
            off = float(sum(map(abs, _label_scores(after, params, average).values())))
            if best is None or off < best[0]:
                best = off, after
        scratch.keep(*{id(t): t for t in (after, best[1] if best else after)}.values())
        rows = after
    found = best[1] if best else rows
    scratch.keep(found)
    return found.select("instance_id", F.when(F.col("is_test") == 1, "test").otherwise("train").alias("split"))


def _label_scores(rows: DataFrame, params: Params, average: float) -> dict[int, float]:
    """Each label's score, from (instance_id, labels, is_test). The driver sees one row for each label."""
    y = rows.select("instance_id", F.explode("labels").alias("label_id"), "is_test")
    return {r["label_id"]: r["label_score"] for r in _score_of(y, params, average).collect()}


def _scored(rows: DataFrame, params: Params, average: float) -> DataFrame:
    """``rows`` with score: the sum of its labels' scores, positive if a move to the other side would help, and its own."""
    found = _label_scores(rows, params, average)
    known = sorted(found)
    # Places of labels among those that occur: ids need not be without gaps.
    of = rows.sparkSession.createDataFrame([(known, [found[k] for k in known])], "ids array<int>, scores array<double>").withColumn("_k", F.lit(0))
    if known == list(range(len(known))):
        value = lambda label: F.get("scores", label)
    else:
        value = lambda label: F.get("scores", (F.array_position("ids", label) - 1).cast("int"))
    total = F.aggregate(F.transform("labels", value), F.lit(0.0), lambda s, x: s + x)
    total = F.when(F.col("is_test") == 1, 1).otherwise(-1) * total + F.col("own")
    return rows.withColumn("_k", F.lit(0)).join(F.broadcast(of), "_k").select(*rows.columns, F.round(total, 9).alias("score"))


#: Splitters that a grouping of labels can hand over to.
SPLITTERS: dict[str, Callable[[MultiLabelFrame, Params], DataFrame]] = {"extreme": extreme, "iterative": iterative, "naive": naive}


def splitter(split_type: str) -> Callable[[MultiLabelFrame, Params], DataFrame]:
    """The splitter of that name; any other name is the naive one."""
    return SPLITTERS.get(split_type, naive)
