"""Splitting with scores from a model's uncertainty.

One linear model per label is stepped along its gradient. The driver holds weights,
labels times features, and executors go through the instances in Arrow batches: a task
returns one sum of labels times features, and one number for each instance, so no frame
has a row for each instance and label. The uncertainty of the models' probabilities is
added to the scores of the extreme splitter.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.rand import u01, weighted_sample
from tessella.functions.scalar import EPS, EXPONENTS, log_logistic, optimal_step
from tessella.operators.base import label_counts
from tessella.operators.params import Params
from tessella.operators.split import extreme
from tessella.plans.numbering import kth
from tessella.plans.scratch import Scratch
from tessella.sources.model import MultiLabelFrame

log = logging.getLogger(__name__)

ACQUISITIONS = ("entropy", "psp")
PENALTIES = ("l1", "l2", "elasticnet", "l21")
LOSSES = ("hinge", "log")


@dataclass(frozen=True)
class ActiveParams:
    acquisition_type: str = "psp"
    subsample_labels_size: int = 50
    top_k: int = 20
    calc_ads: bool = True
    ads_percent: float = 0.7
    use_solver: bool = True
    loss_function: str = "hinge"
    penalty: str = "elasticnet"
    alpha_elastic: float = 1e-4
    l1_ratio: float = 0.65
    alpha_l21: float = 5.0
    learning_rate: float = 1e-3
    num_epochs: int = 5

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        if self.acquisition_type not in ACQUISITIONS:
            put("acquisition_type", "psp")
        if self.penalty not in PENALTIES:
            put("penalty", "elasticnet")
        if self.loss_function not in LOSSES:
            put("loss_function", "hinge")
        if self.subsample_labels_size <= 0:
            put("subsample_labels_size", 50)
        if not 0 < self.ads_percent <= 1:
            put("ads_percent", 0.7)


def standardized(d: MultiLabelFrame) -> DataFrame:
    """(instance_id, v): 1 and the features, centred and scaled."""
    return d.x.select("instance_id", _scaled(d, ""))


def vectors(d: MultiLabelFrame) -> DataFrame:
    """(instance_id, v, has) of instances with features and labels, from a frame that is held."""
    return d.held.filter("described AND has IS NOT NULL").select("instance_id", _scaled(d, "x_"), "has")


def _scaled(d: MultiLabelFrame, prefix: str) -> Column:
    names = d.feature_names()
    s = d.x.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names]).first()
    v = [F.lit(1.0)] + [(F.col(prefix + c).cast("double") - float(s[f"m_{c}"] or 0)) / (float(s[f"s_{c}"] or 0) or 1.0) for c in names]
    return F.array(*v).alias("v")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, e: s + e)


def _models(weights: dict[int, np.ndarray]) -> Column:
    return F.array(*[F.struct(F.lit(label).alias("label_id"), F.array(*map(F.lit, map(float, w))).alias("w")) for label, w in sorted(weights.items())])


def _matrix(weights: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The labels in order, and their weights as rows."""
    return np.array(sorted(weights)), np.stack([weights[k] for k in sorted(weights)])


def _batch(batch: pa.RecordBatch, labels: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of (instance_id, v, has): the vectors, each model's value, and whether the label is there."""
    v, has = batch.column(1).flatten().to_numpy().reshape(-1, w.shape[1]), batch.column(2)
    ones, owners = has.flatten().to_numpy(), np.repeat(np.arange(len(v)), has.value_lengths().to_numpy())
    at = np.minimum(np.searchsorted(labels, ones), len(labels) - 1)
    y = np.zeros((len(v), len(labels)))
    y[owners[labels[at] == ones], at[labels[at] == ones]] = 1
    return v, np.clip(v @ w.T, *EXPONENTS), y


def gradient(rows: DataFrame, weights: dict[int, np.ndarray], loss: str = "log") -> dict[int, np.ndarray]:
    """Mean over instances of the loss's gradient, per label: (p - y) v, or for 'hinge' -s v where s z is less than 1, s being 1 or -1."""
    labels, w = _matrix(weights)
    read = _batch

    def run(batches):
        sums, n = np.zeros_like(w), 0
        for batch in batches:
            v, z, y = read(batch, labels, w)
            if loss == "hinge":
                side = 2 * y - 1
                off = np.where(side * z < 1, -side, 0.0)
            else:
                with np.errstate(over="ignore"):
                    off = 1 / (1 + np.exp(-z)) - y
            sums, n = sums + off.T @ v, n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[*sums.ravel(), n]], pa.list_(pa.float64()))], names=["sums"])

    # One row for each task of a scan, of labels times features and the count: they are summed place by place on the executors, in one pass.
    parts = rows.select("instance_id", "v", "has").mapInArrow(run, "sums array<double>")
    places = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    total = np.zeros(w.size + 1)
    for r in places.collect():
        total[r["at"]] = r["x"]
    return dict(zip(labels.tolist(), total[:-1].reshape(w.shape) / max(total[-1], 1), strict=True))


def l21_gradient(m: np.ndarray) -> np.ndarray:
    """Rows divided by twice their length."""
    return m / (2 * np.linalg.norm(m, axis=-1, keepdims=True) + EPS)


def penalty_gradient(w: np.ndarray, params: ActiveParams) -> np.ndarray:
    """The penalty's gradient; the first weight, the intercept, has none."""
    kinds = {"l1": np.sign(w), "l2": w, "elasticnet": params.l1_ratio * np.sign(w) + (1 - params.l1_ratio) * w, "l21": l21_gradient(w)}
    found = (params.alpha_l21 if params.penalty == "l21" else 1.0) * params.alpha_elastic * kinds[params.penalty]
    found[0] = 0.0
    return found


def step(rows: DataFrame, weights: dict[int, np.ndarray], epoch: int, params: ActiveParams) -> dict[int, np.ndarray]:
    """The weights after a step, from where they were: along the chosen loss with ``use_solver``, along the logistic one without."""
    rate = 1 / (params.learning_rate * (optimal_step(params.learning_rate) + epoch))
    moves = gradient(rows, weights, params.loss_function if params.use_solver else "log")
    return {label: w - rate * (moves[label] + penalty_gradient(w.copy(), params)) for label, w in weights.items()}


def _each(rows: DataFrame, weights: dict[int, np.ndarray], score) -> DataFrame:
    """(instance_id, s): ``score`` of each model's probability and whether the label is there, for batches of instances; other columns stay."""
    labels, w = _matrix(weights)
    read = _batch

    def run(batches):
        for batch in batches:
            _, z, y = read(batch, labels, w)
            with np.errstate(over="ignore"):
                s = score(1 / (1 + np.exp(-z)), y)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(s, pa.float64())], names=["instance_id", *more, "s"])

    more = [c for c in rows.columns if c not in ("instance_id", "v", "has")]
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    return rows.select("instance_id", "v", "has", *more).mapInArrow(run, f"instance_id long{kinds}, s double")


def entropy(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """(instance_id, uncertainty): -p ln p of the mean probability over labels."""

    def score(p, y):
        mean = p.mean(axis=1)
        return -mean * np.log(mean + EPS) + EPS

    return _each(rows, weights, score).select("instance_id", F.round("s", 9).alias("uncertainty"))


def psp(rows: DataFrame, weights: dict[int, np.ndarray], counts: DataFrame, top_k: int) -> DataFrame:
    """(instance_id, uncertainty): one less the scaled mean of y over propensity among the k likeliest labels.

    ``counts``: c(label_id, c). Scaled to 0..1 over all instances.
    """
    c = {r["label_id"]: r["c"] for r in counts.filter(F.col("label_id").isin(sorted(weights))).collect()}
    propensity = np.array([1 / (1 + 1 / (c.get(k, 0) + 1.0)) for k in sorted(weights)])

    def score(p, y):
        best = np.argsort(-p, axis=1, kind="stable")[:, :top_k]
        return np.take_along_axis(y / propensity, best, axis=1).mean(axis=1)

    found = Scratch(rows.sparkSession, "psp").table(_each(rows, weights, score), "psp")
    ends = found.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    width = float((ends["hi"] or 0) - (ends["lo"] or 0)) or 1.0
    return found.select("instance_id", F.round(1 - (F.col("s") - float(ends["lo"] or 0)) / width + EPS, 9).alias("uncertainty"))


def ads(scores: DataFrame, n: int, percent: float) -> DataFrame:
    """The most uncertain share of all n instances; of equals the smaller id. Only where the share ends is searched for; nothing is sorted."""
    scores = Scratch(scores.sparkSession, "ads").table(scores, "scores")
    return scores.filter(_among(scores, int(percent * n)))


def _among(scores: DataFrame, k: int) -> Column:
    """Whether a row is one of the k most uncertain; of equals the smaller id. ``scores``: a written table with ids of one row each."""
    if k < 1:
        return F.lit(False)
    less = scores.select((-F.col("uncertainty")).alias("less"), "instance_id")
    if (end := kth(less, "less", k)) is None:
        return F.lit(True)
    last, before, equal = end
    if before + equal == k:
        return F.col("uncertainty") >= -last
    edge = kth(less.filter(F.col("less") == last), "instance_id", k - before)[0]
    return (F.col("uncertainty") > -last) | ((F.col("uncertainty") == -last) & (F.col("instance_id") <= edge))


def cost(rows: DataFrame, weights: dict[int, np.ndarray]) -> DataFrame:
    """(label_id, cost): the mean logistic loss of each model."""
    m = rows.withColumn("m", F.explode(_models(weights)))
    side = F.when(F.array_contains("has", F.col("m.label_id")), -1.0).otherwise(1.0)
    loss = log_logistic(side * _dot(F.col("v"), F.col("m.w")), negative=False)
    return m.select(F.col("m.label_id").alias("label_id"), loss.alias("loss")).groupBy("label_id").agg(F.avg("loss").alias("cost"))


def mean_cost(costs: DataFrame) -> DataFrame:
    """(cost): the mean over labels, and EPS."""
    return costs.agg((F.avg("cost") + EPS).alias("cost"))


def active(d: MultiLabelFrame, params: Params = Params(num_epochs=5), active_params: ActiveParams = ActiveParams()) -> DataFrame:
    """split(instance_id, split): models are stepped, their uncertainty is scored, and the extreme splitter moves the uncertain first.

    Each epoch draws labels anew, rare ones more often, and steps their models. With
    ``calc_ads`` an epoch is trained on the most uncertain share of the epoch before and
    on the same share of the others, drawn anew, and only the most uncertain share of the
    last epoch is split.
    """
    log.info("active split: %s, %s", params, active_params)
    d = d.hold().labelled()
    scratch = Scratch(d.spark, "active")
    rows = scratch.table(vectors(d), "rows")
    counts = scratch.table(label_counts(d), "counts")
    n, width = d.instances.count(), 1 + len(d.feature_names())
    weights, seen, scores = {}, rows, None
    for epoch in range(active_params.num_epochs):
        drawn = weighted_sample(counts, "label_id", F.when(F.col("c") > 0, 1 / F.col("c")), active_params.subsample_labels_size, params.seed, f"labels{epoch}")
        now = {r["label_id"]: weights.get(r["label_id"], np.zeros(width)) for r in drawn.collect()}
        if not now:
            return extreme(d, params)
        if scores is not None:
            more = u01(params.seed, f"ads{epoch}", F.col("instance_id")) < active_params.ads_percent
            seen = rows.join(scores.select("instance_id", F.lit(True).alias("_in")), "instance_id", "left").filter(F.col("_in") | more).drop("_in")
            seen = scratch.table(seen, "seen")
        weights |= step(seen, now, epoch, active_params)
        if active_params.calc_ads or epoch == active_params.num_epochs - 1:
            scores = entropy(seen, weights) if active_params.acquisition_type == "entropy" else psp(seen, weights, counts, active_params.top_k)
            scores = scratch.table(ads(scores, n, active_params.ads_percent) if active_params.calc_ads else scores, "scores")
    return extreme(d.take(scores) if active_params.calc_ads else d, params, scores)
