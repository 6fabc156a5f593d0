"""Judging a split by a classifier: a chain of linear models, and F1 in three averages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.rand import key
from tessella.plans.scratch import Scratch
from tessella.sources.model import MultiLabelFrame


def _outcomes(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(instance_id, label_id, t, p) of pairs in either frame."""
    t, p = truth.select("instance_id", "label_id").withColumn("t", F.lit(1)), predicted.select("instance_id", "label_id").withColumn("p", F.lit(1))
    return t.join(p, ["instance_id", "label_id"], "full").fillna(0, ["t", "p"])


def _f1(tp, t, p):
    """0 where there is nothing true and nothing predicted."""
    return F.coalesce(F.try_divide(2.0 * tp, t + p), F.lit(0.0))


def f1_samples(instances: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    rows = _outcomes(truth, predicted).groupBy("instance_id").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    every = instances.join(rows, "instance_id", "left").fillna(0, ["tp", "t", "p"])
    return every.agg(F.round(F.avg(_f1(F.col("tp"), F.col("t"), F.col("p"))), 6).alias("value"))


def f1_micro(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    s = _outcomes(truth, predicted).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return s.select(F.round(_f1(F.col("tp"), F.col("t"), F.col("p")), 6).alias("value"))


def f1_macro(labels: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    rows = _outcomes(truth, predicted).groupBy("label_id").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    every = labels.select("label_id").join(rows, "label_id", "left").fillna(0, ["tp", "t", "p"])
    return every.agg(F.round(F.avg(_f1(F.col("tp"), F.col("t"), F.col("p"))), 6).alias("value"))


def chain_classifier(d: MultiLabelFrame, split: DataFrame, seed: int = 12345, iterations: int = 20) -> DataFrame:
    """(instance_id, label_id, split) of predicted ones: a linear model per label, in random order, each also fed the labels before it.

    Models are fitted on the train side with true labels; predictions are chained.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scratch = Scratch(d.spark, "chain")
    order = [r["label_id"] for r in d.labels.orderBy(key(seed, "chain", F.col("label_id")), "label_id").select("label_id").collect()]
    d = d.hold()
    names = d.feature_names()
    rows = d.held.filter("described").select("instance_id", "has", *[F.col(f"x_{c}").cast("double").alias(f"x_{k}") for k, c in enumerate(names)]).join(split, "instance_id")
    rows = scratch.table(rows, "placed")  # the scaler goes over them, and then what is written below
    rows = rows.select("*", *[F.coalesce(F.array_contains("has", i).cast("double"), F.lit(0.0)).alias(f"y_{i}") for i in order]).drop("has")
    rows = VectorAssembler(inputCols=[f"x_{k}" for k in range(len(names))], outputCol="raw").transform(rows)
    rows = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(rows).transform(rows)
    rows = scratch.table(rows.select("instance_id", "split", "x", *[f"y_{i}" for i in order]), "rows")
    scratch.keep(rows)
    train, models = rows.filter("split = 'train'"), []
    for k, label in enumerate(order):
        before = order[:k]
        fit = VectorAssembler(inputCols=["x", *[f"y_{i}" for i in before]], outputCol="features")
        model = LinearSVC(labelCol=f"y_{label}", maxIter=iterations).fit(fit.transform(train))
        models.append((model.coefficients.toArray(), float(model.intercept)))

    # Models are fitted on true labels, so none waits for predictions: the whole chain is predicted in one pass.
    def predict(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(names))
            p = np.zeros((len(x), len(order)))
            for k, (w, b) in enumerate(models):
                p[:, k] = x @ w[: len(names)] + p[:, :k] @ w[len(names) :] + b > 0
            ones, labels = np.nonzero(p)
            ends = np.concatenate([[0], np.cumsum(np.bincount(ones, minlength=len(x)))])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(order)[labels], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["instance_id", "split", "labels"])

    kind = rows.schema["instance_id"].dataType.simpleString()
    guessed = rows.select("instance_id", "split", vector_to_array("x").alias("x")).mapInArrow(predict, f"instance_id {kind}, split string, labels array<int>")
    return guessed.select("instance_id", F.explode("labels").alias("label_id"), "split")
