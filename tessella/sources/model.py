"""Multi-label data as frames.

A label matrix is its ones: ``y(instance_id, label_id)``, each pair once. Instances
and labels without any one live in ``instances(instance_id)`` and
``labels(label_id, label_name)``, so that they count in denominators. Features are
``x(instance_id, ...)``, wide; integer columns are nominal and floating ones numeric.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.scratch import Scratch

NOMINAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
NUMERIC = (T.FloatType, T.DoubleType)


class InvalidData(ValueError):
    """Data of a type or shape that isn't accepted."""


@dataclass(frozen=True)
class MultiLabelFrame:
    y: DataFrame
    instances: DataFrame
    labels: DataFrame
    x: DataFrame | None = None
    #: What ``hold`` has written: (instance_id, has, listed, described, ...), has being the sorted labels or null.
    held: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.y.sparkSession

    def feature_names(self) -> list[str]:
        if self.x is None:
            raise InvalidData("features are needed")
        return [c for c in self.x.columns if c != "instance_id"]

    def nominal_names(self) -> list[str]:
        kinds = {f.name: f.dataType for f in self.x.schema}
        return [c for c in self.feature_names() if isinstance(kinds[c], NOMINAL)]

    def numeric_names(self) -> list[str]:
        kinds = {f.name: f.dataType for f in self.x.schema}
        return [c for c in self.feature_names() if isinstance(kinds[c], NUMERIC)]

    def hold(self) -> MultiLabelFrame:
        """The same data, read from one written table with a row for each instance.

        What goes over the data more than once begins with this: labels and features are
        made and brought together once, and stand in the same row from then on. ``listed``
        and ``described`` say whether the id is among the instances and has features.
        """
        if self.held is not None:
            return self
        scratch = Scratch(self.spark, "frame")
        sets = self.y.groupBy("instance_id").agg(F.sort_array(F.collect_list("label_id")).alias("has"))
        rows = self.instances.withColumn("listed", F.lit(True)).join(sets, "instance_id", "full")
        if self.x is not None:
            kept = [F.col(c).alias(f"x_{c}") for c in self.feature_names()]
            rows = rows.join(self.x.select("instance_id", *kept, F.lit(True).alias("described")), "instance_id", "full")
        else:
            rows = rows.withColumn("described", F.lit(False))
        yes = [F.coalesce(c, F.lit(False)).alias(c) for c in ("listed", "described")]
        features = [] if self.x is None else [f"x_{c}" for c in self.feature_names()]
        rows = scratch.table(rows.select("instance_id", "has", *yes, *features), "rows")
        return replace(self, labels=scratch.table(self.labels, "labels"))._reading(rows)

    def _reading(self, rows: DataFrame) -> MultiLabelFrame:
        """This frame with all but its labels read from ``rows``."""
        y = rows.filter("has IS NOT NULL").select("instance_id", F.explode("has").alias("label_id"))
        x = None if self.x is None else rows.filter("described").select("instance_id", *[F.col(f"x_{c}").alias(c) for c in self.feature_names()])
        return replace(self, y=y, instances=rows.filter("listed").select("instance_id"), x=x, held=rows)

    def labelled(self) -> MultiLabelFrame:
        """Only instances with a label, and their features."""
        if self.held is not None:
            listed = F.col("listed") & F.col("has").isNotNull()
            return self._reading(self.held.withColumns({"listed": listed, "described": F.col("described") & listed}))
        kept = self.instances.join(self.y.select("instance_id").distinct(), "instance_id", "left_semi")
        return replace(self, instances=kept, x=None if self.x is None else self.x.join(kept, "instance_id", "left_semi"))

    def take(self, ids: DataFrame) -> MultiLabelFrame:
        """The instances of ``ids``. An id drawn more than once becomes as many instances, numbered by ``draw``."""
        if "draw" in ids.columns:
            pick = lambda df: df.join(ids, "instance_id").drop("instance_id").withColumnRenamed("draw", "instance_id")
            return replace(self, held=None, y=pick(self.y), instances=ids.select(F.col("draw").alias("instance_id")), x=None if self.x is None else pick(self.x))
        if self.held is not None:
            return self._reading(self.held.join(ids.select("instance_id"), "instance_id", "left_semi"))
        keep = lambda df: df.join(ids.select("instance_id"), "instance_id", "left_semi")
        return replace(self, held=None, y=keep(self.y), instances=keep(self.instances), x=None if self.x is None else keep(self.x))

    def check(self) -> MultiLabelFrame:
        """Raise unless y and x speak of the same instances and labels."""
        for frame, of, column in ((self.y, self.instances, "instance_id"), (self.y, self.labels, "label_id"), *(((self.x, self.instances, "instance_id"), (self.instances, self.x, "instance_id")) if self.x is not None else ())):
            if not frame.join(of, column, "left_anti").isEmpty():
                raise InvalidData(f"unknown or missing {column}")
        if not self.y.groupBy("instance_id", "label_id").count().filter("count > 1").isEmpty():
            raise InvalidData("a label stands twice for an instance")
        return self


def _dimension(names: DataFrame, column: str) -> DataFrame:
    """Label ids 0, 1, ... in order of name. One row per label passes through one task."""
    found = names.select(F.col(column).alias("label_name")).distinct()
    return found.select((F.row_number().over(Window.orderBy("label_name")) - 1).cast("int").alias("label_id"), "label_name")


def _require(df: DataFrame, columns: list[str], kinds: tuple = ()) -> None:
    for c in columns:
        if c not in df.columns:
            raise InvalidData(f"no column {c}")
        if kinds and not isinstance(df.schema[c].dataType, kinds):
            raise InvalidData(f"{c} is {df.schema[c].dataType.simpleString()}")


def from_long(pairs: DataFrame, instance: str, label: str, instances: DataFrame | None = None, labels: DataFrame | None = None, x: DataFrame | None = None) -> MultiLabelFrame:
    """From rows of one instance and one label; a label that repeats for an instance counts once.

    ``instances`` and ``labels``: all ids and all names, where some have no pair.
    """
    _require(pairs, [instance, label])
    dim = _dimension(labels if labels is not None else pairs, label)
    given = pairs.select(F.col(instance).alias("instance_id"), F.col(label).alias("label_name")).filter("label_name IS NOT NULL")
    # Few names meet many rows: joined by name, all rows of a name would come to one task.
    y = given.join(F.broadcast(dim), "label_name").select("instance_id", "label_id").distinct()
    ids = (instances if instances is not None else pairs).select(F.col(instance).alias("instance_id")).distinct()
    return MultiLabelFrame(y, ids, dim, x)


def from_array_col(df: DataFrame, instance: str, labels: str, x: DataFrame | None = None) -> MultiLabelFrame:
    """From rows of an instance and an array of labels, which may be empty or null."""
    _require(df, [labels], (T.ArrayType,))
    return from_long(df.select(F.col(instance), F.explode(labels).alias("label")), instance, "label", instances=df, x=x)


def from_wide(df: DataFrame, instance: str, labels: list[str], x: DataFrame | None = None) -> MultiLabelFrame:
    """From one column per label; any value but 0, false and null is a one. Ids follow the order of ``labels``."""
    _require(df, [instance, *labels])
    marks = [F.struct(F.lit(k).alias("label_id"), F.coalesce(F.col(c).cast("double") != 0, F.lit(False)).alias("one")) for k, c in enumerate(labels)]
    y = df.select(F.col(instance).alias("instance_id"), F.explode(F.filter(F.array(*marks), lambda m: m["one"])).alias("m")).select("instance_id", "m.label_id").distinct()
    dim = df.sparkSession.createDataFrame([*enumerate(labels)], "label_id int, label_name string")
    return MultiLabelFrame(y, df.select(F.col(instance).alias("instance_id")).distinct(), dim, x)


def from_multi_hot(df: DataFrame, instance: str, vector: str, x: DataFrame | None = None) -> MultiLabelFrame:
    """From an array of 0 and 1; label ids are places in it."""
    _require(df, [vector], (T.ArrayType,))
    rows = df.select(F.col(instance).alias("instance_id"), F.posexplode(vector).alias("label_id", "value"))
    dim = rows.select("label_id").distinct().withColumn("label_name", F.col("label_id").cast("string"))
    y = rows.filter(F.coalesce(F.col("value").cast("double") != 0, F.lit(False))).select("instance_id", "label_id").distinct()
    return MultiLabelFrame(y, df.select(F.col(instance).alias("instance_id")).distinct(), dim, x)


def from_single_label(df: DataFrame, instance: str, label: str, x: DataFrame | None = None) -> MultiLabelFrame:
    """One class for each instance; null is class 0. Label ids follow the order of classes."""
    _require(df, [instance, label])
    rows = df.select(F.col(instance).alias("instance_id"), F.coalesce(F.col(label), F.lit(0)).alias("label"))
    return from_long(rows, "instance_id", "label", x=x)


def read_parquet(spark: SparkSession, y_path: str, x_path: str | None = None) -> MultiLabelFrame:
    """From Parquet: (instance_id, label) pairs and, if given, wide features whose ids are all instances."""
    x = spark.read.parquet(x_path) if x_path else None
    return from_long(spark.read.parquet(y_path), "instance_id", "label", instances=x, x=x)


def write_parquet(data: MultiLabelFrame, y_path: str, x_path: str | None = None) -> None:
    data.y.join(data.labels, "label_id").select("instance_id", F.col("label_name").alias("label")).write.parquet(y_path)
    if x_path:
        data.x.write.parquet(x_path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A report as one tab-separated file with a header. For reports: their rows don't grow with the data."""
    df.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
