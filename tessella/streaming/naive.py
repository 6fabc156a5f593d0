"""The naive splitter on a stream of (instance_id, label_id) rows.

Each micro-batch is split by itself, as each batch of the naive splitter is, and
appended to a table of sides. Instances that an earlier micro-batch has placed keep
their side: the anti-join with the table takes them out first. With a frozen grouping,
labels are replaced by their groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.params import Params
from tessella.operators.split import naive
from tessella.sources.model import MultiLabelFrame

SCHEMA = "instance_id long, split string, batch long"


class StreamSplitter:
    def __init__(self, spark: SparkSession, folder: str, params: Params = Params(), groups: DataFrame | None = None):
        self.spark, self.folder, self.params, self.groups = spark, folder, params, groups
        spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("batch").parquet(folder)

    def sides(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Split the rows' new instances. A batch that is repeated after a failure replaces itself."""
        y = rows.select("instance_id", "label_id").distinct()
        if self.groups is not None:
            y = y.join(self.groups, "label_id").select("instance_id", F.col("group_id").alias("label_id")).distinct()
        placed = self.sides().filter(F.col("batch") != batch)
        y = y.join(placed.select("instance_id"), "instance_id", "left_anti")
        labels = y.select("label_id").distinct().withColumn("label_name", F.col("label_id").cast("string"))
        split = naive(MultiLabelFrame(y, y.select("instance_id").distinct(), labels), self.params)
        found = split.withColumn("batch", F.lit(batch).cast("long"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.folder)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch)).option("checkpointLocation", checkpoint).start()
