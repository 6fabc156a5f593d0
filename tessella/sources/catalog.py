"""Named data sets: label matrices from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.model import InvalidData, MultiLabelFrame, from_long, from_single_label, read_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: price, quantity and mean discount (numeric); lines, an urgent flag and the priority's number (nominal)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").cast("int").alias("lines")
    )
    priority = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("instance_id"),
        F.col("o_totalprice").alias("price"),
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"),
        F.coalesce("discount", F.lit(0.0)).alias("discount"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce((priority == "1").cast("int"), F.lit(0)).alias("urgent"),
        F.coalesce(F.expr("try_cast(substring(o_orderpriority, 1, 1) AS int)"), F.lit(0)).alias("priority"),
    )


def _order_parts(spark: SparkSession, sf_dir: str, column: str) -> MultiLabelFrame:
    part = table(spark, sf_dir, "part")
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part.select("p_partkey", column), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return from_long(pairs, "l_orderkey", column, instances=orders, labels=part, x=order_features(spark, sf_dir))


def order_type(spark: SparkSession, sf_dir: str) -> MultiLabelFrame:
    """Orders, labelled with the types of their parts."""
    return _order_parts(spark, sf_dir, "p_type")


def order_brand(spark: SparkSession, sf_dir: str) -> MultiLabelFrame:
    """Orders, labelled with the brands of their parts."""
    return _order_parts(spark, sf_dir, "p_brand")


def embedding_class(spark: SparkSession, sf_dir: str) -> MultiLabelFrame:
    """Embeddings, each with its one class."""
    return from_single_label(table(spark, sf_dir, "embeddings"), "vec_id", "label")


DATASETS: dict[str, Callable[[SparkSession, str], MultiLabelFrame]] = {"order_type": order_type, "order_brand": order_brand, "embedding_class": embedding_class}

#: Names of public multi-label benchmark sets.
BENCHMARKS = (
    "bibtex", "birds", "Corel5k", "delicious", "emotions", "enron", "genbase", "mediamill", "medical", "rcv1subset1", "rcv1subset2",
    "rcv1subset3", "rcv1subset4", "rcv1subset5", "scene", "tmc2007_500", "yeast",
)


def stored(spark: SparkSession, folder: str, name: str, features: bool = True) -> MultiLabelFrame:
    """The benchmark set of that name from ``<name>_y`` and ``<name>_X`` under ``folder``, as ``write_parquet`` leaves them."""
    if name not in BENCHMARKS:
        raise InvalidData(f"no data set {name!r}")
    return read_parquet(spark, f"{folder}/{name}_y", f"{folder}/{name}_X" if features else None)


#: SQL of the frames of order_type and order_brand: labels, y, inst, x, and the counts c, k, ls of the metrics.
def frames_sql(column: str = "p_type") -> str:
    return f"""
    labels AS (SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS label_id, v AS label_name FROM (SELECT DISTINCT {column} AS v FROM part)),
    y AS (SELECT DISTINCT l_orderkey AS instance_id, label_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN labels ON label_name = {column}),
    inst AS (SELECT o_orderkey AS instance_id FROM orders),
    agg AS (SELECT l_orderkey, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, CAST(count(*) AS INTEGER) AS lines FROM lineitem GROUP BY 1),
    x AS (SELECT o_orderkey AS instance_id, o_totalprice AS price, coalesce(quantity, 0) AS quantity, coalesce(discount, 0) AS discount,
            coalesce(lines, 0) AS lines, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 1 ELSE 0 END AS urgent,
            coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 0) AS priority
          FROM orders LEFT JOIN agg ON o_orderkey = l_orderkey),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM inst),
    c AS (SELECT label_id, CAST(count(instance_id) AS BIGINT) AS c FROM labels LEFT JOIN y USING (label_id) GROUP BY 1),
    k AS (SELECT instance_id, CAST(count(label_id) AS BIGINT) AS k FROM inst LEFT JOIN y USING (instance_id) GROUP BY 1),
    sets AS (SELECT instance_id, coalesce(string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY label_id), '') AS labelset, coalesce(sum(c), 0) AS w
             FROM inst LEFT JOIN y USING (instance_id) LEFT JOIN c USING (label_id) GROUP BY 1),
    ls AS (SELECT labelset, CAST(count(*) AS BIGINT) AS cnt, min(instance_id) AS first_seen, CAST(max(w) AS DOUBLE) AS w FROM sets GROUP BY 1)"""
