"""Exact dedup by a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row
per digest (partial aggregation first, so a text with any number of copies sends
one row per task), anti-joined with the index by sort-merge, and what is new is
appended. Only digests and ids move; texts stay where they are read.

The number of buckets belongs to the index, not to the session that opens it: it is
written beside the files when the index is started, and read when it is opened again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, fresh, lower_ascii, partitions, text_of


def digest_of(text_col: str = "text") -> Column:
    """SHA-256 of the whole text after lower-casing A to Z; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(text_of(text_col)).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"))


class DigestIndex:
    """Digests seen so far, with the id that stays and the copies counted when each was added.

    ``location``: folder of an index to open or start; ``None`` keeps it as a managed
    table in the warehouse. ``buckets`` counts where an index is started; one that is
    opened has its own, and any other given number is refused. The table name is the
    session's handle for the folder.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.location = location.rstrip("/") if location else None
        self.buckets = self._own_buckets(buckets)
        where = f"LOCATION '{self.location}/files'" if self.location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, copies BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {where}"
        )

    def _own_buckets(self, buckets: int | None) -> int:
        """The number that the index was started with; where there is none, ``buckets`` is written down."""
        start = buckets or partitions(self.spark)
        if self.location is None:
            if not self.spark.catalog.tableExists(self.name):
                return start
            told = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").filter("col_name = 'Num Buckets'").first()
            found = int(told["data_type"])
        else:
            note = f"{self.location}/buckets"
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{note}/_SUCCESS")
            if not path.getFileSystem(conf).exists(path):
                self.spark.range(1).select(F.lit(start).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(note)
                return start
            found = self.spark.read.schema("buckets int").parquet(note).first()["buckets"]
        if buckets not in (None, found):
            raise ValueError(f"the index has {found} buckets, not {buckets}")
        return found

    def drop(self) -> None:
        """Forget the table; its files go too where they are the warehouse's."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (doc_id, digest) that the index lacks; of equal ones the largest id stays."""
        found = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies"))
        # Written first: Catalyst would move the anti-join below the sums, and every copy would be shuffled.
        scratch = Scratch(self.spark, "exact")
        found = scratch.table(found, "sums")
        fresh = found.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        scratch.keep()

    def files(self) -> DataFrame:
        """The rows without the bucketing, for joins whose other side has hot digests: Spark can then split them."""
        folder = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").filter("col_name = 'Location'").first()["data_type"]
        return self.spark.read.schema(self.table().schema).parquet(folder)


def exact_groups(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``docs`` to the index and return one row per row of ``docs``.

    Columns: doc_id, keep_id, group_size (copies in the batch that brought the text),
    kept, text_sha256. A null text is an empty one. Rows that repeat a doc_id are
    copies like any other and share its verdict. A null id keeps its row; a group
    whose ids are all null has a null keep_id and kept is false. An empty table gives
    no rows. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    return _groups(Scratch(docs.sparkSession, "exact").table(digests(docs, id_col, text_col), "digests"), index)


def _groups(seen: DataFrame, index: DigestIndex) -> DataFrame:
    index.add(seen)
    return seen.join(index.files(), "digest").select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The groups within ``docs`` alone: by an index of its own, which is dropped when they are known."""
    return _groups_alone(docs)


def _groups_alone(docs: DataFrame) -> DataFrame:
    index, scratch = DigestIndex(docs.sparkSession), Scratch(docs.sparkSession, "exact")
    found = scratch.table(_groups(scratch.table(digests(docs), "digests"), index), "groups")
    scratch.keep(found)
    index.drop()
    return found


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows that repeat both an id and a text, one.

    Of a text that only rows with a null id have, one stays, unless the index had it before.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    before = scratch.table(index.table().filter("keep_id IS NULL").select(F.col("digest").alias("_before")), "before") if index else None
    groups = exact_groups(docs, index) if index else _groups_alone(docs)
    stay = groups.filter("kept OR (doc_id IS NULL AND keep_id IS NULL)").select("keep_id", F.unhex("text_sha256").alias("keep_digest"))
    if before is not None:
        stay = stay.join(before, F.col("keep_id").isNull() & (F.col("keep_digest") == F.col("_before")), "left_anti")
    # A null id is 0 with a longer digest: by plain equality, the join deals rows as dropDuplicates needs them.
    key = lambda i, digest: (F.coalesce(i, F.lit(0)).cast("long"), F.when(i.isNull(), F.concat(digest, F.unhex(F.lit("00")))).otherwise(digest))
    stay = stay.select(*[c.alias(n) for c, n in zip(key(F.col("keep_id"), F.col("keep_digest")), ("keep_id", "keep_digest"), strict=True)])
    own_id, own = fresh(docs, "id"), fresh(docs, "digest")
    of_id, of_text = key(docs["doc_id"].cast("long"), digest_of())
    marked = docs.withColumn(own_id, of_id).withColumn(own, of_text)
    found = marked.join(stay, (marked[own_id] == stay["keep_id"]) & (marked[own] == stay["keep_digest"]), "left_semi")
    return found.dropDuplicates([own_id, own]).drop(own_id, own)
