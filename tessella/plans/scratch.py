"""Written tables that cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset the session must be a single-JVM one (``local[...]``), which
    gets a folder of its own; on a cluster a local folder would lose files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders of this process, by name, and how to reach them; a stopped session is not needed for that.
_made: dict[str, tuple] = {}


@atexit.register
def remove_all() -> None:
    """Remove what results may have read until now. Tables that results don't read go before, by ``keep``."""
    while _made:
        root, (jvm, conf) = _made.popitem()
        try:
            _delete(jvm, conf, root)
        except Exception:  # noqa: BLE001  the virtual machine may be gone; nothing is left to be done then
            return


def _delete(jvm, conf, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


class Scratch:
    """A folder of Parquet tables. They survive the loss of any executor, and go when this process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._tables: list[DataFrame] = []
        self._reach = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        _made[self.root] = self._reach

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.path(name)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found._scratch_path = path
        self._tables.append(found)
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        for df in tables:
            _delete(*self._reach, df._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all written tables but these."""
        kept = {df._scratch_path for df in tables}
        self.drop(*(df for df in self._tables if df._scratch_path not in kept))
        self._tables = [*tables]
