"""What the operators share: shipping code, scratch tables, text helpers."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.scratch import Scratch, scratch_root

__all__ = ["Scratch", "scratch_root"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: White space of the word rules: blank and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for operators whose Python code they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).parents[1]
    files = sorted(p for p in top.rglob("*.py"))
    name = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = Path(tempfile.mkdtemp(prefix="tessella-")) / f"{top.name}-{name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in files:
            out.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_of(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """Maximal runs of anything but white space, in order; an array without empty strings."""
    return F.array_remove(F.split(text, BLANKS), "")


def n_chars_in(text: Column, chars: str) -> Column:
    """How often single-byte characters stand in the text."""
    return sum(
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars),
        F.lit(0),
    ).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once for each row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Values whose states are strung together one by one; longer arrays are cut into parts of so many.
PART = 128


def states_before(values: Column, zero: Column, add: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """The sum of all earlier values, for each value of the array; ``add`` is associative and ``zero`` adds nothing.

    Appending to an array copies it, so that one pass over n values would copy n squared.
    Here parts of the array are summed, the states before the parts are found in the same
    way from these sums, and each part is gone through from its own state: n copies for
    each level, up to ``PART ** levels`` values.
    """

    def one_by_one(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("last"), F.slice(F.array(start), 1, 0).alias("found"))
        step = lambda s, x: F.struct(add(s["last"], x).alias("last"), F.concat(s["found"], F.array(s["last"])).alias("found"))
        return F.aggregate(part, begin, step, lambda s: s["found"])

    def by_parts(whole: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / PART).cast("int")), lambda k: F.slice(whole, k * PART + 1, PART))
        starts = lambda parts: states_before(F.transform(parts, lambda p: F.aggregate(p, zero, add)), zero, add, levels - 1)
        each = lambda parts, before: F.flatten(F.transform(parts, lambda p, i: one_by_one(p, F.get(before, i))))
        return let(cut, lambda parts: let(starts(parts), lambda before: each(parts, before)))

    if levels <= 1:
        return one_by_one(values, zero)
    return let(values, lambda whole: F.when(F.size(whole) <= PART, one_by_one(whole, zero)).otherwise(by_parts(whole)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
