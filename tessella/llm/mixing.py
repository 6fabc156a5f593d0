"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies has a whole part, the same for all documents of
its source, which is allocated for certain, and a chance for one copy more. Chances are
unequal: they grow with the root of a document's size, up to certainty, and are scaled
so that the expected words of the source are its target. Documents are ranked by random
odds divided by the odds of their chance, and the first of a source are taken, up to a
fixed size: the words that are left of the target. The one document that comes nearest
to what is missing then may close the gap.

A source may hold a third of all rows, so its documents never meet in one task: ranks
and running sums of words are found by ranges (``plans.numbering``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, fresh, text_of, words_of
from tessella.plans.numbering import running

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: No target is above so many times the source's size, and no document is taken more often.
CAP = 3
#: Chances grow with this power of the size: 0 gives all documents the same, 1 all words.
POWER = 0.5
SEED = "mix-1"


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, sid, source_size, target) of each source; sid: its place in order of code points, null last.

    Shares follow the weights; targets stop at ``cap`` times the source's size and the
    excess goes to the others by weight, until none is above. With the sources in order
    of size by weight, those that stop are the first ones, so the level of the others is
    found from running sums. What the driver sees are the totals and the level.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    found = running(sums, [], ["none", "source"], name="sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    found = found.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    found = running(found, [], ["ratio", "none", "source"], ("source_size", "weight"))
    total = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.sum("weight").alias("weight")).first()
    level = (total["size"] - cap * F.col("source_size_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    fits = found.withColumn("level", level).filter(F.col("level") <= cap * F.col("ratio"))
    final = fits.agg(F.min(F.struct("ratio", "source_size", "level"))["level"]).first()[0]
    goal = F.least(F.lit(float(cap)) * F.col("source_size"), F.lit(float(final or 0.0)) * F.col("weight"))
    return found.select("source", "sid", "source_size", goal.alias("target"))


def size_class(size: Column) -> Column:
    """The number of binary digits: sizes of a class differ by less than a factor of two."""
    return F.length(F.bin(size))


def chances(sized: DataFrame, plan: DataFrame, power: float = POWER) -> DataFrame:
    """(sid, class, chance) from (sid, size) and (sid, words): least(1, c 2 ** (power (class - 1))), with c such that
    the chances times the sizes add up to the words.

    A source has as many rows here as sizes have binary digits. From the largest class
    down, c is what would fit if the classes above were certain; the first c that makes
    no chance of the rest more than 1 holds.
    """
    sums = sized.filter("size > 0").groupBy("sid", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("n"))
    rows = sums.join(plan.select("sid", "words"), "sid").withColumn("x", F.pow(F.lit(2.0), power * (F.col("class") - 1)))
    down = Window.partitionBy("sid").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("x") * F.col("n")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("c", (F.col("words") - above) / rest)
    fits = F.max(F.when(F.col("c") * F.col("x") <= 1, F.struct("class", "c"))).over(Window.partitionBy("sid"))["c"]
    return rows.select("sid", "class", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(fits, F.lit(1.0)) * F.col("x"))).alias("chance"))


def copies(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, power: float = POWER) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, chance, copies.

    chance is that of a copy more than the whole ones. A null text has size 0; a document
    of size 0 gets the whole copies only, which take no words, and its chance is 0. A null
    source is a source, the last one. Rows that repeat a doc_id are documents of their
    own; a null doc_id draws like any other value. An empty table gives no rows. Columns
    besides doc_id, text and source are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(text_of("text"))).cast("long").alias("size")), "sized")
    plan = targets(sized, weights, cap).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    plan = plan.withColumn("whole", F.floor("rate")).withColumn("words", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.table(plan.drop("rate"), "plan")
    of_source = plan.select(F.col("source").alias("_source"), "sid", "source_size", "target", "whole", "words")
    placed = sized.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    placed = scratch.table(placed.withColumn("class", size_class(F.col("size"))), "placed")
    known = scratch.table(chances(placed.select("sid", "size"), plan, power), "chances")

    drawn = placed.join(known, ["sid", "class"], "left").withColumn("chance", F.coalesce("chance", F.lit(0.0))).withColumn("u", uniform(seed, F.col("doc_id")))
    odds = F.when(F.col("chance") >= 1, 0.0).otherwise(F.try_divide(F.col("u") / (1 - F.col("u")), F.col("chance") / (1 - F.col("chance"))))
    # Documents of size 0 come last: they take part in nothing.
    drawn = drawn.select("doc_id", "sid", "size", "source_size", "target", "whole", "words", "chance", F.when(F.col("size") > 0, odds).alias("q"))
    drawn = drawn.withColumn("idle", F.col("q").isNull())
    order = ["idle", "q", "doc_id", "size"]
    ranked = running(drawn, ["sid"], order, ("size",), "place")
    ranked = ranked.withColumn("more", ~F.col("idle") & (F.col("size_before") + F.col("size") <= F.col("words")))
    ranked = scratch.table(ranked.drop("size_before", "idle", "q"), "ranked")

    used = ranked.filter("more").groupBy("sid").agg(F.sum("size").alias("used"))
    rest = plan.join(used, "sid", "left").select("sid", (F.col("words") - F.coalesce("used", F.lit(0))).alias("rest"))
    gap = F.abs(F.col("size") - F.col("rest"))
    near = ranked.filter("NOT more AND size > 0").join(scratch.table(rest, "rest"), "sid").filter(gap < F.col("rest"))
    near = scratch.table(near.groupBy("sid").agg(F.min(F.struct(gap.alias("gap"), "place"))["place"].alias("place")), "last")
    scratch.keep(ranked, near)
    found = ranked.join(near.withColumn("last", F.lit(1)), ["sid", "place"], "left")
    return found.select("doc_id", "size", "source_size", "target", "chance", (F.col("whole") + F.col("more").cast("int") + F.coalesce("last", F.lit(0))).cast("int").alias("copies"))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = copies(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; of rows that repeat a doc_id, as often as the most."""
    plan = copies(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies")).filter("copies > 0")
    plan = Scratch(docs.sparkSession, "mix").table(plan, "copies")
    found = docs.join(plan, docs["doc_id"].eqNullSafe(plan["id"]))
    copy = F.explode(F.array_repeat(F.lit(0), plan["copies"])).alias(fresh(docs, "copy"))
    return found.select(*[docs[c] for c in docs.columns], copy).drop(fresh(docs, "copy"))
