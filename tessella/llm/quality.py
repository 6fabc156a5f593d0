"""Quality rules: marks of a document by itself, and lines that too many documents of a host share.

A line is normalised (lower case, white space as single blanks) and hashed with its
host. Of each, the distinct documents are counted. Lines above the limit are removed,
and a document that is left with too few words is rejected. Everything is DataFrame
functions.

A document is what has a doc_id; rows without one are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, fresh, let, n_chars_in, text_of, words_of

#: Documents of the host beyond which a line is removed.
LINE_DOCS = 50
#: A document is rejected if the removed lines leave fewer words, or less than this share of its words.
LEFT_WORDS = 10
LEFT_PERCENT = 20
#: Limits of the base rules.
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's own counts: doc_id, document, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, width = F.col("text"), WINDOW
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    picked = picked.withColumn("document", document_of(F.col("doc_id"), text))
    read = picked.withColumn("words", words_of(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    keyed = read.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("starts", starts)
    keyed = keyed.withColumn("keys", F.transform("starts", lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(width)])))
    counted = keyed.select(
        "doc_id",
        "document",
        n.cast("long").alias("n_words"),
        (F.length(text) - n_chars_in(text, WHITE)).alias("word_chars"),
        n_chars_in(text, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.col("keys")).alias("keys"),
    )
    return counted.withColumn("n_repeat_words", F.when(F.col("keys").isNull(), F.lit(0).cast("long")).otherwise(_repeats(F.col("keys"), width))).drop("keys")


def _repeats(keys: Column, width: int) -> Column:
    """Words covered by windows whose key stands twice: the keys are sorted with their places, and equal ones are neighbours."""
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    again = lambda placed: F.filter(placed, lambda x, k: same(x, F.get(placed, k - 1)) | same(x, F.get(placed, k + 1)))
    placed = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(F.transform(let(placed, again), lambda x: x["i"]))
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(state: Column, i: Column) -> Column:
        return F.struct((i + width).alias("upto"), (state["n"] + (i + width - F.greatest(state["upto"], i))).alias("n"))

    return F.aggregate(places, begin, add, lambda s: s["n"])


def document_of(doc_id: Column, text: Column) -> Column:
    """The document that a row belongs to: its id, or for a null id its text."""
    return F.struct(doc_id.alias("id"), F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")).alias("text"))


def host_lines(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", copies: bool = True) -> DataFrame:
    """(document, counts, line, n): of every line with a word, the hash of its host and words, and their number.

    ``counts`` is what is counted as a document: the document itself, or without
    ``copies`` the hash of its text.
    """
    host, text = F.col("host"), F.col("text")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), text_of(text_col).alias("text"))
    hashed = lambda w: F.struct(F.xxhash64(host, F.array_join(w, " ")).alias("line"), F.size(w).cast("long").alias("n"))
    lines = F.filter(F.transform(F.split(F.lower("text"), "\n"), words_of), lambda w: F.size(w) > 0)
    document = document_of(F.col("doc_id"), text)
    counts = F.xxhash64(document) if copies else F.xxhash64(text)
    return picked.select(document.alias("document"), counts.alias("counts"), F.explode(F.transform(lines, hashed)).alias("x")).select("document", "counts", "x.line", "x.n")


def removed_words(docs: DataFrame, line_docs: int = LINE_DOCS, host_col: str = "source", copies: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """(document, removed): words of each document's lines above the limit, where there are any."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    lines = scratch.table(host_lines(docs, host_col, copies=copies), "lines")
    often = lines.select("line", "counts").distinct().groupBy("line").agg(F.count("*").alias("docs")).filter(F.col("docs") > line_docs)
    often = scratch.table(often.select("line"), "often")
    return lines.select("document", "line", "n").join(often, "line").groupBy("document").agg(F.sum("n").alias("removed"))


def judged(docs: DataFrame, host_col: str = "source", copies: bool = True) -> DataFrame:
    """``quality`` with the column document besides."""
    scratch = Scratch(docs.sparkSession, "quality")
    removed = scratch.table(removed_words(docs, host_col=host_col, copies=copies, scratch=scratch), "removed")
    own = scratch.table(marks(docs), "marks")
    scratch.keep(own, removed)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    depleted = F.col("removed").isNotNull() & ((left < LEFT_WORDS) | (100 * left < LEFT_PERCENT * F.col("n_words")))
    return own.join(removed, "document", "left").select(*own.columns, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def quality(docs: DataFrame, host_col: str = "source", copies: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept.

    ``copies``: exact copies count as a document each; without it, documents of equal
    text count once, so that copies alone remove no line. A null text has no words and
    fails. A null host is a host. Rows that repeat a doc_id are one document: each is
    judged by its own counts, and their removed lines together. A row with a null doc_id
    is a document by its text and judged like any other. An empty table gives no rows.
    Columns besides doc_id, text and the host are not read.
    """
    return judged(docs, host_col, copies).drop("document")


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return quality(docs)


def keep_good(docs: DataFrame, copies: bool = True) -> DataFrame:
    """The rows of ``docs`` whose document is kept; of rows that repeat a doc_id, all if one is."""
    scratch = Scratch(docs.sparkSession, "quality")
    gone = judged(docs, copies=copies).groupBy("document").agg(F.max("kept").alias("kept")).filter("NOT kept").select("document")
    gone = scratch.table(gone, "gone")
    name = fresh(docs, "document")
    gone = gone.withColumnRenamed("document", name)
    return docs.withColumn(name, document_of(docs["doc_id"].cast("long"), text_of(docs["text"]))).join(gone, name, "left_anti").drop(name)
