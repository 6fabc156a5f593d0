"""Line dedup within one edit, by a join of deletion neighbourhoods.

A line is dropped if an earlier line, by doc_id and place, is equal or one edit away:
a word put in, taken out or replaced. Lines are compared by their words in lower case.
All lines with a word are compared for equality; the edit bound is one word for lines of
MIN_WORDS words or more, of which an edit leaves four in five, and none for shorter ones.

Every line stands for the patterns it matches with a hole at some place: with one word
taken out there, or with nothing there. Lines that share a pattern are all one edit
apart from each other, so a bucket needs its earliest line only and no pairs are
listed. Two lines one edit apart also share two thirds of their words, the third with
the edit left out; a line that shares no two thirds with another is set aside before
patterns are made, and the others make patterns with a hole in the odd third only.
What a pattern's hash suggests is verified on the words.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, fresh, states_before, text_of

#: Words from which on a line may be an edit away from another.
MIN_WORDS = 5


NO_ID = -(2**63)
_LINES = 2**31

#: White space that stands within a line, but for the blank, and runs that aren't one blank already.
_OTHER_BLANKS = "\t\v\f\r"
_RUNS = r"\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20{2,}"


def place(doc_id: Column, line_no: Column) -> Column:
    """A number that orders lines by doc_id, null first, and place; a number, so that its minimum is found by hashing."""
    return F.coalesce(doc_id, F.lit(NO_ID)).cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(11,0)") + line_no.cast("decimal(10,0)")


def doc_of(at: Column) -> Column:
    """The doc_id of a place, NO_ID for null."""
    return F.floor((at - F.pmod(at, F.lit(_LINES).cast("decimal(11,0)"))) / F.lit(_LINES).cast("decimal(11,0)")).cast("long")


def single_blanks(text: Column) -> Column:
    """The text with one blank for each run of white space within a line. Only texts that have other runs meet the pattern."""
    odd = F.contains(text, F.lit("  "))
    for c in _OTHER_BLANKS:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, _RUNS, " ")).otherwise(text)


def lines_of(docs: DataFrame, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, n, norm) of the lines with so many words: their number, and the words with single blanks between."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_of(text_col)).alias("text"))
    each = picked.select("doc_id", F.posexplode(F.split(single_blanks(F.col("text")), "\n")).alias("line_no", "line"))
    each = each.select("doc_id", "line_no", F.trim("line").alias("norm")).filter("norm <> ''")
    n = (F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("int")
    each = each.select("doc_id", "line_no", n.alias("n"), "norm")
    return each.filter(F.col("n") >= min_words) if min_words > 1 else each


def digest(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _thirds(n: Column) -> tuple[Column, Column]:
    return F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")


def _words(norm: Column, count: Column) -> Column:
    """The first words of a normalised line, or the last if ``count`` is negative."""
    return F.call_function("substring_index", norm, F.lit(" "), count)


def thirds(norm: Column, n: Column, least: int) -> list[Column]:
    """Keys of two thirds of the line, without the last, the middle and the first third; null if a line is too short.

    The first three take the line as the shorter of two or one of the same length: its
    ``n`` words are cut. The others take it as the longer: the cuts are those of one word
    less, and the word more is in the third left out.
    """
    found = []
    for base in (n, n - 1):
        a, b = _thirds(base)
        parts = [_words(norm, b), F.concat(_words(norm, a), F.lit(" "), _words(norm, b - base)), _words(norm, a - base)]
        found += [F.when(base >= least, F.xxhash64(F.lit(k), base, part)) for k, part in enumerate(parts)]
    return found


def patterns(texts: DataFrame) -> DataFrame:
    """(place, pattern) of (place, n, words, shared): keys of the lines' patterns with a hole in the thirds that ``shared`` says.

    ``shared`` holds numbers of the keys of ``thirds``. A pattern's key hashes the hole's
    place, the words before it and after it, and their number. Each word is hashed with
    its place, from the start for the words before a hole and from the end for those after
    it, and the hashes are joined bit by bit, so that all beginnings and ends of a line
    are had from two passes.
    """
    either = lambda x, y: x.bitwiseXOR(y)
    none_yet = F.lit(0).cast("long")
    upto = lambda hashes: states_before(F.concat(hashes, F.array(none_yet)), none_yet, either)
    texts = texts.withColumn("before", upto(F.transform("words", lambda w, i: F.xxhash64(i, w))))
    texts = texts.withColumn("behind", upto(F.transform("words", lambda w, i: F.xxhash64(w, F.col("n") - i))))
    after = lambda p: either(F.get("behind", F.col("n")), F.get("behind", p))
    n = F.col("n")
    a, b = _thirds(n)
    c, d = _thirds(n - 1)
    none = F.array().cast("array<int>")
    span = lambda k, low, high: F.when(F.array_contains("shared", F.lit(k)) & (low <= high), F.sequence(low, high)).otherwise(none)
    zero = F.lit(0)
    gaps = F.concat(span(0, b, n), span(1, a, b), span(2, zero, a))
    taken = F.concat(span(0, b, n - 1), span(1, a, b - 1), span(2, zero, a - 1), span(3, d, n - 1), span(4, c, d), span(5, zero, c))
    chained = texts.select("place", "n", "before", "behind", F.array_distinct(gaps).alias("gaps"), F.array_distinct(taken).alias("taken"))
    keys = F.concat(
        F.transform("gaps", lambda p: F.xxhash64(p, n, F.get("before", p), after(p))),
        F.transform("taken", lambda p: F.xxhash64(p, n - 1, F.get("before", p), after(p + 1))),
    )
    return chained.select("place", F.explode(keys).alias("pattern"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether the two arrays are one edit apart; ``b`` is as long as ``a`` or one longer."""
    differ = F.array_position(F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: x != y), True)
    at = F.when(differ == 0, F.size(a) + 1).otherwise(differ).cast("int")
    skip = at + F.when(F.size(a) == F.size(b), 1).otherwise(0)
    return F.slice(a, skip, F.size(a)) == F.slice(b, at + 1, F.size(b))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, near) of every line to drop; near: no earlier line is equal, but one is an edit away.

    Narrow tables that grow with the corpus are joined by sort and merge at any size.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    names = [f"k{i}" for i in range(6)]
    every = lines_of(docs)
    keys = [k.alias(name) for k, name in zip(thirds(F.col("norm"), F.col("n"), min_words), names, strict=True)]
    every = scratch.table(every.select("doc_id", "line_no", digest(F.col("norm")).alias("line"), *keys), "lines")
    at = place(F.col("doc_id"), F.col("line_no"))
    first = every.groupBy("line", *names).agg(F.min(at).alias("place"), (F.count("*") > 1).alias("repeated"))
    first = scratch.table(first.withColumn("id", F.monotonically_increasing_id()), "first")

    # Lines that share two thirds with another line, and which. A key's first and last line are known from its sums;
    # only keys of three lines or more are looked up again.
    parts = F.array(*[F.struct(F.col(name).alias("key"), (F.col("id") * 8 + k).alias("of")) for k, name in enumerate(names)])
    spread = first.select(F.explode(F.filter(parts, lambda x: x["key"].isNotNull())).alias("x")).select("x.key", "x.of")
    shared = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("of").alias("low"), F.max("of").alias("high")).filter("n > 1")
    shared = scratch.table(shared, "shared")
    more = spread.join(shared.filter("n > 2").select("key").hint("merge"), "key", "left_semi").select("of")
    ends = shared.filter("n = 2").select(F.explode(F.array("low", "high")).alias("of"))
    active = more.unionByName(ends).select(F.shiftright("of", 3).alias("id"), F.col("of").bitwiseAND(F.lit(7)).cast("int").alias("k"))
    active = scratch.table(active.groupBy("id").agg(F.collect_set("k").alias("shared")), "active")

    # Their words, from the first place of each.
    where = scratch.table(first.select("id", "line", "place").join(active.hint("merge"), "id").select("line", "place", "shared"), "where")
    ids = scratch.table(where.select(doc_of(F.col("place")).alias("_id")).distinct(), "ids")
    again = lines_of(docs.join(ids, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == ids["_id"], "left_semi"), min_words)
    again = again.select("n", "norm", at.alias("place"), digest(F.col("norm")).alias("line"))
    texts = again.join(where, ["line", "place"]).dropDuplicates(["line", "place"])
    texts = scratch.table(texts.select("line", "place", "n", "shared", F.split("norm", " ").alias("words")), "words")

    holes = scratch.table(patterns(texts), "holes")
    earliest = holes.groupBy("pattern").agg(F.min("place").alias("earliest"), F.max("place").alias("latest")).filter("earliest < latest").drop("latest")
    earliest = scratch.table(earliest, "earliest")
    pairs = scratch.table(holes.join(earliest.hint("merge"), "pattern").filter("earliest < place").select("place", "earliest").distinct(), "pairs")
    both = pairs.join(texts.select("line", "place", F.col("words").alias("own")), "place").join(texts.select(F.col("place").alias("earliest"), F.col("words").alias("other")), "earliest")
    longer = F.size("own") >= F.size("other")
    verified = both.filter(one_edit(F.when(longer, F.col("other")).otherwise(F.col("own")), F.when(longer, F.col("own")).otherwise(F.col("other"))))
    near = scratch.table(verified.select("line", "place").distinct(), "near")

    # Only lines that stand twice or have a near one are of interest now.
    marked = first.filter("repeated").select("line", "place", F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))
    marked = scratch.table(marked.groupBy("line").agg(F.min("place").alias("first"), F.max("near").alias("near")), "marked")
    scratch.keep(every, marked)
    found = every.select("doc_id", "line_no", "line", at.alias("place")).join(marked.hint("merge"), "line")
    repeat = F.col("place") > F.col("first")
    return found.filter(repeat | F.col("near")).select("doc_id", "line_no", (~repeat).alias("near"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_exact, n_near, n_kept, dropped.

    dropped lists the numbers of the dropped lines, from 0. A null text has one empty
    line. Blank lines always stay; lines of fewer than ``min_words`` words go if they are
    equal to an earlier one. Rows that repeat a doc_id are the same
    place: neither is earlier, and they share the union of their dropped lines. Null ids
    come first and are one place. An empty table gives no rows. Other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = dropped_lines(docs, min_words).groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "line_no").agg(F.max("near").alias("near"))
    gone = gone.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "near"))).alias("gone"))
    gone = scratch.table(gone, "gone")
    text = text_of("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    found = own.join(gone, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_id"), "left")
    all_gone = F.coalesce("gone", F.array().cast("array<struct<line_no:int,near:boolean>>"))
    found = found.withColumn("gone", F.filter(all_gone, lambda x: x["line_no"] < F.col("n_lines")))
    n_near = F.size(F.filter("gone", lambda x: x["near"])).cast("long")
    size = F.size("gone").cast("long")
    numbers = F.array_join(F.transform("gone", lambda x: x["line_no"].cast("string")), ",")
    return found.select("doc_id", "n_lines", (size - n_near).alias("n_exact"), n_near.alias("n_near"), (F.col("n_lines") - size).alias("n_kept"), numbers.alias("dropped"))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return line_dedup(docs)


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with the dropped lines taken out of their texts."""
    id_name, gone = fresh(docs, "id"), fresh(docs, "gone")
    found = line_dedup(docs, min_words).filter("dropped <> ''").select(F.col("doc_id").alias(id_name), F.split("dropped", ",").cast("array<int>").alias(gone)).dropDuplicates([id_name])
    joined = docs.join(Scratch(docs.sparkSession, "lines").table(found, "found"), docs["doc_id"].eqNullSafe(F.col(id_name)), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
