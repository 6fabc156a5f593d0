"""Licence scans: ordered signature rules behind a prefilter.

A text is brought to its words. The few texts that contain a gate go through the
rules of the gates they contain; each match is an interval of words. A detection
inside another of higher rank is suppressed in one pass over the intervals by start:
whatever contains an interval comes before it, so the largest end of each priority so
far is all that has to be kept. A document is scanned within its row, without a
shuffle, by DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import let, lower_ascii, states_before, text_of
from tessella.llm.license_rules import RULES, SCORES, STEMS, Rule

#: Anything that isn't part of a word, after lower-casing A to Z.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: What a fixed phrase alone is worth.
PHRASE_SCORE = 0.5

DETECTIONS = "array<struct<start:int,neg_end:int,neg_priority:int,rank:int,label:string>>"


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _matches(norm: Column, rule: Column) -> Column:
    """The rule's leftmost matches as intervals of words."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))
    whole = F.regexp_extract_all(norm, pattern, F.lit(0))
    pairs = F.arrays_zip(whole.alias("whole"), F.slice(F.split(norm, pattern, -1), 1, F.size(whole)).alias("gap"))
    sizes = F.transform(pairs, lambda x: F.struct(_blanks(x["gap"]).alias("gap"), _blanks(x["whole"]).alias("whole")))

    def placed(sizes: Column, before: Column) -> Column:
        end = lambda x, at: at + x["gap"] + x["whole"]
        one = lambda x, at: F.struct((at + x["gap"]).alias("start"), (-end(x, at)).alias("neg_end"), (-rule["priority"]).alias("neg_priority"), rule["rank"].alias("rank"), rule["label"].alias("label"))
        return F.transform(sizes, lambda x, i: one(x, F.get(before, i)))

    before = lambda sizes: states_before(F.transform(sizes, lambda x: x["gap"] + x["whole"]), F.lit(0), lambda a, b: a + b)
    return let(sizes, lambda s: let(before(s), lambda b: placed(s, b))).cast(DETECTIONS)


def detections(norm: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """What is left of the rules' matches after suppression, by start."""
    by_gate: dict[str, list[Column]] = {}
    for k, r in enumerate(rules):
        row = F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.pattern).alias("pattern"), F.lit(k).alias("rank"))
        by_gate.setdefault(r.gate, []).append(row)
    table = F.array(*[F.struct(F.lit(f" {gate}").alias("gate"), F.array(*rows).alias("rules")) for gate, rows in by_gate.items()])
    tried = F.flatten(F.transform(F.filter(table, lambda t: F.contains(norm, t["gate"])), lambda t: t["rules"]))
    found = F.sort_array(F.flatten(F.transform(tried, lambda r: _matches(norm, r))))
    levels = len(SCORES)
    ends = lambda x: F.array(*[F.when(-x["neg_priority"] == k, -x["neg_end"]).otherwise(-1) for k in range(levels)])
    larger = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))
    covered = lambda x, before: F.exists(F.slice(before, 1 - x["neg_priority"], levels), lambda e: e >= -x["neg_end"])
    before = lambda found: states_before(F.transform(found, ends), F.array(*[F.lit(-1)] * levels), larger)
    return let(found, lambda f: let(before(f), lambda b: F.filter(f, lambda x, i: ~covered(x, F.get(b, i)))))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stems: tuple[str, ...] = STEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    n_base counts the places of the fixed phrases; first_word and last_word are the
    smallest and largest word they start at, null without one. ``stems``: strings one of
    which every rule's gate contains. detections are intervals
    of words with their label. A null or empty text has no words, no labels ("") and
    score 0. A null id stays null, repeated rows are scanned each, an empty table gives
    no rows, other columns are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    split = picked.select("doc_id", F.array_remove(F.split(lower_ascii(F.col("text")), NOT_WORD), "").alias("words"))
    read = split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("norm"))
    norm = F.col("norm")

    pieces = read.select("*", *[F.when(F.contains(norm, F.lit(f" {p} ")), F.split(norm, f" {p}(?= )", -1)).alias(f"_cut{k}") for k, p in enumerate(PHRASES)])
    n_base, firsts, lasts, labels = F.lit(0), [], [], []
    for k, (phrase, label) in enumerate(PHRASES.items()):
        cut = F.col(f"_cut{k}")
        n_base = n_base + F.when(cut.isNotNull(), F.size(cut) - 1).otherwise(0)
        firsts.append(_blanks(F.get(cut, F.lit(0))))
        lasts.append(F.col("n_words") - _blanks(F.element_at(cut, -1)) + 1 - len(phrase.split()))
        labels.append(F.when(cut.isNotNull(), label))
    gate = F.lit(False)
    for stem in stems:
        gate = gate | F.contains(norm, F.lit(stem))
    based = pieces.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("_base"),
        F.when(gate, detections(norm, rules)).otherwise(F.array().cast(DETECTIONS)).alias("_found"),
    )
    own = F.transform("_found", lambda x: x["label"])
    scores = F.array(*map(F.lit, SCORES))
    best = F.array_max(F.transform("_found", lambda x: F.get(scores, -x["neg_priority"])))
    return based.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", own))), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(PHRASE_SCORE)).otherwise(0.0)).alias("score"),
        F.transform("_found", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["neg_end"]).alias("end"))).alias("detections"),
    )


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs).drop("detections")
