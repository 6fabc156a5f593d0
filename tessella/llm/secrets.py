"""Secret scans with an incremental ledger of blobs.

A text is a blob, addressed by its SHA-256; a path is where a version of it stands.
The ledger says which blobs have been scanned under which version of the rules. Only
pairs it lacks are scanned, each blob once however many paths have it, and findings
are joined back to all paths. Everything on the way is DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, let, states_before, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` is shorter than ``least`` are dropped.

    A text without a match of ``gate`` has none of ``pattern``.
    """

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)passw|secret|token|api_?key", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,8}PRIVATE KEY-----", "-----BEGIN "),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", r"xox[abeoprs]-"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}", "k_live_"),
    Rule("signed_claims", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("login_address", r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@", "://"),
)
#: The kinds that the base digest is taken of.
BASE = ("assign", "access", "hex")

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
MATCHES = "array<struct<gap:int,whole:int,kept:boolean>>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def any_gate(text: Column, rules: tuple[Rule, ...]) -> Column:
    found = F.lit(False)
    for rule in rules:
        found = found | text.rlike(rule.gate)
    return found


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans in the text by start, then by the order of the rules; places in code points, the end exclusive."""
    none = F.array().cast(MATCHES)
    found = [F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("kind"), F.when(text.rlike(r.gate), _matches(text, r)).otherwise(none).alias("matches")) for k, r in enumerate(rules)]
    return F.sort_array(F.flatten(F.transform(F.array(*found), lambda r: _spans(r["matches"], r["rank"], r["kind"]))))


def _matches(text: Column, rule: Rule) -> Column:
    """(gap, whole, kept) of each match: the code points since the match before, those of the match, and whether it is long enough."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pairs = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("gap"))
    size = lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), (F.length(x["part"]) >= rule.least).alias("kept"))
    return F.transform(pairs, size).cast(MATCHES)


def _spans(matches: Column, rank: Column, kind: Column) -> Column:
    """The places of the matches that are long enough: each starts after the texts between matches and the matches before it."""

    def placed(before: Column) -> Column:
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), rank.alias("rank"), (at + x["gap"] + x["whole"]).alias("end"), kind.alias("kind"))
        return F.transform(matches, lambda x, i: F.when(x["kept"], span(x, F.get(before, i))))

    before = states_before(F.transform(matches, lambda x: x["gap"] + x["whole"]), F.lit(0), lambda a, b: a + b)
    return F.array_compact(let(before, placed)).cast(SPANS)


class BlobLedger:
    """Scanned blobs with their findings, by version of the rules: one Parquet table under ``folder``.

    A blob's row says at once that it has been scanned and what was found, so an append
    that is lost or only half visible leaves no blob with one and without the other: a
    rerun scans what has no row. Scans that ran at the same time may both add a blob;
    such rows are equal, and one of them counts.
    """

    SCHEMA = f"blob binary, spans {SPANS}, rule_version string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, f"{folder}/blobs"
        spark.createDataFrame([], self.SCHEMA).write.mode("append").partitionBy("rule_version").parquet(self._folder)

    def read(self, version: str) -> DataFrame:
        """(blob, spans) of the blobs scanned under that version; spans is empty if nothing was found."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self._folder)
        return rows.filter(F.col("rule_version") == version).drop("rule_version")

    def findings(self, version: str) -> DataFrame:
        """The rows with findings, each blob once."""
        return self.read(version).filter(F.size("spans") > 0).dropDuplicates(["blob"])

    def append(self, version: str, rows: DataFrame) -> None:
        rows.select("blob", "spans", F.lit(version).alias("rule_version")).write.mode("append").partitionBy("rule_version").parquet(self._folder)


def scan(docs: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger lacks and return (doc_id, spans) for every row of ``docs``.

    A null text is the empty blob and has no spans. Rows that repeat an id or a text
    have the findings each. A null id is a path like any other. An empty table gives no
    rows and appends nothing. Other columns are not read. The ledger's table is all that
    stays of a scan but for what the result reads, the paths and their findings.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    version = rule_version(rules)
    versions = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    blob = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    paths = scratch.table(versions.select("doc_id", blob.alias("blob")), "paths")
    # Written before the anti-join: below it, the sum per blob would take a row from every path.
    blobs = scratch.table(paths.groupBy("blob").agg(F.min("doc_id").alias("_path")), "blobs")
    unseen = scratch.table(blobs.join(ledger.read(version).select("blob"), "blob", "left_anti").withColumnRenamed("blob", "_blob"), "unseen")

    # The text of one path of each unseen blob; a text that no rule's gate lets through has nothing to find and isn't moved.
    gated = versions.filter(any_gate(F.col("text"), rules)).withColumn("blob", blob)
    texts = gated.join(unseen, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_path")), "left_semi")
    found = texts.select("blob", spans_of(F.col("text"), rules).alias("spans")).filter(F.size("spans") > 0)
    found = scratch.table(found.dropDuplicates(["blob"]), "found")
    rows = unseen.join(found, F.col("_blob") == F.col("blob"), "left")
    ledger.append(version, rows.select(F.col("_blob").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans")))
    # Written: a join on its own can be dealt anew where many paths have one blob, and these are the batch's findings only.
    known = scratch.table(ledger.findings(version).join(blobs.select("blob"), "blob", "left_semi"), "known")
    scratch.keep(paths, known)
    return paths.join(known, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = scan(docs, BlobLedger(spark, Scratch(spark, "ledger").path("ledger")))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = _joined(F.filter("spans", lambda s: s["rank"] < len(BASE)))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
