"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows, and columns with the operators' own names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, exact_dedup, licenses, line_dedup, minhash, mixing, quality, secrets, token_counts, token_store

OPS = {
    "op1": licenses.op1, "op2": token_counts.op2, "op3": exact_dedup.op3, "op4": token_store.op4, "op5": quality.op5,
    "op6": bpe.op6, "op7": secrets.op7, "op8": mixing.op8, "op9": minhash.op9, "op10": line_dedup.op10,
}
FILTERS = {"exact": exact_dedup.keep_first, "near": minhash.keep_one, "quality": quality.keep_good, "mix": mixing.mix, "lines": line_dedup.clean}
LONG = "password = abcdefghijklmnop mit license one two three four five six " * 4000
CLASHES = ("id", "_id", "words", "line", "key", "root", "cid", "size", "digest", "keep_id", "gone", "copies", "copy", "blob", "spans", "shard", "ids", "place", "bands", "norm", "target", "kept")


SAME = "the same words in a row again and again"
GOOD = " ".join(f"word{k}" for k in range(30))


@pytest.fixture(scope="module")
def odd(docs_of):
    rows = [(None, None, None), (None, "some words of no id here", "a"), (1, None, None), (2, "", "a"), (3, " \t\n\x0b\r ", "a"), (4, LONG, "b"), (5, "x" * 200_000, "b")]
    rows += [(6, "the same words in a row again and again", "a")] * 3 + [(7, "the same words in a row again and again", None), (8, "THE SAME words in a row again and again", "b"), (8, "another text of one id", "b")]
    rows += [(9, "�\u0000 \U0001f600 é  <|endoftext|> İ", "é"), (10, "single", "a"), (-5, "negative id and some words", "a"), (11, GOOD, "a"), (None, f"{GOOD} too", "a")]
    found = docs_of(rows)
    return found.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, odd, name):
    found = OPS[name](spark, odd)
    assert found.count() == odd.count()
    assert sorted(str(r[0]) for r in found.select("doc_id").collect()) == sorted(str(r[0]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPS)
def test_no_rows(spark, odd, name):
    assert OPS[name](spark, odd.filter("doc_id = 77")).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, odd, name):
    found = FILTERS[name](odd)
    assert found.columns == odd.columns and found.dtypes == odd.dtypes
    rows = Counter((r["doc_id"], (r["text"] or "")[:40]) for r in found.collect())
    every = Counter((r["doc_id"], (r["text"] or "")[:40]) for r in odd.collect())
    if name == "exact":  # of the empty texts the largest id's, of the same words too, and all that stand alone, with an id or without
        gone = {(None, ""): 1, (1, ""): 1, (6, SAME[:40]): 3, (7, SAME[:40]): 1}
        assert rows == every - Counter(gone)
    elif name == "near":  # 7 has the words of 6, and so has 8, whose other text goes with it; without an id or words a row stays
        assert rows == every - Counter({k: n for k, n in every.items() if k[0] in (7, 8)})
    elif name == "quality":  # all but two have too few words or repeat them
        assert rows == Counter({(11, GOOD[:40]): 1, (None, GOOD[:40]): 1})
    elif name == "mix":
        assert rows and rows.keys() <= every.keys() and all(n <= 3 * every[k] for k, n in rows.items())
    else:  # 7 and 8 lose the line that 6 has, whose rows are one place, as those of 8 are; a row without an id is before 11, whose text is one word shorter
        lost = [(7, SAME), (8, SAME.replace("the same", "THE SAME")), (8, "another text of one id"), (11, GOOD)]
        assert rows == every - Counter((i, t[:40]) for i, t in lost) + Counter((i, "") for i, _ in lost)
    assert FILTERS[name](odd.filter("doc_id = 77")).count() == 0


def test_pipeline_is_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "minhash_dedup", "mixing", "bpe"]
