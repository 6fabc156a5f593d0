"""The pipeline against its stages restated over plain rows, and queries against their SQL."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from oracle import rows_of, rows_of_sql
from test_dedup import A_TO_Z, components
from test_rules import copies_by_hand, marks_by_hand, removed_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import pieces, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(duck, queries.ORACLES[name])


def test_pipeline_by_hand(spark, sf, documents):
    """Exactly the documents that the five stages leave, as often as they do, and the library's ids of each."""
    rows = {r["doc_id"]: r for r in documents.collect()}
    of = {i: r["text"] or "" for i, r in rows.items()}
    gone, kept = removed_by_hand(of, {i: r["source"] for i, r in rows.items()}, quality.LINE_DOCS, copies=False), set()
    for i, t in of.items():
        m = marks_by_hand(t)
        left = m[0] - gone.get(i, 0)
        if m[0] >= 10 and 100 * m[4] <= 20 * m[0] and not (gone.get(i) and (left < 10 or 100 * left < 20 * m[0])):
            kept.add(i)
    last = {}
    for i in kept:
        k = of[i].translate(A_TO_Z)
        last[k] = max(i, last.get(k, i))
    root, _ = components({i: of[i] for i in last.values()}, width=5)
    stay = {i for i, r in root.items() if i == r}
    want = copies_by_hand({i: (rows[i]["source"], len(of[i].encode().split())) for i in stay})
    found = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({i: n for i, n in want.items() if n})
    library = Tokenizer.from_file(pieces.public_path("byte_bpe_50k.json"))
    for r in found:
        ids = np.array(library.encode(of[r["doc_id"]], add_special_tokens=False).ids, "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(of[r["doc_id"]].encode()).hexdigest())
