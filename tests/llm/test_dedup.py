"""Exact, near and line dedup against direct restatements."""

import random
import re

import pytest

from tessella.llm import exact_dedup, line_dedup, minhash

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_by_hand(spark, docs_of):
    docs = docs_of([(1, "A b"), (5, "a B"), (3, "a b "), (9, None), (8, ""), (7, "É"), (6, "é")])
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.op3(spark, docs).collect()}
    assert found == {1: (5, 2, False), 5: (5, 2, True), 3: (3, 1, True), 9: (9, 2, True), 8: (9, 2, False), 7: (7, 1, True), 6: (6, 1, True)}
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs).collect()} == {5, 3, 9, 7, 6}


def test_index_persists(spark, docs_of, tmp_path):
    where = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, where, "index_one", buckets=4)
    exact_dedup.exact_groups(docs_of([(1, "x"), (2, "y")]), index).count()
    again = exact_dedup.DigestIndex(spark, where, "index_two", buckets=4)
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs_of([(3, "x"), (4, "z")]), again).collect()}
    assert found == {3: (1, False), 4: (4, True)}
    spark.catalog.refreshTable("index_one")
    assert index.files().count() == 3
    joined = again.table().hint("merge").join(spark.table("index_one").select("digest"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_index_keeps_its_buckets(spark, docs_of, tmp_path):
    """An index that is opened has the buckets it was started with, whatever the session deals by."""
    where = f"file://{tmp_path}/index"
    rows = docs_of([(i, f"text number {i}") for i in range(40)])
    index = exact_dedup.DigestIndex(spark, where, buckets=3)
    assert exact_dedup.exact_groups(rows, index).filter("kept").count() == 40
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, where)
        more = docs_of([(100 + i, f"TEXT number {i}") for i in range(45)])
        found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(more, again).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert again.buckets == 3 and found == {100 + i: (i, False) if i < 40 else (100 + i, True) for i in range(45)}
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, where, buckets=4)
    named = exact_dedup.DigestIndex(spark, name="index_by_name", buckets=2)
    named.add(exact_dedup.digests(rows))
    assert exact_dedup.DigestIndex(spark, name="index_by_name").buckets == 2


def test_no_table_stays(spark, docs_of):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.op3(spark, docs_of([(1, "a"), (2, "A")])).count() == 2 and exact_dedup.keep_first(docs_of([(1, "a"), (2, "A")])).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_texts_without_an_id_stay_once(spark, docs_of):
    docs = docs_of([(None, "alone"), (None, "Twice"), (None, "twice"), (None, "with id"), (4, "with id"), (5, "other")])
    index = exact_dedup.DigestIndex(spark)
    stay = lambda found: sorted((str(r["doc_id"]), r["text"].lower()) for r in found.collect())
    want = [("4", "with id"), ("5", "other"), ("None", "alone"), ("None", "twice")]
    assert stay(exact_dedup.keep_first(docs)) == want and stay(exact_dedup.keep_first(docs, index)) == want
    assert stay(exact_dedup.keep_first(docs_of([(None, "alone"), (7, "alone"), (None, "new")]), index)) == [("None", "new")]


def shingles(text, width=2):
    words = (text or "").translate(A_TO_Z).encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1))))


def components(texts, width=2):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                a2, b2 = sorted((find(a), find(b)))
                root[b2] = a2
    return {i: find(i) for i in ids}, sets


def near(spark, docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op9(spark, docs).collect()}


def check_near(spark, docs, texts):
    want, sets = components(texts)
    assert near(spark, docs) == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def test_near_on_documents(spark, documents, texts):
    check_near(spark, documents, texts)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def test_near_chains_and_crowds(spark, docs_of):
    """A chain whose ends aren't linked, a crowd of near copies around the threshold, and a crowd that only shares a part."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    words = list(base)
    for i in range(12):
        texts[i] = " ".join(words)
        words = [*words[8:], *[f"c{i}_{k}" for k in range(8)]]
    crowd = [f"x{i}" for i in range(200)]
    for i in range(100, 180):
        texts[i] = " ".join(edited(rng, crowd, rng.choice([0.01, 0.03, 0.06])))
    for i in range(200, 260):
        texts[i] = " ".join([*(f"p{k}" for k in range(60)), *(f"q{i}_{k}" for k in range(rng.choice([10, 25, 60])))])
    texts |= {300: "one", 301: "ONE", 302: "", 303: None, 304: "one two", 305: "One Two", 306: "two one"}
    check_near(spark, docs_of([*texts.items()]), texts)


def test_small_sets_at_the_threshold_are_found(spark, docs_of):
    """Recall of the bands where a set is small: every pair of 4 in 5 shingles."""
    texts = {}
    for i in range(0, 600, 2):
        words = [f"v{i}_{k}" for k in range(6)]
        texts[i], texts[i + 1] = " ".join(words), " ".join(words[:5])
    found = near(spark, docs_of([*texts.items()]))
    assert all(found[i + 1][1] == i for i in range(0, 600, 2))


def test_just_under_the_threshold(spark, docs_of):
    """A crowd of which no two are linked is compared pair by pair, but a set is sent once for each block."""
    rng = random.Random(3)
    texts = {}
    for i in range(1200):
        words = [f"x{k}" for k in range(60)]
        for k in rng.sample(range(2, 60, 2), 4):
            words[k] = f"r{i}_{k}"
        texts[i] = " ".join(words)
    texts[1200] = texts[7].replace("x59", "last")
    found = near(spark, docs_of([*texts.items()]))
    assert {i for i, r in found.items() if not r[2]} == {1200} and found[1200][1] == 7


def test_forest():
    forest = minhash.Forest()
    assert [forest.join(a, b) for a, b in ((1, 2), (3, 4), (2, 1), (4, 1), (3, 2), (5, 5))] == [True, True, False, True, False, False]


def test_five_words_by_default(spark, docs_of):
    """Nine words, one replaced in the middle: pairs of words are alike enough there, five words aren't."""
    words = [f"w{k}" for k in range(40)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join([*words[:20], "x", *words[21:]]))])
    assert [r["component_id"] for r in minhash.near_groups(docs, width=2).orderBy("doc_id").collect()] == [1, 1]
    assert [r["component_id"] for r in minhash.near_groups(docs).orderBy("doc_id").collect()] == [1, 2]


def test_keep_one(spark, docs_of):
    docs = docs_of([(3, "a b c d e f"), (2, "A b c d e f"), (9, "other words here"), (None, "a b c d e f")])
    assert sorted(str(r["doc_id"]) for r in minhash.keep_one(docs).collect()) == ["2", "9", "None"]


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def dropped_by_hand(texts):
    """Equal lines of any length; lines an edit away if both have five words or more."""
    seen, found = [], {}
    for i in sorted(texts):
        gone = []
        for k, line in enumerate((texts[i] or "").split("\n")):
            words = line.lower().encode().split()
            if not words:
                continue
            equal = words in seen
            if equal or (len(words) >= 5 and any(len(s) >= 5 and one_edit(words, s) for s in seen)):
                gone.append((k, not equal))
            if not equal:
                seen.append(words)
        found[i] = gone
    return found


def test_lines_by_hand(spark, docs_of, documents, texts):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(30)]
    made = {}
    for i in range(50):
        lines = []
        for _ in range(6):
            words = base[: rng.randint(3, 9)]
            for _ in range(rng.randint(0, 2)):
                at, do = rng.randrange(len(words) + 1), rng.randrange(3)
                words = words[:at] + ([] if do == 0 else [rng.choice("abc")]) + words[at + (do != 1) :]
            lines.append(" ".join(words))
        made[i] = "\n".join(lines)
    made |= {60: None, 61: "", 62: "\n\n", 63: made[0], 64: made[0].upper()}
    for docs, of in ((docs_of([*made.items()]), made), (documents, texts)):
        want = dropped_by_hand(of)
        for r in line_dedup.op10(spark, docs).collect():
            gone = want[r["doc_id"]]
            n_lines = (of[r["doc_id"]] or "").count("\n") + 1
            assert (r["dropped"], r["n_near"], r["n_exact"]) == (",".join(str(k) for k, _ in gone), sum(n for _, n in gone), sum(not n for _, n in gone))
            assert (r["n_lines"], r["n_kept"]) == (n_lines, n_lines - len(gone))
    clean = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs_of([(1, "a b c d e\nx"), (2, "y\na b c d f"), (3, None)])).collect()}
    assert clean == {1: "a b c d e\nx", 2: "y", 3: None}


def test_short_repeats_go(spark, docs_of):
    docs = docs_of([(1, "All rights reserved\nhome"), (2, "all  rights reserved\nhome\n\nall rights reversed"), (3, "Home")])
    found = {r["doc_id"]: (r["dropped"], r["n_exact"], r["n_near"]) for r in line_dedup.op10(spark, docs).collect()}
    assert found == {1: ("", 0, 0), 2: ("0,1", 2, 0), 3: ("0", 1, 0)}


def test_words_of_lines_are_told_by_any_white_space(spark, docs_of):
    """Lines are those of a pattern for each line; without other white space than single blanks and line feeds none is run."""
    rng = random.Random(4)
    made = {1: None, 2: "", 3: " \n\n  \t", 4: "a  b\tc \r\nd\x0be\x0cf \n\x0b\n g", 5: "\ta b ", 6: "É É\xa0x\u2003y\x85z\x1cw"}
    made |= {10 + i: "".join(rng.choice(["a", "B", "é", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\xa0", "  "]) for _ in range(20)) for i in range(400)}
    made |= {500 + i: "".join(rng.choice(["a", "bc", " ", "\n"]) for _ in range(8)) for i in range(200)}
    lines = line_dedup.lines_of(docs_of([*made.items()]))
    want = set()
    for i, text in made.items():
        for k, line in enumerate((text or "").lower().split("\n")):
            if words := [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]:
                want.add((i, k, len(words), " ".join(words)))
    assert {tuple(r) for r in lines.collect()} == want
    assert {tuple(r) for r in line_dedup.lines_of(docs_of([*made.items()]), 3).collect()} == {x for x in want if x[2] >= 3}
    # No function that calls itself for each word or line: the plan is generated code throughout.
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("split(") == 1


def test_long_lines(spark, docs_of):
    """A line of 30000 words with one replaced: the passes over a line are linear in its words."""
    words = [f"w{k}" for k in range(30_000)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join([*words[:20_000], "other", *words[20_001:]])), (3, " ".join(words[1:])), (4, " ".join(words[2:]))])
    assert {r["doc_id"]: r["dropped"] for r in line_dedup.op10(spark, docs).collect()} == {1: "", 2: "0", 3: "0", 4: "0"}
