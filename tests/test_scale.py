"""That steps are shaped for large tables, and give what a plain restatement gives."""

import numpy as np
import pytest

from tessella.catalog import QUERIES
from tessella.operators import graph, grouping
from tessella.plans import numbering
from tessella.queries.splits import QUICK
from tessella.sources.catalog import order_brand
from tessella.sources.model import from_multi_hot


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cosine_pairs_multiplies_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 3))
    v[7] = 0
    ids = [int(i) for i in rng.permutation(200)[:88]] + [3, 3]
    x = spark.createDataFrame([(i, *map(float, r)) for i, r in zip(ids, v, strict=True)] + [(None, 1.0, 1.0, 1.0)], "instance_id long, p double, q double, r double")
    found = graph.cosine_pairs(x, ["p", "q", "r"], blocks=2, rows=16)
    u = v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
    want = sorted((a, b, round(float(s @ t), 9) + 0.0) for a, s in zip(ids, u, strict=True) for b, t in zip(ids, u, strict=True) if a <= b)
    assert sorted((r["a"], r["b"], round(r["w"], 9) + 0.0) for r in found.collect()) == want
    # Vectors aren't joined pair by pair, and no pair of blocks is formed twice.
    assert "Join" not in plan(found)


def test_scumble_brings_no_label_to_one_task(spark, sf):
    from tessella.operators.metrics import corrected_scumble
    from tessella.sources.catalog import order_type

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(corrected_scumble(order_type(spark, sf)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # Instances would be dealt by their label for such a join.
    assert not [line for line in found.splitlines() if "SortMergeJoin [label_id" in line and "Inner" in line]


def frame(spark):
    """Odd rows: an instance without labels, one with labels that isn't listed, one without features."""
    from tessella.sources.model import MultiLabelFrame

    y = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (9, 2), (4, 0)], "instance_id long, label_id int")
    x = spark.createDataFrame([(1, 1.0, 2), (2, 3.0, 4), (3, 5.0, 6)], "instance_id long, a double, b int")
    labels = spark.createDataFrame([(i, str(i)) for i in range(4)], "label_id int, label_name string")
    return MultiLabelFrame(y, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "instance_id long"), labels, x)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_held_frame_is_the_frame(spark):
    d = frame(spark)
    take = spark.createDataFrame([(1,), (9,)], "instance_id long")
    for plain, held in ((d, d.hold()), (d.labelled(), d.hold().labelled()), (d.take(take), d.hold().take(take))):
        for name in ("y", "instances", "labels", "x"):
            assert rows(getattr(plain, name)) == rows(getattr(held, name)), name
        assert plain.x.columns == held.x.columns
    groups = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "label_id int, group_id int")
    assert rows(grouping.reassign(d, groups).y) == rows(grouping.reassign(d.hold(), groups).y)


@pytest.mark.parametrize("kind", [int, float])
def test_kth_by_counts(spark, kind):
    rng = np.random.default_rng(1)
    values = [kind(v) for v in (*rng.integers(-(2**62), 2**62, 50), *[7] * 20, *rng.integers(-9, 9, 30), *rng.normal(size=20) * 1e3)]
    df = spark.createDataFrame([(v,) for v in values], f"v {'long' if kind is int else 'double'}")
    placed = sorted(values)
    for k in (1, 2, 40, 60, len(values)):
        v = placed[k - 1]
        assert numbering.kth(df, "v", k) == (v, sum(w < v for w in values), values.count(v))
    assert numbering.kth(df, "v", len(values) + 1) is None


def test_propagation_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 7)
    monkeypatch.setattr(graph, "STRIP", 3)
    rng = np.random.default_rng(3)
    x, y = rng.random((50, 4)), rng.random((50, 3)) < 0.4
    wide = spark.createDataFrame([(i, *map(float, x[i])) for i in range(50)], "instance_id long, a double, b double, c double, d double")
    d = from_multi_hot(spark.createDataFrame([(i, [int(v) for v in y[i]]) for i in range(50)], "id long, v array<int>"), "id", "v", x=wide)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = u @ u.T
    np.fill_diagonal(a, 0)
    s = 1 / np.sqrt(a.sum(1))
    p, want = np.triu(s[:, None] * a * s[None]), y.astype(float)
    for _ in range(4):
        want = 0.2 * p @ want + 0.8 * y
    got = np.zeros((50, 3))
    for r in graph.propagate(d, 0.2, 4).collect():
        got[r["instance_id"], r["label_id"]] = r["value"]
    assert np.allclose(got, want)


@pytest.mark.parametrize("name", ["report_properties", "active_ads_topk", "label_propagation_3", "chain_classifier"])
def test_tables_are_read_before_the_result(spark, sf, name):
    assert "lineitem" not in plan(QUERIES[name](spark, sf))


def test_splitters_get_held_frames(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(grouping, "splitter", lambda kind: lambda d, params: seen.append(d.held))
    splitter = grouping.GroupSplitter("plssvd", QUICK)
    splitter.fit(order_brand(spark, sf))
    assert seen[0] is not None and "lineitem" not in plan(seen[0])
