"""Properties of the splitters, against direct restatements on small random matrices."""

import random

import numpy as np
import pytest

from tessella.operators import graph, grouping, metrics, report, split
from tessella.operators.params import Params
from tessella.sources.model import InvalidData, from_array_col, from_long, from_multi_hot, from_wide


def matrix(spark, rows):
    """rows: {instance: set of labels}; labels 0..max."""
    top = max((max(v) for v in rows.values() if v), default=0)
    return from_multi_hot(spark.createDataFrame([(i, [int(k in v) for k in range(top + 1)]) for i, v in rows.items()], "id long, v array<int>"), "id", "v")


def rows_at_random(seed, n=60, labels=5):
    rng = random.Random(seed)
    return {i: {k for k in range(labels) if rng.random() < 0.1 + 0.12 * k} for i in rng.sample(range(500), n)}


def sides(df):
    return {r["instance_id"]: r["split"] for r in df.collect()}


def naive_by_hand(rows, p, batch):
    placed, found = set(), {}
    for label in sorted({k for v in rows.values() for k in v}):
        members = sorted(i for i, v in rows.items() if label in v)
        for at in range(0, len(members), batch):
            free = [i for i in members[at : at + batch] if i not in placed]
            j = round(len(free) * p)
            found |= dict.fromkeys(free[:j], "train") | dict.fromkeys(free[j : 2 * j], "test")
            placed |= set(free)
    return found


def iterative_by_hand(rows, p):
    counts = {k: sum(k in v for v in rows.values()) for k in sorted({k for v in rows.values() for k in v})}
    want = {k: [round(c * p), round(c * (1 - p))] for k, c in counts.items()}
    found = {}
    for label in sorted(counts, key=lambda k: (counts[k], k)):
        for i in sorted(rows):
            if label in rows[i] and i not in found:
                side = 0 if want[label][0] >= want[label][1] else 1
                found[i] = ("train", "test")[side]
                for k in rows[i]:
                    want[k][side] -= 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_naive_and_iterative_by_hand(spark, seed):
    rows = rows_at_random(seed)
    d = matrix(spark, rows)
    for p, batch in ((0.8, 7), (0.3, 10)):
        params = Params(split_size=p, batch_size=batch, shuffle=False)
        assert sides(split.naive(d, params)) == naive_by_hand(rows, p, batch)
    params = Params(split_size=0.7, shuffle=False)
    assert sides(split.iterative(d, params)) == iterative_by_hand({i: v for i, v in rows.items() if v}, 0.7)


def test_naive_excess_can_go_to_test(spark):
    d = matrix(spark, {i: {0} for i in range(10)})
    assert len(sides(split.naive(d, Params(split_size=0.3, shuffle=False)))) == 6
    assert len(sides(split.naive(d, Params(split_size=0.3, shuffle=False, drop_excess=False)))) == 10


def test_extreme_is_total_and_the_same_for_any_partitioning(spark):
    rows = {i: {i % 4, (i * 7) % 5} for i in range(400)}
    d = matrix(spark, rows)
    params = Params(split_size=0.75, num_epochs=3)
    first = sides(split.extreme(d, params))
    assert set(first) == set(rows)
    again = from_long(d.y.repartition(7), "instance_id", "label_id", instances=d.instances.repartition(3))
    assert sides(split.extreme(again, params)) == first
    assert abs(sum(s == "test" for s in first.values()) / 400 - 0.25) < 0.1
    assert set(sides(split.extreme(d, params, keep_best=True))) == set(rows)


def test_parameters_out_of_range_are_replaced():
    p = Params(split_size=1.5, batch_size=0, num_epochs=-1, decay=-2, num_subsamples=3)
    assert (p.split_size, p.batch_size, p.num_epochs, p.decay, p.num_subsamples) == (0.8, 100, 5, 0.1, 100)


def test_girvan_newman_parts_two_cliques():
    edges = [(a, b) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4)]
    neighbours = {i: set() for i in range(8)}
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    assert grouping.girvan_newman(neighbours, 2) == [{0, 1, 2, 3}, {4, 5, 6, 7}]
    assert grouping.betweenness(neighbours)[3, 4] == 16
    assert len(grouping.girvan_newman({i: set() for i in range(5)}, 2)) == 2


def test_propagation_is_the_matrix_product(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random((30, 4)), rng.random((30, 3)) < 0.4
    wide = spark.createDataFrame([(i, *map(float, x[i])) for i in range(30)], "instance_id long, a double, b double, c double, d double")
    d = from_multi_hot(spark.createDataFrame([(i, [int(v) for v in y[i]]) for i in range(30)], "id long, v array<int>"), "id", "v", x=wide)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = u @ u.T
    np.fill_diagonal(a, 0)
    s = 1 / np.sqrt(a.sum(1))
    p, want = np.triu(s[:, None] * a * s[None]), y.astype(float)
    for _ in range(3):
        want = 0.2 * p @ want + 0.8 * y
    got = np.zeros((30, 3))
    for r in graph.propagate(d, 0.2, 3).collect():
        got[r["instance_id"], r["label_id"]] = r["value"]
    assert np.allclose(got, want)


def test_loaders_agree_and_refuse(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b")], "i long, l string")
    arrays = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "i long, l array<string>")
    wide = spark.createDataFrame([(1, 1, 2.0), (2, 0, 1.0), (3, None, 0.0)], "i long, a int, b double")
    want = {(1, 0), (1, 1), (2, 1)}
    for d in (from_long(pairs, "i", "l"), from_array_col(arrays, "i", "l"), from_wide(wide, "i", ["a", "b"])):
        assert {(r[0], r[1]) for r in d.check().y.collect()} == want
    assert from_array_col(arrays, "i", "l").labelled().instances.count() == 2
    with pytest.raises(InvalidData):
        from_array_col(pairs, "i", "l")


def test_empty_tables(spark):
    d = from_array_col(spark.createDataFrame([], "i long, l array<string>"), "i", "l")
    assert metrics.cardinality(d).first()["value"] is None
    assert metrics.distinct_labelsets(d).first()["value"] == 0
    for f in (split.naive, split.iterative, split.extreme):
        assert f(d, Params(num_epochs=1)).count() == 0
    one = matrix(spark, {7: set(), 8: {0}})
    assert report.properties(one, split.naive(one)).count() == 13


def test_stored_sets_and_reports(spark, tmp_path, caplog):
    from tessella.sources.catalog import stored
    from tessella.sources.model import write_parquet, write_tsv

    x = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5)], "instance_id long, a double")
    d = from_array_col(spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "i long, l array<string>"), "i", "l", x=x)
    folder = f"file://{tmp_path}/sets"
    write_parquet(d, f"{folder}/yeast_y", f"{folder}/yeast_X")
    again = stored(spark, folder, "yeast").check()
    assert {tuple(r) for r in again.y.collect()} == {(1, 0), (1, 1), (2, 1)} and again.instances.count() == 3 and again.feature_names() == ["a"]
    with pytest.raises(InvalidData):
        stored(spark, folder, "no such set")
    with caplog.at_level("INFO", logger="tessella"):
        sided = split.iterative(again, Params(shuffle=False))
    assert "split_size=0.75" in caplog.text
    write_tsv(report.properties(again, sided).orderBy("position"), f"file://{tmp_path}/report")
    lines = next((tmp_path / "report").glob("*.csv")).read_text().splitlines()
    assert len(lines) == 14 and lines[0].split("\t") == ["position", "property", "complete", "train", "test"]


def test_groups_are_total_and_as_many_as_asked_for(spark):
    """Labels 0-3 and 4-7 come together; every grouping maps each label once, into the number of groups, and parts the two."""
    rows = {i: {(i % 4) + 4 * (i % 2), ((i // 2) % 4) + 4 * (i % 2)} for i in range(200)}
    d = matrix(spark, rows)
    params = Params(num_clusters=2, num_communities=2, num_subsamples=200)
    for groups in (grouping.communities(d, graph.cooccurrence(d), 2), grouping.spectral_groups(d, d, params)):
        found = {r["label_id"]: r["group_id"] for r in groups.collect()}
        assert sorted(found) == sorted(r["label_id"] for r in d.labels.collect()) and len(set(found.values())) <= 2
    laplacian = np.zeros((8, 8))
    for r in graph.normalized_laplacian(graph.cooccurrence(d)).collect():
        laplacian[r["a"], r["b"]] = r["w"]
    assert np.allclose(laplacian, laplacian.T) and np.linalg.eigvalsh(laplacian).min() > -1e-9


def test_quantile_of_many_scores(spark):
    rng = np.random.default_rng(1)
    scores = np.round(rng.normal(size=500), 9)
    scored = spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "instance_id long, score double")
    params = Params()
    want = max(round(float(np.quantile(scores[scores < 2.0], 1 - 0.1)), 9), 0.0)
    assert split.threshold(scored, params, 2.0, 0, distinct=True) == pytest.approx(want, abs=1e-8) == split.threshold(scored, params, 2.0, 0)


def test_active_models(spark):
    """Gradients of both losses against the formulas, and a share of the most uncertain without a sort in one task."""
    from tessella.operators import active

    rng = np.random.default_rng(2)
    v, y = np.c_[np.ones(40), rng.normal(size=(40, 3))], rng.random((40, 3)) < 0.4
    rows = spark.createDataFrame([(i, v[i].tolist(), [int(k) for k in np.flatnonzero(y[i])]) for i in range(40)], "instance_id long, v array<double>, has array<int>").repartition(3)
    w = rng.normal(size=(3, 4))
    z = v @ w.T
    found = active.gradient(rows, dict(enumerate(w)))
    assert np.allclose(np.stack([found[k] for k in range(3)]), (1 / (1 + np.exp(-z)) - y).T @ v / 40)
    side = 2 * y - 1
    found = active.gradient(rows, dict(enumerate(w)), "hinge")
    assert np.allclose(np.stack([found[k] for k in range(3)]), np.where(side * z < 1, -side, 0).T @ v / 40)
    scores = active.entropy(rows, dict(enumerate(w)))
    best = active.ads(scores, 40, 0.5)
    values = sorted(((-r["uncertainty"], r["instance_id"]) for r in scores.collect()))
    assert {r["instance_id"] for r in best.collect()} == {i for _, i in values[:20]}
    assert "TakeOrderedAndProject" not in best._jdf.queryExecution().executedPlan().toString()
    assert active.ActiveParams(loss_function="none").loss_function == "hinge"


def test_stream_keeps_sides(spark, tmp_path):
    from tessella.streaming.naive import StreamSplitter

    s = StreamSplitter(spark, f"file://{tmp_path}/sides", Params(split_size=0.8, shuffle=False))
    source = tmp_path / "in"
    rows = spark.createDataFrame([(i, i % 3) for i in range(90)], "instance_id long, label_id int")
    rows.coalesce(1).write.parquet(f"file://{source}")
    query = s.start(spark.readStream.schema(rows.schema).parquet(f"file://{source}"), f"file://{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    first = sides(s.sides())
    assert len(first) == 90
    s.add(spark.createDataFrame([(5, 0), (500, 0)], "instance_id long, label_id int"), 99)
    after = sides(s.sides())
    assert {i: after[i] for i in first} == first and 500 in after
