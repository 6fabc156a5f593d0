"""Grouping labels, and splitting by groups of labels instead of labels.

What depends on instances is aggregated on the executors; what reaches the driver has
the size of the label dimension squared, or features times labels. ``MAX_LABELS`` is
checked before.
"""

from __future__ import annotations

import logging
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.rand import bootstrap
from tessella.functions.scalar import optimal_step
from tessella.operators.graph import cooccurrence, normalized_laplacian, product, propagate, upper_triangle
from tessella.operators.params import Params
from tessella.operators.split import splitter
from tessella.plans.scratch import Scratch
from tessella.sources.model import InvalidData, MultiLabelFrame

log = logging.getLogger(__name__)

#: Largest label dimension whose square is brought to the driver.
MAX_LABELS = 5000


def _label_ids(d: MultiLabelFrame) -> list[int]:
    if (n := d.labels.count()) > MAX_LABELS:
        raise InvalidData(f"{n} labels; groups are found for {MAX_LABELS} at most")
    return [r["label_id"] for r in d.labels.select("label_id").orderBy("label_id").collect()]


def _matrix(edges: DataFrame, ids: list[int]) -> np.ndarray:
    at = {i: k for k, i in enumerate(ids)}
    found = np.zeros((len(ids), len(ids)))
    for r in edges.collect():
        found[at[r["a"]], at[r["b"]]] = r["w"]
    return found


def _groups(d: MultiLabelFrame, ids: list[int], groups: list[int]) -> DataFrame:
    return d.spark.createDataFrame([*zip(ids, map(int, groups), strict=True)], "label_id int, group_id int")


# --- communities ---


def betweenness(neighbours: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Shortest paths that use each edge, over all pairs of nodes; paths of equal length share."""
    found = {(a, b): 0.0 for a in neighbours for b in neighbours[a] if a < b}
    for source in sorted(neighbours):
        depth, paths, order = {source: 0}, {source: 1.0}, [source]
        for a in order:
            for b in sorted(neighbours[a]):
                if b not in depth:
                    depth[b], paths[b] = depth[a] + 1, 0.0
                    order.append(b)
                if depth[b] == depth[a] + 1:
                    paths[b] += paths[a]
        flow = dict.fromkeys(order, 0.0)
        for b in reversed(order):
            for a in neighbours[b]:
                if depth.get(a) == depth[b] - 1:
                    part = paths[a] / paths[b] * (1 + flow[b])
                    flow[a] += part
                    found[min(a, b), max(a, b)] += part
    return {edge: v / 2 for edge, v in found.items()}


def components(neighbours: dict[int, set[int]]) -> list[set[int]]:
    left, found = set(neighbours), []
    while left:
        todo, got = [min(left)], set()
        while todo:
            a = todo.pop()
            if a not in got:
                got.add(a)
                todo += neighbours[a] - got
        found.append(got)
        left -= got
    return found


def girvan_newman(neighbours: dict[int, set[int]], k: int) -> list[set[int]]:
    """The finest partition of at most ``k`` communities that removing busiest edges leads to.

    Of equally busy edges the smallest is removed first. If already the first partition
    has more than k, the components are merged into k, smallest first.
    """
    neighbours = {a: set(b) for a, b in neighbours.items()}
    now = components(neighbours)
    best = now if len(now) <= k else None
    while len(now) < k and any(neighbours.values()):
        flows = betweenness(neighbours)
        a, b = min(flows, key=lambda e: (-round(flows[e], 9), e))
        neighbours[a].discard(b)
        neighbours[b].discard(a)
        now = components(neighbours)
        if len(now) <= k:
            best = now
    if best is None:
        best = sorted(now, key=lambda g: (len(g), min(g)))
        while len(best) > max(k, 1):
            best = sorted([best[0] | best[1], *best[2:]], key=lambda g: (len(g), min(g)))
    return sorted(best, key=min)


def communities(d: MultiLabelFrame, edges: DataFrame, k: int) -> DataFrame:
    """label_group(label_id, group_id) from the pattern of (a, b, w)."""
    ids = _label_ids(d)
    neighbours = {i: set() for i in ids}
    for r in upper_triangle(normalized_laplacian(edges, return_adj=True, norm_adj=True)).filter("w <> 0 AND a < b").collect():
        neighbours[r["a"]].add(r["b"])
        neighbours[r["b"]].add(r["a"])
    of = {i: g for g, members in enumerate(girvan_newman(neighbours, k)) for i in members}
    return _groups(d, ids, [of[i] for i in ids])


# --- clusters ---


def k_means(rows: np.ndarray, k: int, seed: int, iterations: int = 100) -> np.ndarray:
    """Clusters of a few rows: spread-out starts, then means until nothing moves."""
    rng, k = np.random.default_rng(seed), min(k, len(rows))
    centers = rows[[rng.integers(len(rows))]]
    while len(centers) < k:
        far = ((rows[:, None] - centers[None]) ** 2).sum(-1).min(1)
        chance = far / far.sum() if far.sum() > 0 else np.full(len(rows), 1 / len(rows))
        centers = np.vstack([centers, rows[rng.choice(len(rows), p=chance)]])
    found = np.full(len(rows), -1)
    for _ in range(iterations):
        near = ((rows[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        if (near == found).all():
            break
        found = near
        centers = np.stack([rows[found == c].mean(0) if (found == c).any() else centers[c] for c in range(k)])
    return found


def spectral_groups(d: MultiLabelFrame, sample: MultiLabelFrame, params: Params) -> DataFrame:
    """label_group from the eigenvectors of the k largest eigenvalues of the normalised Laplacian."""
    ids = _label_ids(d)
    laplacian = _matrix(normalized_laplacian(cooccurrence(sample), params.sigma), ids)
    _, vectors = np.linalg.eigh(laplacian)
    return _groups(d, ids, k_means(vectors[:, -min(params.num_clusters, len(ids)) :], params.num_clusters, params.seed))


def cross_covariance(d: MultiLabelFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlation of features and labels (F x L), mean features of each label's instances (L x F), and the features' deviations."""
    d = d.hold()
    names, ids = d.feature_names(), _label_ids(d)
    n = d.instances.count()
    whole = d.x.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names]).first()
    mean, std = (np.array([float(whole[f"{p}_{c}"] or 0) for c in names]) for p in "ms")
    std[std == 0] = 1
    sums = np.zeros((len(ids), len(names)))
    counts = np.zeros(len(ids))
    at = {i: k for k, i in enumerate(ids)}
    rows = d.held.filter("described AND has IS NOT NULL").select(F.explode("has").alias("label_id"), *[F.col(f"x_{c}").alias(c) for c in names]).groupBy("label_id").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in names])
    for r in rows.collect():
        sums[at[r["label_id"]]], counts[at[r["label_id"]]] = [r[c] for c in names], r["n"]
    share = counts / max(n, 1)
    label_std = np.sqrt(np.maximum(share * (1 - share) * n / max(n - 1, 1), 0))
    label_std[label_std == 0] = 1
    covariance = (sums - counts[:, None] * mean[None]).T / std[:, None] / label_std[None]
    return covariance, sums / np.maximum(counts, 1)[:, None], std


def projection(d: MultiLabelFrame, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """The features' weights on the first k common directions (F x k), stepped outward, and the labels' mean features (L x F)."""
    covariance, centers, _ = cross_covariance(d)
    left, _, _ = np.linalg.svd(covariance, full_matrices=False)
    left = left[:, : min(params.num_clusters, left.shape[1])]
    rate = 1 / (params.learning_rate * (optimal_step(params.learning_rate) + params.num_epochs - 1))
    left = left + rate * left
    return left + rate * 0.5 * np.sign(left), centers


def project(d: MultiLabelFrame, weights: np.ndarray) -> DataFrame:
    """(instance_id, z): raw features times the weights."""
    v = F.array(*[F.col(c).cast("double") for c in d.feature_names()])
    columns = [F.array(*map(F.lit, map(float, column))) for column in weights.T]
    z = [F.aggregate(F.zip_with(v, c, lambda s, t: s * t), F.lit(0.0), lambda s, e: s + e) for c in columns]
    return d.x.select("instance_id", F.array(*z).alias("z"))


def instance_clusters(d: MultiLabelFrame, params: Params) -> DataFrame:
    """(instance_id, cluster): instances clustered by their projection."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # Starts of k-means depend on how rows are partitioned, so they are the features' own and not those of a held frame.
    weights, _ = projection(d, params)
    z = project(d, weights).select("instance_id", array_to_vector("z").alias("features"))
    model = KMeans(k=params.num_clusters, initMode="k-means||", maxIter=params.num_epochs, seed=params.seed).fit(z)
    return model.transform(z).select("instance_id", F.col("prediction").alias("cluster"))


def plssvd_groups(d: MultiLabelFrame, params: Params) -> DataFrame:
    """label_group: labels clustered by the projection of their instances' mean."""
    d = d.hold()
    weights, centers = projection(d, params)
    return _groups(d, _label_ids(d), k_means(centers @ weights, params.num_clusters, params.seed))


# --- splitting by groups ---


def reassign(d: MultiLabelFrame, groups: DataFrame) -> MultiLabelFrame:
    """The same instances, labelled with the groups of their labels."""
    dim = groups.select(F.col("group_id").alias("label_id")).distinct().withColumn("label_name", F.col("label_id").cast("string"))
    if d.held is not None:
        # Labels of a row become groups in the row, so nothing is dealt anew.
        of = groups.agg(F.sort_array(F.collect_list(F.struct("label_id", "group_id"))).alias("g"))
        of = of.select(F.col("g.label_id").alias("_ids"), F.col("g.group_id").alias("_groups"), F.lit(0).alias("_k"))
        group = lambda label: F.try_element_at("_groups", F.nullif(F.array_position("_ids", label), F.lit(0)).cast("int"))
        has = F.array_sort(F.array_distinct(F.array_compact(F.transform("has", group))))
        rows = d.held.withColumn("_k", F.lit(0)).join(F.broadcast(of), "_k").withColumn("has", F.when(F.size(has) > 0, has))
        return replace(d, labels=dim)._reading(rows.select(*d.held.columns))
    y = d.y.join(F.broadcast(groups), "label_id").select("instance_id", F.col("group_id").alias("label_id")).distinct()
    return MultiLabelFrame(y, d.instances, dim, d.x)


class GroupSplitter:
    """Learns a grouping of labels on the first ``fit`` and reuses it on later ones.

    ``kind``: 'community', 'eigen', 'plssvd' or 'enhance'.
    """

    def __init__(self, kind: str, params: Params = Params()):
        if kind not in ("community", "eigen", "plssvd", "enhance"):
            raise InvalidData(f"no grouping {kind!r}")
        self.kind, self.params, self.groups = kind, params, None

    def learn(self, d: MultiLabelFrame) -> DataFrame:
        p = self.params
        if self.kind == "plssvd":
            return plssvd_groups(d, p)
        draws = bootstrap(d.spark, d.instances, "instance_id", p.num_subsamples, p.seed)
        draws = Scratch(d.spark, "groups").table(draws, "draws")
        if self.kind == "enhance":
            spread = propagate(d, p.alpha, p.num_epochs).filter("abs(value) > 1e-12")
            drawn = draws.join(spread, "instance_id").select(F.col("draw").alias("a"), F.col("label_id").alias("b"), F.col("value").alias("w"))
            drawn = Scratch(d.spark, "groups").table(drawn, "drawn")
            turned = drawn.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
            return communities(d, product(turned, drawn), p.num_communities)
        sample = d.take(draws)
        return communities(d, cooccurrence(sample), p.num_communities) if self.kind == "community" else spectral_groups(d, sample, p)

    def fit(self, d: MultiLabelFrame, split_type: str = "extreme") -> DataFrame:
        log.info("%s groups, then %s: %s", self.kind, split_type, self.params)
        d = d.hold()
        if self.groups is None:
            self.groups = self.learn(d)
        return splitter(split_type)(reassign(d, self.groups), self.params)
