"""Queries of ingest, label algebra, splitters, reports and evaluation, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.rand import bootstrap, sample, shuffled, u01, weighted_sample
from tessella.functions.scalar import clip_exponent, optimal_step, rescaled, softmax_over
from tessella.operators import active, evaluate, graph, grouping, report, split
from tessella.operators.base import cardinalities, label_counts, row_labelsets
from tessella.operators.params import Params
from tessella.sources.catalog import embedding_class, frames_sql, order_brand, order_type, table

PLAIN = Params(split_size=0.8, shuffle=False)
SHUFFLED = Params(split_size=0.8)
THREE = Params(split_size=0.8, num_epochs=3)
QUICK = Params(split_size=0.8, num_epochs=3, num_communities=3, num_clusters=3)
SEED = SHUFFLED.seed


def _u01(tag: str, key: str = "instance_id") -> str:
    return f"(CAST(('0x' || substr(md5('{SEED}|{tag}|' || {key}), 1, 8)) AS UBIGINT) / 4294967296.0)"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None, column: str = "p_type") -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE {frames_sql(column)}{sql}" if sql.lstrip().startswith(",") else f"WITH {frames_sql(column)} {sql}"


def _fixed_groups(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.col("id").cast("int").alias("label_id"), (F.col("id") % 3).cast("int").alias("group_id"))


# --- ingest ---

_add("labelled_filter", lambda s, d: order_type(s, d).labelled().instances, "SELECT DISTINCT instance_id FROM y")
QUERIES["binarize_single_label"] = lambda s, d: (lambda m: m.y.join(m.labels, "label_id").select("instance_id", "label_id", F.col("label_name").alias("class")))(embedding_class(s, d))
ORACLES["binarize_single_label"] = "SELECT vec_id AS instance_id, CAST(dense_rank() OVER (ORDER BY coalesce(label, 0)) - 1 AS INTEGER) AS label_id, coalesce(label, 0) AS class FROM embeddings"
_add("reassign_labels", lambda s, d: grouping.reassign(order_type(s, d), _fixed_groups(s)).y, "SELECT DISTINCT instance_id, label_id % 3 AS label_id FROM y")
_add("row_labelset", lambda s, d: row_labelsets(order_type(s, d)).select("instance_id", F.concat_ws(",", F.col("labelset").cast("array<string>")).alias("labelset")), "SELECT instance_id, labelset FROM sets")
_add(
    "bootstrap_rows",
    lambda s, d: bootstrap(s, order_type(s, d).instances, "instance_id", 10000, SEED),
    f""", p AS (SELECT instance_id, row_number() OVER (ORDER BY instance_id) - 1 AS position FROM inst),
    draws AS (SELECT range AS draw, CAST(floor({_u01('bootstrap', 'range')} * n) AS BIGINT) AS position FROM range(10000), n)
    SELECT draw, instance_id FROM draws JOIN p USING (position)""",
)
_add("shuffle_order", lambda s, d: shuffled(order_type(s, d).instances, "instance_id", SEED), f"SELECT instance_id, md5('{SEED}|shuffle|' || instance_id) AS shuffle_key FROM inst")
_add(
    "weighted_label_sample",
    lambda s, d: weighted_sample(label_counts(order_type(s, d)), "label_id", 1 / F.col("c"), 3, SEED),
    f""", w AS (SELECT label_id, c, round(-ln(({_u01('weighted', 'label_id')} * 4294967296.0 + 1) / 4294967297.0) / (1.0 / c), 9) AS clock FROM c WHERE c > 0)
    SELECT label_id, c, clock FROM w ORDER BY clock, label_id LIMIT 3""",
)

# --- label algebra ---

_EDGES = ", edges AS (SELECT p.label_id AS a, q.label_id AS b, count(*) AS w FROM y AS p JOIN y AS q USING (instance_id) GROUP BY 1, 2)"
_DEGREE = _EDGES + ", deg AS (SELECT a, CAST(sum(w) AS DOUBLE) AS d FROM edges WHERE a <> b GROUP BY 1 HAVING sum(w) > 0)"
_ADJ = _DEGREE + ", adj AS (SELECT e.a, e.b, e.w / sqrt(p.d * q.d) AS w FROM edges AS e JOIN deg AS p ON e.a = p.a JOIN deg AS q ON e.b = q.a WHERE e.a <> e.b)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("w", F.round("w", 9))


_add("cooccurrence", lambda s, d: graph.cooccurrence(order_type(s, d)), _EDGES + " SELECT a, b, w FROM edges")
_add("label_square", lambda s, d: graph.product(graph.cooccurrence(order_type(s, d)), graph.cooccurrence(order_type(s, d))), _EDGES + " SELECT p.a, q.b, CAST(sum(p.w * q.w) AS BIGINT) AS w FROM edges AS p JOIN edges AS q ON p.b = q.a GROUP BY 1, 2")
_add("normalized_adjacency", lambda s, d: _rounded(graph.normalized_laplacian(graph.cooccurrence(order_brand(s, d)), return_adj=True, norm_adj=True)), _ADJ + " SELECT a, b, round(w, 9) AS w FROM adj", "p_brand")
_add("normalized_laplacian", lambda s, d: _rounded(graph.normalized_laplacian(graph.cooccurrence(order_brand(s, d)))), _ADJ + " SELECT a, b, round(-w / 4, 9) AS w FROM adj UNION ALL SELECT a, a AS b, 0.25 AS w FROM deg", "p_brand")
_add("upper_adjacency", lambda s, d: _rounded(graph.upper_triangle(graph.normalized_laplacian(graph.cooccurrence(order_brand(s, d)), return_adj=True, norm_adj=True))), _ADJ + " SELECT a, b, round(w, 9) AS w FROM adj WHERE a <= b", "p_brand")


def _embedding_wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{k}" for k in range(64)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("instance_id"), *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)]), names


QUERIES["cosine_pairs"] = lambda s, d: graph.cosine_pairs(*_embedding_wide(s, d)).withColumn("w", F.round("w", 6))
ORACLES["cosine_pairs"] = """SELECT p.vec_id AS a, q.vec_id AS b, round(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
    / (sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS w
    FROM embeddings AS p JOIN embeddings AS q ON p.vec_id <= q.vec_id"""

_NAMES = ("price", "quantity", "discount", "lines", "urgent", "priority")


def _propagation_sql() -> str:
    u = ", ".join(f"{c} / r AS u{k}" for k, c in enumerate(_NAMES))
    v = ", ".join(f"CASE WHEN deg > 0 THEN u{k} / sqrt(deg) ELSE 0 END AS v{k}" for k in range(6))
    marks = ", ".join(f"CAST(coalesce(bool_or(label_id = {i}), false) AS INTEGER)::DOUBLE AS y{i}" for i in range(6))
    sql = f""", norms AS (SELECT *, sqrt({' + '.join(f'{c}*{c}' for c in _NAMES)}) AS r FROM x),
    units AS (SELECT instance_id, {u} FROM norms),
    sums AS (SELECT {', '.join(f'sum(u{k}) AS s{k}' for k in range(6))} FROM units),
    degs AS (SELECT units.*, {' + '.join(f'u{k}*s{k}' for k in range(6))} - ({' + '.join(f'u{k}*u{k}' for k in range(6))}) AS deg FROM units, sums),
    marks AS (SELECT instance_id, {marks} FROM inst LEFT JOIN y USING (instance_id) GROUP BY 1),
    e0 AS (SELECT instance_id, {v}, {', '.join(f'y{i}, y{i} AS d{i}' for i in range(6))} FROM degs JOIN marks USING (instance_id))"""
    for e in range(3):
        later = "OVER (ORDER BY instance_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        new = ", ".join("0.2 * (" + " + ".join(f"v{k} * coalesce(sum(v{k} * d{i}) {later}, 0)" for k in range(6)) + f") + 0.8 * y{i} AS d{i}" for i in range(6))
        sql += f", e{e + 1} AS (SELECT instance_id, {', '.join(f'v{k}' for k in range(6))}, {', '.join(f'y{i}' for i in range(6))}, {new} FROM e{e})"
    return sql + " " + " UNION ALL ".join(f"SELECT instance_id, {i} AS label_id, round(d{i}, 6) AS value FROM e3" for i in range(6))


_add("label_propagation_3", lambda s, d: graph.propagate(order_type(s, d), 0.2, 3).withColumn("value", F.round("value", 6)), _propagation_sql())
_add(
    "softmax_scores",
    lambda s, d: label_counts(order_type(s, d)).select("label_id", F.round(softmax_over(F.col("c") / 1000.0, Window.partitionBy()), 9).alias("value")),
    ", e AS (SELECT label_id, exp(c / 1000.0 - (SELECT max(c) FROM c) / 1000.0) AS e FROM c) SELECT label_id, round(e / (SELECT sum(e) FROM e), 9) AS value FROM e",
)

# --- splitters ---


def _naive_sql(order: str, y: str = "y") -> str:
    return f""", b AS (SELECT instance_id, label_id, CAST(floor((row_number() OVER (PARTITION BY label_id ORDER BY instance_id) - 1) / 100.0) AS BIGINT) AS batch,
        min(label_id) OVER (PARTITION BY instance_id) AS first_label FROM {y}),
    m AS (SELECT *, row_number() OVER (PARTITION BY label_id, batch ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY label_id, batch) AS m FROM b WHERE label_id = first_label),
    naive AS (SELECT instance_id, CASE WHEN rn <= round_even(m * 0.8, 0) THEN 'train' WHEN rn <= 2 * round_even(m * 0.8, 0) THEN 'test' END AS split FROM m),
    split AS (SELECT * FROM naive WHERE split IS NOT NULL)"""


_BY_KEY = f"md5('{SEED}|naive|' || instance_id), instance_id"
_add("split_naive", lambda s, d: split.naive(order_type(s, d), PLAIN), _naive_sql("instance_id") + " SELECT instance_id, split FROM split")
_add("split_naive_shuffled", lambda s, d: split.naive(order_type(s, d), SHUFFLED), _naive_sql(_BY_KEY) + " SELECT instance_id, split FROM split")
_add("desired_labels", lambda s, d: split.desired_labels(order_type(s, d), PLAIN), "SELECT 'train' AS side, label_id, CAST(round_even(c * 0.8, 0) AS BIGINT) AS desired FROM c UNION ALL SELECT 'test', label_id, CAST(round_even(c * (1 - 0.8::DOUBLE), 0) AS BIGINT) FROM c")
_add("desired_examples", lambda s, d: split.desired_examples(order_type(s, d), PLAIN), "SELECT 'train' AS side, CAST(round_even(n * 0.8, 0) AS BIGINT) AS desired FROM n UNION ALL SELECT 'test', CAST(round_even(n * (1 - 0.8::DOUBLE), 0) AS BIGINT) FROM n")


def _iterative_sql(order: str = "instance_id", labels: int = 6, y: str = "y", c: str = "c") -> str:
    sql = f""", ranks AS (SELECT label_id, row_number() OVER (ORDER BY c, label_id) - 1 AS turn FROM {c}),
    turns AS (SELECT instance_id, min(turn) AS turn FROM {y} JOIN ranks USING (label_id) GROUP BY 1),
    ks AS (SELECT instance_id, turn, row_number() OVER (PARTITION BY turn ORDER BY {order}) AS k FROM turns),
    w0 AS (SELECT label_id, turn, round_even(c * 0.8::DOUBLE, 0) - 0 AS tr, round_even(c * (1 - 0.8::DOUBLE), 0) AS te FROM {c} JOIN ranks USING (label_id))"""
    for t in range(labels):
        sql += f""", d{t} AS (SELECT tr - te AS d FROM w{t} WHERE turn = {t}),
        a{t} AS (SELECT instance_id, CASE WHEN k <= abs(d) THEN d >= 0 ELSE (k - CAST(abs(d) AS BIGINT)) % 2 = 1 END AS train FROM ks, d{t} WHERE turn = {t}),
        u{t} AS (SELECT label_id, count(*) FILTER (train) AS tr, count(*) FILTER (NOT train) AS te FROM a{t} JOIN {y} USING (instance_id) GROUP BY 1),
        w{t + 1} AS (SELECT w.label_id, w.turn, w.tr - coalesce(u.tr, 0) AS tr, w.te - coalesce(u.te, 0) AS te FROM w{t} AS w LEFT JOIN u{t} AS u USING (label_id))"""
    every = " UNION ALL ".join(f"SELECT * FROM a{t}" for t in range(labels))
    return f"{sql}, iterated AS (SELECT instance_id, CASE WHEN train THEN 'train' ELSE 'test' END AS split FROM ({every}))"


_add("split_iterative", lambda s, d: split.iterative(order_type(s, d), PLAIN), _iterative_sql() + " SELECT instance_id, split FROM iterated")


def _extreme_sql(epochs: int = 3) -> str:
    t, p = "(1 - 0.8::DOUBLE)", "0.8::DOUBLE"
    sql = f""", lab AS (SELECT DISTINCT instance_id FROM y), av AS (SELECT (SELECT count(*) FROM y) / CAST(count(*) AS DOUBLE) AS av FROM lab),
    s0 AS (SELECT instance_id, CASE WHEN {_u01('init')} > 0.8 THEN 1 ELSE 0 END AS is_test FROM lab)"""
    for e in range(epochs + 1):
        sql += f""", q{e} AS (SELECT label_id, count(*) AS n, sum(is_test) AS test FROM y JOIN s{e} USING (instance_id) GROUP BY 1),
        l{e} AS (SELECT label_id, n, test, CASE WHEN n <= 1 THEN 0 WHEN test / n >= {t} THEN (test / n - {t}) / {p} + CASE WHEN test / n > 0.999 THEN av ELSE 0 END
            ELSE (test / n - {t}) / {t} - CASE WHEN test / n < 0.001 THEN av ELSE 0 END END AS label_score FROM (SELECT label_id, CAST(n AS DOUBLE) AS n, CAST(test AS DOUBLE) AS test FROM q{e}), av),
        i{e} AS (SELECT instance_id, is_test, round(CASE WHEN is_test = 1 THEN 1 ELSE -1 END * sum(label_score), 9) AS score FROM s{e} JOIN y USING (instance_id) JOIN l{e} USING (label_id) GROUP BY 1, 2),
        t{e} AS (SELECT greatest(round(coalesce(quantile_cont(score, {1 - 0.1 / 1.1**e!r}), 0), 9), 0) AS cut FROM i{e}, av WHERE score < av)"""
        if e < epochs:
            u = _u01(f"swap{e}")
            sql += f""", s{e + 1} AS (SELECT instance_id, CASE WHEN {u} <= CASE WHEN score >= av THEN {0.25 / 1.05**e!r} WHEN score > cut THEN {0.1 / 1.1**e!r} ELSE -1 END
                THEN 1 - is_test ELSE is_test END AS is_test FROM i{e}, av, t{e})"""
    return sql


def _extreme_start(s: SparkSession, d: str):
    m = order_type(s, d).labelled()
    sides = split.initial_sides(m, THREE)
    average = float(m.y.count()) / m.instances.count()
    return m, sides, split.label_scores(m.y, sides, THREE, average), average


def _extreme_scored(s: SparkSession, d: str):
    m, sides, labels, average = _extreme_start(s, d)
    return split.instance_scores(m.y, sides, labels), average


_add("split_extreme_3", lambda s, d: split.extreme(order_type(s, d), THREE), _extreme_sql() + " SELECT instance_id, CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END AS split FROM s3")
_add(
    "extreme_label_scores",
    lambda s, d: _extreme_start(s, d)[2].withColumn("label_score", F.round("label_score", 9)),
    _extreme_sql(0) + " SELECT label_id, CAST(n - test AS BIGINT) AS train, CAST(test AS BIGINT) AS test, round(label_score, 9) AS label_score FROM l0",
)
_add("extreme_instance_scores", lambda s, d: _extreme_scored(s, d)[0], _extreme_sql(0) + " SELECT instance_id, is_test, score FROM i0")
_add("extreme_total_score", lambda s, d: _extreme_scored(s, d)[0].agg(F.round(F.sum("score"), 4).alias("total")), _extreme_sql(0) + " SELECT round(sum(score), 4) AS total FROM i0")
_add("extreme_threshold", lambda s, d: s.range(1).select(F.lit(split.threshold(*(lambda x: (x[0], THREE, x[1], 0))(_extreme_scored(s, d)))).alias("cut")), _extreme_sql(0) + " SELECT CAST(cut AS DOUBLE) AS cut FROM t0")
_add("split_remap_fixed", lambda s, d: split.naive(grouping.reassign(order_type(s, d), _fixed_groups(s)), PLAIN), ", g AS (SELECT DISTINCT instance_id, label_id % 3 AS label_id FROM y)" + _naive_sql("instance_id", "g") + " SELECT instance_id, split FROM split")
_add("split_eigen", lambda s, d: grouping.GroupSplitter("eigen", QUICK).fit(order_brand(s, d)))
_add("split_community", lambda s, d: grouping.GroupSplitter("community", QUICK).fit(order_brand(s, d)))
_add("split_plssvd", lambda s, d: grouping.GroupSplitter("plssvd", QUICK).fit(order_brand(s, d)))
_add("split_enhance", lambda s, d: grouping.GroupSplitter("enhance", QUICK).fit(order_type(s, d)))
_add("split_active", lambda s, d: active.active(order_type(s, d), THREE))
_add("plssvd_instance_clusters", lambda s, d: grouping.instance_clusters(order_type(s, d), QUICK))

# --- parts of the active splitter, on fixed weights ---

_FIXED = {i: np.array([0.1 * (i + 1), -0.2, 0.3, 0.05 * i, 0.1, -0.1, 0.02]) for i in range(6)}


def _active_rows(s: SparkSession, d: str) -> DataFrame:
    return active.vectors(order_type(s, d).hold().labelled())


def _active_sql() -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z{k}" for k, c in enumerate(_NAMES, 1))
    probs = " UNION ALL ".join(f"SELECT instance_id, {i} AS label_id, 1 / (1 + exp(-({w[0]!r} + {' + '.join(f'({float(w[k])!r}) * z{k}' for k in range(1, 7))}))) AS p, {', '.join(f'z{k}' for k in range(1, 7))} FROM zs" for i, w in ((i, list(map(float, w))) for i, w in _FIXED.items()))
    return f""", lx AS (SELECT x.* FROM x WHERE instance_id IN (SELECT instance_id FROM y)), zs AS (SELECT instance_id, {z} FROM lx),
    ps AS (SELECT q.*, CASE WHEN y.label_id IS NULL THEN 0 ELSE 1 END AS yes FROM ({probs}) AS q LEFT JOIN y USING (instance_id, label_id)),
    h AS (SELECT instance_id, round(-avg(p) * ln(avg(p) + 2.220446049250313e-16) + 2.220446049250313e-16, 9) AS uncertainty FROM ps GROUP BY 1)"""


def _top3_sql() -> str:
    return """, best AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY p DESC, label_id) AS rn FROM ps),
    pr AS (SELECT instance_id, avg(yes / (1 / (1 + 1 / (c + 1.0::DOUBLE)))) AS s FROM best JOIN c USING (label_id) WHERE rn <= 3 GROUP BY 1)
    SELECT instance_id, round(1 - (s - (SELECT min(s) FROM pr)) / (SELECT max(s) - min(s) FROM pr) + 2.220446049250313e-16, 9) AS uncertainty FROM pr"""


_add("active_entropy", lambda s, d: active.entropy(_active_rows(s, d), _FIXED), _active_sql() + " SELECT instance_id, uncertainty FROM h")
_add("active_psp", lambda s, d: active.psp(_active_rows(s, d), _FIXED, label_counts(order_type(s, d)), 3), _active_sql() + _top3_sql())


def _ads(s: SparkSession, d: str) -> DataFrame:
    m = order_type(s, d).hold().labelled()
    scores = active.entropy(active.vectors(m), _FIXED)
    return active.ads(scores, m.instances.count(), 0.7).select("instance_id")


_add("active_ads_topk", _ads, _active_sql() + ", r AS (SELECT instance_id, row_number() OVER (ORDER BY uncertainty DESC, instance_id) AS rn FROM h) SELECT instance_id FROM r WHERE rn <= CAST(floor(0.7::DOUBLE * (SELECT count(*) FROM h)) AS BIGINT)")


def _gradient(s: SparkSession, d: str) -> DataFrame:
    found = active.gradient(_active_rows(s, d), _FIXED)
    return s.createDataFrame([(i, k, round(float(v), 7)) for i, g in found.items() for k, v in enumerate(g)], "label_id int, place int, value double")


_add("active_logistic_step", _gradient, _active_sql() + " " + " UNION ALL ".join(f"SELECT label_id, {k} AS place, round(avg((p - yes) * {f'z{k}' if k else 1}), 7) AS value FROM ps GROUP BY 1" for k in range(7)))
_add(
    "active_cost",
    lambda s, d: active.cost(_active_rows(s, d), _FIXED).withColumn("cost", F.round("cost", 7)),
    _active_sql() + " SELECT label_id, round(avg(-ln(CASE WHEN yes = 1 THEN p ELSE 1 - p END)), 7) AS cost FROM ps GROUP BY 1",
)

# --- reports ---


def _naive_split(s, d):
    m = order_type(s, d).hold()
    return m, split.naive(m, PLAIN)


_SIDES = _naive_sql("instance_id") + """, sided AS (SELECT instance_id, 'complete' AS dataset FROM inst UNION ALL SELECT instance_id, split FROM split),
    ds AS (SELECT unnest(['complete', 'train', 'test']) AS dataset),
    yc AS (SELECT label_id, dataset, count(*) AS n FROM y JOIN sided USING (instance_id) GROUP BY 1, 2),
    freq AS (SELECT g.label_id, ds.dataset, coalesce(n, 0) AS n FROM (SELECT DISTINCT label_id FROM y) AS g, ds LEFT JOIN yc ON yc.label_id = g.label_id AND yc.dataset = ds.dataset),
    share AS (SELECT label_id, dataset, n / sum(n) OVER (PARTITION BY dataset) AS p FROM (SELECT label_id, dataset, CAST(n AS DOUBLE) AS n FROM freq)),
    kl AS (SELECT s.dataset, round(coalesce(sum(s.p * ln(s.p / q.p)) FILTER (s.p > 0), 0), 6) AS kl FROM share AS s JOIN share AS q USING (label_id) WHERE q.dataset = 'complete' GROUP BY 1)"""
_add("report_label_frequency", lambda s, d: report.chart_rows(*_naive_split(s, d)), _SIDES + ", pl AS (SELECT label_id, CAST(row_number() OVER (ORDER BY n, label_id) - 1 AS INTEGER) AS place FROM freq WHERE dataset = 'complete') SELECT place, label_id, dataset, n FROM freq JOIN pl USING (label_id)")
_add("report_tails", lambda s, d: report.tails(*_naive_split(s, d), num_tails=2000), _SIDES + " SELECT dataset, count(*) FILTER (n <= 2000) AS tail, count(*) FILTER (n > 2000) AS beyond FROM freq WHERE n > 0 GROUP BY 1")
_add("report_kl", lambda s, d: report.divergence(*_naive_split(s, d)), _SIDES + " SELECT dataset, kl FROM kl")


def _report_sql() -> str:
    values = ["n", "ones", "ones / n", "ones / (n * 6)", "distinct_l", "sets", "sets / n", "intra", "inter", "ir_sets", "tail", "beyond", "kl"]
    wide = """, gs AS (SELECT dataset, labelset, count(*) AS cnt, min(instance_id) AS seen FROM sets JOIN sided USING (instance_id) GROUP BY 1, 2),
    sz AS (SELECT dataset, CAST(sum(cnt) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS sets FROM gs GROUP BY 1),
    cs AS (SELECT l.label_id, ds.dataset, CAST(coalesce(yc.n, 0) AS DOUBLE) AS c FROM labels AS l, ds LEFT JOIN yc ON yc.label_id = l.label_id AND yc.dataset = ds.dataset),
    tops AS (SELECT dataset, max(c) AS top, sum(c) AS ones FROM cs GROUP BY 1),
    ol AS (SELECT dataset, count(*) FILTER (c > 0) AS distinct_l, avg(CASE WHEN least(c, n) < 1 THEN 0 ELSE greatest(c, n) / least(c, n) END) AS intra,
        avg(CASE WHEN c < 1 THEN 0 ELSE top / c END) AS inter, count(*) FILTER (c > 0 AND c <= 2) AS tail, count(*) FILTER (c > 2) AS beyond FROM cs JOIN tops USING (dataset) JOIN sz USING (dataset) GROUP BY 1),
    ws AS (SELECT g.dataset, labelset, seen, coalesce(sum(c), 0) AS w FROM gs AS g LEFT JOIN cs ON cs.dataset = g.dataset AND list_contains(string_split(labelset, ','), CAST(cs.label_id AS VARCHAR)) GROUP BY 1, 2, 3),
    hv AS (SELECT dataset, arg_max(seen, (w, -seen)) AS h FROM (SELECT dataset, w, seen FROM ws) GROUP BY 1),
    pc AS (SELECT dataset, count(*) FILTER (seen < h) AS place FROM ws JOIN hv USING (dataset) GROUP BY 1),
    os AS (SELECT dataset, avg(CASE WHEN w <= 0 THEN 0 ELSE place / (w / 6.0) END) AS ir_sets FROM ws JOIN pc USING (dataset) GROUP BY 1),
    wide AS (SELECT * FROM sz JOIN tops USING (dataset) JOIN ol USING (dataset) JOIN os USING (dataset) JOIN kl USING (dataset)),
    long AS ("""
    long = " UNION ALL ".join(f"SELECT {k} AS position, '{name}' AS property, dataset, CAST({v} AS DOUBLE) AS v FROM wide" for k, (name, v) in enumerate(zip(report.PROPERTIES, values, strict=True)))
    sides = ", ".join(f"round(max(v) FILTER (dataset = '{s}'), 5) AS {s}" for s in ("complete", "train", "test"))
    return f"{_SIDES}{wide}{long}) SELECT position, property, {sides} FROM long GROUP BY 1, 2"


_add("report_properties", lambda s, d: report.properties(*_naive_split(s, d)), _report_sql())

# --- evaluation ---


def _guess(s: SparkSession, d: str):
    """A prediction to score: each true pair with chance 0.8, and each instance with label 0 with chance 0.3."""
    m = order_type(s, d)
    hit = m.y.filter(u01(SEED, "hit", F.concat_ws("-", "instance_id", "label_id")) < 0.8)
    more = m.instances.filter(u01(SEED, "more", F.col("instance_id")) < 0.3).withColumn("label_id", F.lit(0))
    return m, hit.unionByName(more).distinct()


_GUESS = f""", guess AS (SELECT instance_id, label_id FROM y WHERE {_u01('hit', "instance_id || '-' || label_id")} < 0.8 UNION SELECT instance_id, 0 FROM inst WHERE {_u01('more')} < 0.3),
    oc AS (SELECT instance_id, label_id, CASE WHEN t.i IS NULL THEN 0 ELSE 1 END AS t, CASE WHEN p.i IS NULL THEN 0 ELSE 1 END AS p
        FROM (SELECT *, 1 AS i FROM y) AS t FULL JOIN (SELECT *, 1 AS i FROM guess) AS p USING (instance_id, label_id))"""
_F1 = "CASE WHEN sum(t) + sum(p) > 0 THEN 2.0 * sum(t * p) / (sum(t) + sum(p)) ELSE 0 END"
_add("f1_micro", lambda s, d: (lambda g: evaluate.f1_micro(g[0].y, g[1]))(_guess(s, d)), _GUESS + f" SELECT round({_F1}, 6) AS value FROM oc")
_add("f1_macro", lambda s, d: (lambda g: evaluate.f1_macro(g[0].labels, g[0].y, g[1]))(_guess(s, d)), _GUESS + f", f AS (SELECT label_id, {_F1} AS f FROM oc GROUP BY 1) SELECT round(avg(coalesce(f, 0)), 6) AS value FROM labels LEFT JOIN f USING (label_id)")
_add("f1_samples", lambda s, d: (lambda g: evaluate.f1_samples(g[0].instances, g[0].y, g[1]))(_guess(s, d)), _GUESS + f", f AS (SELECT instance_id, {_F1} AS f FROM oc GROUP BY 1) SELECT round(avg(coalesce(f, 0)), 6) AS value FROM inst LEFT JOIN f USING (instance_id)")
_add("chain_classifier", lambda s, d: (lambda m: evaluate.chain_classifier(m, split.naive(m, PLAIN)))(order_type(s, d).hold()))

# --- single steps ---

_WEIGHTS = np.array([[0.001, -0.002], [0.01, 0.02], [1.0, -1.0], [0.1, 0.2], [0.5, -0.5], [0.05, 0.1]])


def _projected_sql() -> str:
    z = [" + ".join(f"{c} * ({float(w)!r})" for c, w in zip(_NAMES, column, strict=True)) for column in _WEIGHTS.T]
    return f"SELECT instance_id, round({z[0]}, 6) AS z0, round({z[1]}, 6) AS z1 FROM x"


_add("label_sums", lambda s, d: label_counts(order_type(s, d)), "SELECT label_id, c FROM c")
_add("row_sums", lambda s, d: cardinalities(order_type(s, d)), "SELECT instance_id, k FROM k")
_add("project_features", lambda s, d: grouping.project(order_type(s, d), _WEIGHTS).select("instance_id", *[F.round(F.get("z", F.lit(k)), 6).alias(f"z{k}") for k in (0, 1)]), _projected_sql())
_add("uniform_label_sample", lambda s, d: sample(order_type(s, d).labels, "label_id", 4, SEED).select("label_id"), f"SELECT label_id FROM labels ORDER BY md5('{SEED}|sample|' || label_id), label_id LIMIT 4")
_add(
    "take_bootstrap",
    lambda s, d: (lambda m: m.take(bootstrap(s, m.instances, "instance_id", 5000, SEED)).y)(order_type(s, d)),
    f""", p AS (SELECT instance_id, row_number() OVER (ORDER BY instance_id) - 1 AS position FROM inst),
    draws AS (SELECT range AS draw, CAST(floor({_u01('bootstrap', 'range')} * n) AS BIGINT) AS position FROM range(5000), n)
    SELECT draw AS instance_id, label_id FROM draws JOIN p USING (position) JOIN y USING (instance_id)""",
)
_add("take_features", lambda s, d: (lambda m: m.labelled().x.select("instance_id", "price", "lines"))(order_type(s, d)), "SELECT instance_id, price, lines FROM x WHERE instance_id IN (SELECT instance_id FROM y)")
_add("split_iterative_shuffled", lambda s, d: split.iterative(order_type(s, d), SHUFFLED), _iterative_sql(f"md5('{SEED}|iterative|' || instance_id), instance_id") + " SELECT instance_id, split FROM iterated")
_add(
    "split_extreme_best",
    lambda s, d: split.extreme(order_brand(s, d), THREE, keep_best=True),
    _extreme_sql() + ", off AS (" + " UNION ALL ".join(f"SELECT {e} AS e, round(sum(abs(label_score)), 9) AS off FROM l{e}" for e in (1, 2, 3)) + "), best AS (SELECT arg_min(e, (off, e)) AS e FROM off) "
    + " UNION ALL ".join(f"SELECT instance_id, CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END AS split FROM s{e}, best WHERE e = {e}" for e in (1, 2, 3)),
    "p_brand",
)
_add(
    "split_remap_iterative",
    lambda s, d: split.iterative(grouping.reassign(order_type(s, d), _fixed_groups(s)), PLAIN),
    ", g AS (SELECT DISTINCT instance_id, label_id % 3 AS label_id FROM y), cg AS (SELECT label_id, count(*) AS c FROM g GROUP BY 1)" + _iterative_sql(labels=3, y="g", c="cg") + " SELECT instance_id, split FROM iterated",
)
_add("adjacency", lambda s, d: graph.normalized_laplacian(graph.cooccurrence(order_brand(s, d)), return_adj=True), _EDGES + " SELECT a, b, CAST(w AS DOUBLE) AS w FROM edges WHERE a <> b", "p_brand")
_add("active_mean_cost", lambda s, d: active.mean_cost(active.cost(_active_rows(s, d), _FIXED)).withColumn("cost", F.round("cost", 7)), _active_sql() + ", cs AS (SELECT label_id, avg(-ln(CASE WHEN yes = 1 THEN p ELSE 1 - p END)) AS cost FROM ps GROUP BY 1) SELECT round(avg(cost) + 2.220446049250313e-16, 7) AS cost FROM cs")
_add(
    "exponent_bounds",
    lambda s, d: (lambda x, e: x.select("instance_id", F.round(clip_exponent(F.col("price") - 50000), 6).alias("clipped"), F.round(rescaled(F.col("price"), F.lit(e["lo"]), F.lit(e["hi"])), 9).alias("scaled")))(order_type(s, d).x, order_type(s, d).x.agg(F.min("price").alias("lo"), F.max("price").alias("hi")).first()),
    "SELECT instance_id, round(greatest(-7083.964185322641::DOUBLE, least(7097.827128933839::DOUBLE, price - 50000)), 6) AS clipped, round(2 * (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) - 1, 9) AS scaled FROM x",
)
_add("community_groups", lambda s, d: (lambda m: grouping.communities(m, graph.cooccurrence(m), 3))(order_brand(s, d)))
_add("eigen_groups", lambda s, d: (lambda m: grouping.spectral_groups(m, m, QUICK))(order_brand(s, d)))
_add("plssvd_groups", lambda s, d: grouping.plssvd_groups(order_brand(s, d), QUICK))
_add(
    "label_covariance",
    lambda s, d: (lambda m: s.createDataFrame([(f, label, round(float(v), 6)) for f, row in zip(m.feature_names(), grouping.cross_covariance(m)[0], strict=True) for label, v in enumerate(row)], "feature string, label_id int, value double"))(order_type(s, d)),
    ", marks AS (SELECT i.instance_id, l.label_id, CASE WHEN y.label_id IS NULL THEN 0.0 ELSE 1.0 END AS v FROM inst AS i CROSS JOIN labels AS l LEFT JOIN y ON y.instance_id = i.instance_id AND y.label_id = l.label_id) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, label_id, round(corr({c}, v) * (count(*) - 1), 6) AS value FROM marks JOIN x USING (instance_id) GROUP BY 2" for c in _NAMES),
)
_add(
    "optimal_rates",
    lambda s, d: s.createDataFrame([(a, round(optimal_step(a), 6), round(1 / (a * optimal_step(a)), 9)) for a in (1e-4, 1e-3)], "alpha double, step double, first_rate double"),
    ", t AS (SELECT a, sqrt(1 / sqrt(a)) AS w FROM (VALUES (1e-4::DOUBLE), (1e-3::DOUBLE)) AS v(a)), r AS (SELECT a, 1 / ((w / greatest(1, ln(1 + exp(w)))) * a) AS step FROM t) SELECT a AS alpha, round(step, 6) AS step, round(1 / (a * step), 9) AS first_rate FROM r",
)
