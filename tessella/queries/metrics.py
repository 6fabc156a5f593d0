"""Metric queries on order_type, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.metrics import METRICS
from tessella.sources.catalog import frames_sql, order_type


def _query(metric) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: metric(order_type(spark, sf_dir))


def _name(metric: str) -> str:
    return f"mc_{metric.removeprefix('corrected_')}" if metric.startswith("corrected_") else f"m_{metric}"


QUERIES = {_name(name): _query(metric) for name, metric in METRICS.items()}

_H2 = "(CASE WHEN {c} > 0 THEN -({c}/{n}) * ln(greatest({c}/{n}, 1e-15)) ELSE 0 END + CASE WHEN {c} < {n} THEN -(({n}-{c})/{n}) * ln(greatest(({n}-{c})/{n}, 1e-15)) ELSE 0 END)"
_HC = _H2.format(c="c", n="n")
_INTER = "ir AS (SELECT label_id, CASE WHEN c < 1 THEN 0 ELSE (SELECT max(c) FROM c) / CAST(c AS DOUBLE) END AS ir FROM c)"
_INTRA = "ir AS (SELECT label_id, CASE WHEN least(n, c) < 1 THEN 0 ELSE greatest(n, c) / least(n, c) END AS ir FROM c, n)"
_ARGMAX = "SELECT label_id AS max_label_id FROM ir ORDER BY round(ir, 9) DESC, label_id LIMIT 1"
_TOP = "top AS (SELECT first_seen AS seen FROM ls ORDER BY w DESC, first_seen LIMIT 1), place AS (SELECT CAST(count(*) AS BIGINT) AS place FROM ls, top WHERE first_seen < seen)"
_IRLS = _TOP + ", ir AS (SELECT labelset, CASE WHEN w <= 0 THEN 0 ELSE place / (w / (SELECT count(*) FROM labels)) END AS ir FROM ls, place)"
_MOM = "m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(pow(k - a, 2)) AS m2, avg(pow(k - a, 4)) AS m4, sum(pow(k - a, 3)) AS t, avg(pow(k - a, 3)) AS m3 FROM k, (SELECT avg(k) AS a FROM k))"
_PAIRS = """pairs AS (SELECT a.label_id AS a, b.label_id AS b, a.c AS c_a, b.c AS c_b,
    (SELECT count(*) FROM y AS p JOIN y AS q USING (instance_id) WHERE p.label_id = a.label_id AND q.label_id = b.label_id) AS n11 FROM c AS a JOIN c AS b ON a.label_id < b.label_id),
    four AS (SELECT a, b, CAST(n11 AS DOUBLE) AS n11, CAST(c_a - n11 AS DOUBLE) AS n10, CAST(c_b - n11 AS DOUBLE) AS n01, n - c_a - c_b + n11 AS n00 FROM pairs, n)"""


def _chi() -> str:
    cells = [("n11", 1.0, 1.0), ("n10", 1.0, 0.01), ("n01", 0.01, 1.0), ("n00", 0.01, 0.01)]
    rows = [" + ".join(f"{c}*{v[k]}" for c, *v in cells) for k in (0, 1)]
    terms = [f"{c} * pow({v[k]} - r{k}*{v[0] + v[1]}/(r0+r1), 2) / (r{k}*{v[0] + v[1]}/(r0+r1))" for c, *v in cells for k in (0, 1)]
    return f"{_PAIRS}, chis AS (SELECT a, b, {' + '.join(terms)} AS chi FROM (SELECT *, {rows[0]} AS r0, {rows[1]} AS r1 FROM four))"


_CHI = _chi()
_FEATURES = ("price", "quantity", "discount", "lines", "urgent", "priority")
_NUMERIC = _FEATURES[:3]
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT instance_id, '{f}' AS feature, CAST(trunc({f}) AS BIGINT) AS v FROM x" for f in _FEATURES) + ")"
_HX = _CELLS + ", hx AS (SELECT feature, sum(-(m/n) * ln(greatest(m/n, 1e-15))) AS h FROM (SELECT feature, v, count(*) AS m FROM cells GROUP BY 1, 2), n GROUP BY 1)"
_GAIN = (
    _HX
    + ", within AS (SELECT feature, CAST(count(*) AS DOUBLE) AS m FROM cells WHERE v <> 0 GROUP BY 1)"
    + ", ones AS (SELECT feature, label_id, count(*) AS ones FROM cells JOIN y USING (instance_id) WHERE v <> 0 GROUP BY 1, 2)"
    + ", gains AS (SELECT label_id, feature, CASE WHEN abs(h) > 1e-9 THEN ("
    + _HC
    + " - CASE WHEN m IS NULL THEN 0 ELSE "
    + _H2.format(c="coalesce(ones, 0)", n="m")
    + " END) / h END AS gain FROM c JOIN hx ON true LEFT JOIN within USING (feature) LEFT JOIN ones USING (feature, label_id), n)"
)
_L = "(SELECT count(*) FROM labels)"
_SKEW = "(avg(pow({c}, 3)) - 3*avg({c})*avg(pow({c}, 2)) + 2*pow(avg({c}), 3)) / pow(var_pop({c}), 1.5)"


def _corr(f: str) -> str:
    pairs = [f"{f}(corr({a}, {b}))" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]]
    return f"SELECT round(({' + '.join(pairs)}) / {len(pairs)}, 6) AS value FROM x"


#: Name: further tables, select.
_SQL: dict[str, tuple[str, str]] = {
    "m_instances": ("", "SELECT count(*) AS value FROM inst"),
    "m_attributes": ("", "SELECT CAST(6 AS BIGINT) AS value"),
    "m_labels": ("", "SELECT count(*) AS value FROM labels"),
    "m_distinct_labels": ("", "SELECT count(DISTINCT label_id) AS value FROM y"),
    "m_total_labels": ("", "SELECT count(*) AS value FROM y"),
    "m_distinct_labelsets": ("", "SELECT count(*) AS value FROM ls"),
    "m_list_labelsets": ("", "SELECT labelset, cnt, first_seen FROM ls"),
    "m_lxixf": ("", f"SELECT CAST({_L} * n * 6 AS BIGINT) AS value FROM n"),
    "m_ratio_instances_features": ("", "SELECT round(n / 6, 6) AS value FROM n"),
    "m_cardinality": ("", "SELECT round(sum(k) / CAST(count(*) AS DOUBLE), 6) AS value FROM k"),
    "m_density": ("", f"SELECT round(sum(k) / CAST(count(*) * {_L} AS DOUBLE), 6) AS value FROM k"),
    "m_frequency": ("", "SELECT label_id, round(c / n, 6) AS value FROM c, n"),
    "m_std_label_cardinality": ("", "SELECT round(stddev_pop(k), 6) AS value FROM k"),
    "m_entropy_labels": ("", f"SELECT label_id, round({_HC}, 6) AS value FROM c, n"),
    "m_min_max_mean_entropy_labels": (
        f"e AS (SELECT label_id, round({_HC}, 12) AS e FROM c, n)",
        "SELECT (SELECT label_id FROM e ORDER BY e, label_id LIMIT 1) AS min_label_id, (SELECT label_id FROM e ORDER BY e DESC, label_id DESC LIMIT 1) AS max_label_id, (SELECT round(avg(e), 6) FROM e) AS mean_entropy",
    ),
    "m_imbalance_ratio_inter_class": (_INTER, "SELECT label_id, round(ir, 6) AS value FROM ir"),
    "m_mean_ir_inter_class": (_INTER, "SELECT round(avg(ir), 6) AS value FROM ir"),
    "m_max_ir_inter_class": (_INTER, _ARGMAX),
    "m_cvir_inter_class": (_INTER, "SELECT round(stddev_samp(ir) / avg(ir), 6) AS value FROM ir"),
    "m_imbalance_ratio_intra_class": (_INTRA, "SELECT label_id, round(ir, 6) AS value FROM ir"),
    "m_mean_ir_intra_class": (_INTRA, "SELECT round(avg(ir), 6) AS value FROM ir"),
    "m_max_ir_intra_class": (_INTRA, _ARGMAX),
    "m_std_ir_intra_class": ("", "SELECT label_id, round(abs(c - n / 2), 6) AS value FROM c, n"),
    "m_mean_std_ir_intra_class": ("", "SELECT round(avg(abs(c - n / 2)), 6) AS value FROM c, n"),
    "m_imbalance_ratio_labelset": (_IRLS, "SELECT labelset, round(ir, 6) AS value FROM ir"),
    "m_mean_ir_labelset": (_IRLS, "SELECT round(avg(ir), 6) AS value FROM ir"),
    "m_max_ir_labelset": (_TOP, "SELECT place AS value FROM place"),
    "m_kurtosis_cardinality": (_MOM, "SELECT round((n-1)/((n-2)*(n-3)) * ((n+1)*(m4/pow(m2,2)-3)+6), 6) AS value FROM m"),
    "m_skewness_cardinality": (_MOM, "SELECT CASE WHEN t > 0 THEN round(n/((n-1)*(n-2)) * t / pow(t/(n-1), 1.5), 6) END AS value FROM m"),
    "m_pmax": (_TOP, "SELECT place AS value FROM place"),
    "m_bound": ("", f"SELECT CAST(pow(2.0, {_L}) AS DOUBLE) AS value"),
    "m_diversity": ("", f"SELECT round((SELECT count(*) FROM ls) / pow(2.0, {_L}), 12) AS value"),
    "m_scumble": ("", f"SELECT round(avg(CASE WHEN k < {_L} THEN 1.0 ELSE 0.0 END), 6) AS value FROM k"),
    "m_proportion_distinct_labelsets": ("", "SELECT round(count(*) / CAST(sum(cnt) AS DOUBLE), 6) AS value FROM ls"),
    "m_number_labelsets_to_n_instances": ("", "SELECT count(*) FILTER (w <= 20000) AS value FROM ls"),
    "m_ratio_labelsets_to_n_instances": ("", "SELECT round(count(*) FILTER (w <= 20000) / CAST(count(*) AS DOUBLE), 6) AS value FROM ls"),
    "m_average_instances_per_labelset": ("", "SELECT round(sum(cnt) / CAST(count(*) AS DOUBLE), 6) AS value FROM ls"),
    "m_std_instances_per_labelset": ("a AS (SELECT sum(cnt) / CAST(count(*) AS DOUBLE) AS a FROM ls)", "SELECT round(sqrt(avg(pow(w - a, 2))), 6) AS value FROM ls, a"),
    "m_number_unique_labelsets": ("", "SELECT count(*) FILTER (w = 1) AS value FROM ls"),
    "m_ratio_labelsets_half_attributes": ("", "SELECT round(count(*) FILTER (w <= 3) / CAST(count(*) AS DOUBLE), 6) AS value FROM ls"),
    "m_number_unconditionally_dependent_label_pairs": (_CHI, "SELECT count(*) FILTER (chi > 6.635) AS value FROM chis"),
    "m_ratio_unconditionally_dependent_label_pairs": (_CHI, "SELECT round(count(*) FILTER (chi > 6.635) / CAST(count(*) AS DOUBLE), 6) AS value FROM chis"),
    "m_average_unconditionally_dependent_label_pairs": (_CHI, "SELECT round(coalesce(sum(chi) FILTER (chi > 6.635), 0), 3) AS value FROM chis"),
    "m_number_binary_attributes": ("", "SELECT CAST(" + " + ".join(f"CAST(bool_and({f} IN (0, 1)) AS BIGINT)" for f in _FEATURES) + " AS BIGINT) AS value FROM x"),
    "m_number_nominal_attributes": ("", "SELECT CAST(3 AS BIGINT) AS value"),
    "m_number_numeric_attributes": ("", "SELECT CAST(3 AS BIGINT) AS value"),
    "m_proportion_binary_attributes": ("", "SELECT round((" + " + ".join(f"CAST(bool_and({f} IN (0, 1)) AS BIGINT)" for f in _FEATURES) + ") / 6.0, 6) AS value FROM x"),
    "m_proportion_nominal_attributes": ("", "SELECT CAST(round((" + " + ".join(f"CAST(sum(CAST(trunc({f}) AS BIGINT)) <> 0 AS BIGINT)" for f in _FEATURES) + ") / 6.0, 6) AS DOUBLE) AS value FROM x"),
    "m_proportion_numeric_attributes": ("", "SELECT CAST(0.5 AS DOUBLE) AS value"),
    "m_entropy_attribute": (_HX, "SELECT feature, round(h, 6) AS value FROM hx"),
    "m_mean_entropies_nominal_attributes": (_HX, "SELECT feature, round(h / n, 9) AS value FROM hx, n"),
    "m_mean_mean_numeric_attributes": ("", "SELECT round((avg(price) + avg(quantity) + avg(discount)) / count(*), 4) AS value FROM x"),
    "m_mean_std_numeric_attributes": ("", "SELECT round(3 * stddev_samp(price) / count(*), 4) AS value FROM x"),
    "m_gain_ratio": (_GAIN, "SELECT label_id, feature, round(gain, 6) AS value FROM gains"),
    "m_average_gain_ratio": (_GAIN, "SELECT round(avg(gain), 6) AS value FROM gains"),
    "m_average_absolute_correlation_numeric_attributes": ("", _corr("")),
    "m_average_kurtosis_numeric_attributes": ("", "SELECT round((" + " + ".join(f"kurtosis_pop({c})" for c in _NUMERIC) + ") / 3, 6) AS value FROM x"),
    "m_average_skewness_numeric_attributes": ("", "SELECT round((" + " + ".join(_SKEW.format(c=c) for c in _NUMERIC) + ") / 3, 6) AS value FROM x"),
    "mc_mean_ir_labelset": ("", "SELECT round(max(cnt) * avg(1.0 / cnt), 6) AS value FROM ls"),
    "mc_skewness_cardinality": (_MOM, "SELECT round(sqrt(n*(n-1))/(n-2) * m3 / pow(m2, 1.5), 6) AS value FROM m"),
    "mc_pmax": ("", "SELECT round(max(cnt) / CAST(sum(cnt) AS DOUBLE), 6) AS value FROM ls"),
    "mc_scumble": (_INTER + ", r AS (SELECT instance_id, exp(avg(ln(ir))) AS g, avg(ir) AS a FROM y JOIN ir USING (label_id) GROUP BY 1)", "SELECT round(avg(1 - g / a), 6) AS value FROM r"),
    "mc_number_unique_labelsets": ("", "SELECT count(*) FILTER (cnt = 1) AS value FROM ls"),
    "mc_average_dependent_label_pairs": (
        _PAIRS + ", chis AS (SELECT (n11+n10+n01+n00) * pow(n11*n00 - n10*n01, 2) / ((n11+n10)*(n01+n00)*(n11+n01)*(n10+n00)) AS chi FROM four)",
        "SELECT round(avg(chi) FILTER (chi > 6.635), 4) AS value FROM chis",
    ),
    "mc_proportion_nominal_attributes": ("", "SELECT CAST(0.5 AS DOUBLE) AS value"),
    "mc_mean_mean_numeric_attributes": ("", "SELECT round((avg(price) + avg(quantity) + avg(discount)) / 3, 4) AS value FROM x"),
    "mc_mean_std_numeric_attributes": ("", "SELECT round((stddev_samp(price) + stddev_samp(quantity) + stddev_samp(discount)) / 3, 4) AS value FROM x"),
    "mc_average_absolute_correlation": ("", _corr("abs")),
}
ORACLES = {name: f"WITH {frames_sql()}{', ' + more if more else ''} {select}" for name, (more, select) in _SQL.items()}
