"""Metrics of multi-label data.

Every metric returns one row with ``value``, or one row per label with ``label_id`` and
``value``. Doubles are rounded to six places, sums of many to four. Some metrics return
an index or a sum although their name promises a value or a mean; those are kept as
defined, and the ``corrected_`` ones beside them return what the name says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import binary_entropy, chi_square, entropy_term
from tessella.operators.base import cardinalities, label_counts, label_pairs, labelsets, row_labelsets
from tessella.sources.model import MultiLabelFrame

#: Chi-square beyond which a pair of labels is dependent.
CRITICAL = 6.635


def _real(c: Column | str, places: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), places).alias("value")


def _n(d: MultiLabelFrame) -> Column:
    return F.lit(d.instances.count()).cast("long")


def _l(d: MultiLabelFrame) -> Column:
    return F.lit(d.labels.count()).cast("long")


def _f(d: MultiLabelFrame) -> int:
    return len(d.feature_names())


def _scalar(d: MultiLabelFrame, value: Column) -> DataFrame:
    return d.spark.range(1).select(value.alias("value"))


# --- size ---


def instances(d):
    return d.instances.agg(F.count("*").alias("value"))


def attributes(d):
    return _scalar(d, F.lit(_f(d)).cast("long"))


def labels(d):
    return d.labels.agg(F.count("*").alias("value"))


def distinct_labels(d):
    return d.y.agg(F.count_distinct("label_id").alias("value"))


def total_labels(d):
    return d.y.agg(F.count("*").alias("value"))


def distinct_labelsets(d):
    return row_labelsets(d).select("labelset").distinct().agg(F.count("*").alias("value"))


def list_labelsets(d):
    """The distinct labelsets, in order of their first instance."""
    return labelsets(d).select(F.concat_ws(",", F.col("labelset").cast("array<string>")).alias("labelset"), "cnt", "first_seen")


def lxixf(d):
    return _scalar(d, _l(d) * _n(d) * F.lit(_f(d)))


def ratio_instances_features(d):
    return d.instances.agg(_real(F.try_divide(F.count("*"), F.lit(_f(d)))))


# --- label distribution ---


def cardinality(d):
    return cardinalities(d).agg(_real(F.try_divide(F.sum("k"), F.count("*"))))


def density(d):
    return cardinalities(d).agg(_real(F.try_divide(F.sum("k"), F.count("*") * _l(d))))


def frequency(d):
    return label_counts(d).select("label_id", _real(F.try_divide("c", _n(d))))


def std_label_cardinality(d):
    return cardinalities(d).agg(_real(F.stddev_pop("k")))


def entropy_labels(d):
    return label_counts(d).select("label_id", _real(binary_entropy(F.col("c"), _n(d))))


def min_max_mean_entropy_labels(d):
    """Label of the least entropy (the first of equals), of the largest (the last of equals), and the mean."""
    e = label_counts(d).select("label_id", F.round(binary_entropy(F.col("c"), _n(d)), 12).alias("e"))
    return e.agg(
        F.min_by("label_id", F.struct("e", "label_id")).alias("min_label_id"),
        F.max_by("label_id", F.struct("e", "label_id")).alias("max_label_id"),
        F.round(F.avg("e"), 6).alias("mean_entropy"),
    )


# --- imbalance ---


def _inter(d) -> DataFrame:
    c = label_counts(d)
    top = c.agg(F.max("c")).first()[0]
    return c.select("label_id", F.when(F.col("c") < 1, 0.0).otherwise(F.try_divide(F.lit(top), F.col("c"))).alias("ir"))


def _intra(d) -> DataFrame:
    n, c = _n(d), F.col("c")
    return label_counts(d).select("label_id", F.when(F.least(n, c) < 1, 0.0).otherwise(F.try_divide(F.greatest(n, c), F.least(n, c))).alias("ir"))


def _argmax(ir: DataFrame) -> DataFrame:
    return ir.agg(F.max_by("label_id", F.struct(F.round("ir", 9), -F.col("label_id"))).alias("max_label_id"))


def imbalance_ratio_inter_class(d):
    return _inter(d).select("label_id", _real("ir"))


def mean_ir_inter_class(d):
    return _inter(d).agg(_real(F.avg("ir")))


def max_ir_inter_class(d):
    return _argmax(_inter(d))


def cvir_inter_class(d):
    return _inter(d).agg(_real(F.try_divide(F.stddev_samp("ir"), F.avg("ir"))))


def imbalance_ratio_intra_class(d):
    return _intra(d).select("label_id", _real("ir"))


def mean_ir_intra_class(d):
    return _intra(d).agg(_real(F.avg("ir")))


def max_ir_intra_class(d):
    return _argmax(_intra(d))


def std_ir_intra_class(d):
    return label_counts(d).select("label_id", _real(F.abs(F.col("c") - _n(d) / 2)))


def mean_std_ir_intra_class(d):
    return label_counts(d).agg(_real(F.avg(F.abs(F.col("c") - _n(d) / 2))))


def _top_labelset(d) -> tuple[int, DataFrame]:
    """The 0-based place, by first appearance, of the first labelset with the largest weight; and the labelsets.

    The place is the number of labelsets seen before it: no global numbering is needed.
    """
    ls = labelsets(d)
    top = ls.agg(F.max_by("first_seen", F.struct("w", -F.col("first_seen"))).alias("at")).first()["at"]
    return (0 if top is None else ls.filter(F.col("first_seen") < top).count()), ls


def _ir_labelset(d) -> DataFrame:
    place, ls = _top_labelset(d)
    share = F.try_divide("w", _l(d))
    return ls.select("labelset", "cnt", "first_seen", F.when(share <= 0, 0.0).otherwise(F.try_divide(F.lit(float(place)), share)).alias("ir"))


def imbalance_ratio_labelset(d):
    """Per labelset: the place of the heaviest labelset over the set's own weight."""
    return _ir_labelset(d).select(F.concat_ws(",", F.col("labelset").cast("array<string>")).alias("labelset"), _real("ir"))


def mean_ir_labelset(d):
    return _ir_labelset(d).agg(_real(F.avg("ir")))


def max_ir_labelset(d):
    return _scalar(d, F.lit(_top_labelset(d)[0]).cast("long"))


def corrected_mean_ir_labelset(d):
    """Mean over labelsets of the most frequent one's count over the set's own."""
    ls = labelsets(d)
    return ls.agg(_real(F.max("cnt") * F.avg(F.try_divide(F.lit(1.0), F.col("cnt")))))


def _moments(d) -> DataFrame:
    mean = cardinalities(d).agg(F.avg("k")).first()[0] or 0.0
    k = F.col("k") - F.lit(float(mean))
    return cardinalities(d).agg(F.count("*").cast("double").alias("n"), F.avg(F.pow(k, 2)).alias("m2"), F.avg(F.pow(k, 4)).alias("m4"), F.sum(F.pow(k, 3)).alias("t"), F.avg(F.pow(k, 3)).alias("m3"))


def kurtosis_cardinality(d):
    n = F.col("n")
    g = F.try_divide("m4", F.pow("m2", F.lit(2.0))) - 3
    return _moments(d).select(_real(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)))


def skewness_cardinality(d):
    """Null unless the third moment is positive."""
    n, t = F.col("n"), F.col("t")
    found = F.try_divide(n, (n - 1) * (n - 2)) * F.try_divide(t, F.pow(F.try_divide(t, n - 1), F.lit(1.5)))
    return _moments(d).select(_real(F.when(t > 0, found)))


def corrected_skewness_cardinality(d):
    n = F.col("n")
    return _moments(d).select(_real(F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.try_divide("m3", F.pow("m2", F.lit(1.5)))))


def pmax(d):
    return _scalar(d, F.lit(_top_labelset(d)[0]).cast("long"))


def corrected_pmax(d):
    """The share of instances with the most frequent labelset."""
    return labelsets(d).agg(_real(F.try_divide(F.max("cnt"), F.sum("cnt"))))


# --- relations between labels ---


def bound(d):
    return _scalar(d, F.pow(F.lit(2.0), _l(d)))


def diversity(d):
    return row_labelsets(d).select("labelset").distinct().agg(_real(F.count("*") / F.pow(F.lit(2.0), _l(d)), 12))


def scumble(d):
    """The share of instances that lack a label."""
    return cardinalities(d).agg(_real(F.avg((F.col("k") < _l(d)).cast("double"))))


def corrected_scumble(d):
    """Mean over labelled instances of one minus the geometric over the arithmetic mean of their labels' imbalance ratios."""
    # Equal sets have equal ratios: sets are counted first, so that a label of most instances doesn't bring them to one task.
    sets = d.y.groupBy("instance_id").agg(F.sort_array(F.collect_list("label_id")).alias("labelset")).groupBy("labelset").agg(F.count("*").alias("cnt"))
    one = sets.select("labelset", "cnt", F.explode("labelset").alias("label_id")).join(F.broadcast(_inter(d)), "label_id")
    rows = one.groupBy("labelset", "cnt").agg(F.exp(F.avg(F.ln("ir"))).alias("geometric"), F.avg("ir").alias("mean"))
    off = 1 - F.try_divide("geometric", "mean")
    return rows.agg(_real(F.try_divide(F.sum(off * F.col("cnt")), F.sum(F.when(off.isNotNull(), F.col("cnt"))))))


def proportion_distinct_labelsets(d):
    return labelsets(d).agg(_real(F.try_divide(F.count("*"), F.sum("cnt"))))


def number_labelsets_to_n_instances(d, n: int = 20000):
    return labelsets(d).agg(F.count_if(F.col("w") <= n).alias("value"))


def ratio_labelsets_to_n_instances(d, n: int = 20000):
    return labelsets(d).agg(_real(F.try_divide(F.count_if(F.col("w") <= n), F.count("*"))))


def average_instances_per_labelset(d):
    return labelsets(d).agg(_real(F.try_divide(F.sum("cnt"), F.count("*"))))


def std_instances_per_labelset(d):
    """Root of the mean squared distance of the sets' weights from the average instances per set."""
    ls = labelsets(d)
    average = ls.agg(F.try_divide(F.sum("cnt"), F.count("*"))).first()[0]
    return ls.agg(_real(F.sqrt(F.avg(F.pow(F.col("w") - F.lit(average), 2)))))


def number_unique_labelsets(d):
    return labelsets(d).agg(F.count_if(F.col("w") == 1).alias("value"))


def corrected_number_unique_labelsets(d):
    return labelsets(d).agg(F.count_if(F.col("cnt") == 1).alias("value"))


def ratio_labelsets_half_attributes(d):
    return labelsets(d).agg(_real(F.try_divide(F.count_if(F.col("w") <= _f(d) / 2), F.count("*"))))


def _chi(d) -> DataFrame:
    n, n11 = _n(d), F.col("n11")
    n10, n01 = F.col("c_a") - n11, F.col("c_b") - n11
    return label_pairs(d).select("a", "b", chi_square(n11, n10, n01, n - n11 - n10 - n01).alias("chi"))


def number_unconditionally_dependent_label_pairs(d):
    return _chi(d).agg(F.count_if(F.col("chi") > CRITICAL).alias("value"))


def ratio_unconditionally_dependent_label_pairs(d):
    return _chi(d).agg(_real(F.try_divide(F.count_if(F.col("chi") > CRITICAL), F.count("*"))))


def average_unconditionally_dependent_label_pairs(d):
    """The sum of the chi-squares above the critical value."""
    return _chi(d).agg(_real(F.coalesce(F.sum(F.when(F.col("chi") > CRITICAL, F.col("chi"))), F.lit(0.0)), 3))


def corrected_average_dependent_label_pairs(d):
    """The mean, over dependent pairs, of the chi-square of their two-by-two table."""
    n, n11 = _n(d), F.col("n11")
    n10, n01 = F.col("c_a") - n11, F.col("c_b") - n11
    n00 = n - n11 - n10 - n01
    cross = (n11 * n00 - n10 * n01).cast("double")
    chi = F.try_divide(n * cross * cross, (n11 + n10).cast("double") * (n01 + n00) * (n11 + n01) * (n10 + n00))
    return label_pairs(d).select(chi.alias("chi")).agg(_real(F.avg(F.when(F.col("chi") > CRITICAL, F.col("chi"))), 4))


# --- attributes ---


def _binary(d) -> Column:
    return sum((F.min(F.col(c).cast("double").isin(0.0, 1.0)).cast("long") for c in d.feature_names()), F.lit(0).cast("long"))


def number_binary_attributes(d):
    return d.x.agg(_binary(d).alias("value"))


def number_nominal_attributes(d):
    return _scalar(d, F.lit(len(d.nominal_names())).cast("long"))


def number_numeric_attributes(d):
    return _scalar(d, F.lit(len(d.numeric_names())).cast("long"))


def proportion_binary_attributes(d):
    return d.x.agg(_real(_binary(d) / _f(d)))


def proportion_nominal_attributes(d):
    """The share of columns whose values, cut to integers, don't add up to zero."""
    sums = [(F.sum(F.col(c).cast("long")) != 0).cast("long") for c in d.feature_names()]
    return d.x.agg(_real(sum(sums, F.lit(0)) / _f(d)))


def corrected_proportion_nominal_attributes(d):
    return _scalar(d, _real(F.lit(len(d.nominal_names()) / _f(d))))


def proportion_numeric_attributes(d):
    return _scalar(d, _real(F.lit(len(d.numeric_names()) / _f(d))))


def _cells(d) -> DataFrame:
    """(instance_id, feature, value as an integer) of all features."""
    names = d.feature_names()
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("v")) for c in names])
    return d.x.select("instance_id", F.explode(cells).alias("cell")).select("instance_id", "cell.feature", "cell.v")


def _value_entropy(d) -> DataFrame:
    """(feature, h): entropy of each feature's integer values."""
    n = _n(d)
    return _cells(d).groupBy("feature", "v").agg(F.count("*").alias("c")).groupBy("feature").agg(F.sum(entropy_term(F.col("c") / n)).alias("h"))


def entropy_attribute(d):
    return _value_entropy(d).select("feature", _real("h"))


def mean_entropies_nominal_attributes(d):
    """Per feature: the entropy of its values over the number of instances."""
    return _value_entropy(d).select("feature", _real(F.try_divide("h", _n(d)), 9))


def mean_mean_numeric_attributes(d):
    """The sum of the numeric columns' means over the number of instances."""
    return d.x.agg(_real(F.try_divide(sum((F.avg(c) for c in d.numeric_names()), F.lit(0.0)), F.count("*")), 4))


def corrected_mean_mean_numeric_attributes(d):
    return d.x.agg(_real(sum((F.avg(c) for c in d.numeric_names()), F.lit(0.0)) / len(d.numeric_names()), 4))


def mean_std_numeric_attributes(d):
    """The first numeric column's deviation, as often as there are such columns, over the number of instances."""
    names = d.numeric_names()
    return d.x.agg(_real(F.try_divide(len(names) * F.stddev_samp(names[0]), F.count("*")), 4))


def corrected_mean_std_numeric_attributes(d):
    names = d.numeric_names()
    return d.x.agg(_real(sum((F.stddev_samp(c) for c in names), F.lit(0.0)) / len(names), 4))


def _gains(d) -> DataFrame:
    """(label_id, feature, gain): entropy of the label, less that among instances where the feature isn't zero, over the feature's."""
    n = _n(d)
    some = _cells(d).filter("v <> 0")
    within = some.groupBy("feature").agg(F.count("*").alias("m"))
    ones = some.join(d.y, "instance_id").groupBy("feature", "label_id").agg(F.count("*").alias("ones"))
    every = F.array(*map(F.lit, d.feature_names()))
    grid = label_counts(d).withColumn("feature", F.explode(every))
    rows = grid.join(within, "feature", "left").join(ones, ["feature", "label_id"], "left").join(_value_entropy(d), "feature")
    rest = F.when(F.col("m").isNull(), 0.0).otherwise(binary_entropy(F.coalesce("ones", F.lit(0)), F.col("m")))
    gain = F.when(F.abs("h") > 1e-9, (binary_entropy(F.col("c"), n) - rest) / F.col("h"))
    return rows.select("label_id", "feature", gain.alias("gain"))


def gain_ratio(d):
    return _gains(d).select("label_id", "feature", _real("gain"))


def average_gain_ratio(d):
    """The mean over labels and features; features with one value have no ratio."""
    return _gains(d).agg(_real(F.avg("gain")))


def _correlations(d, f) -> DataFrame:
    names = d.numeric_names()
    pairs = [F.corr(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    known = F.filter(F.array(*[F.when(~F.isnan(p), p) for p in pairs]), lambda v: v.isNotNull())
    return d.x.agg(known.alias("r")).select(_real(F.try_divide(F.aggregate("r", F.lit(0.0), lambda s, v: s + f(v)), F.size("r"))))


def average_absolute_correlation_numeric_attributes(d):
    """The mean correlation of numeric columns, with its sign."""
    return _correlations(d, lambda v: v)


def corrected_average_absolute_correlation(d):
    return _correlations(d, F.abs)


def average_kurtosis_numeric_attributes(d):
    names = d.numeric_names()
    return d.x.agg(_real(sum((F.kurtosis(c) for c in names), F.lit(0.0)) / len(names)))


def average_skewness_numeric_attributes(d):
    names = d.numeric_names()
    return d.x.agg(_real(sum((F.skewness(c) for c in names), F.lit(0.0)) / len(names)))


#: All metrics, by name.
METRICS = {
    f.__name__: f
    for f in (
        instances, attributes, labels, distinct_labels, total_labels, distinct_labelsets, list_labelsets, lxixf, ratio_instances_features,
        cardinality, density, frequency, std_label_cardinality, entropy_labels, min_max_mean_entropy_labels,
        imbalance_ratio_inter_class, mean_ir_inter_class, max_ir_inter_class, cvir_inter_class,
        imbalance_ratio_intra_class, mean_ir_intra_class, max_ir_intra_class, std_ir_intra_class, mean_std_ir_intra_class,
        imbalance_ratio_labelset, mean_ir_labelset, max_ir_labelset, kurtosis_cardinality, skewness_cardinality, pmax,
        bound, diversity, scumble, proportion_distinct_labelsets, number_labelsets_to_n_instances, ratio_labelsets_to_n_instances,
        average_instances_per_labelset, std_instances_per_labelset, number_unique_labelsets, ratio_labelsets_half_attributes,
        number_unconditionally_dependent_label_pairs, ratio_unconditionally_dependent_label_pairs, average_unconditionally_dependent_label_pairs,
        number_binary_attributes, number_nominal_attributes, number_numeric_attributes, proportion_binary_attributes,
        proportion_nominal_attributes, proportion_numeric_attributes, entropy_attribute, mean_entropies_nominal_attributes,
        mean_mean_numeric_attributes, mean_std_numeric_attributes, gain_ratio, average_gain_ratio,
        average_absolute_correlation_numeric_attributes, average_kurtosis_numeric_attributes, average_skewness_numeric_attributes,
        corrected_mean_ir_labelset, corrected_skewness_cardinality, corrected_pmax, corrected_scumble, corrected_number_unique_labelsets,
        corrected_average_dependent_label_pairs, corrected_proportion_nominal_attributes, corrected_mean_mean_numeric_attributes,
        corrected_mean_std_numeric_attributes, corrected_average_absolute_correlation,
    )
}
