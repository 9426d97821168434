"""Metrics of scored rows (label, probability) by group: exact AUC, average precision, losses, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions.numeric import EPS, finite
from moorline.operators.prefix import sums_below

Y, P = "rule_violation", "probability"


def clean(oof: DataFrame) -> DataFrame:
    """Whole rows once, without those that lack a label or a finite probability in 0..1."""
    p = F.col(P)
    return oof.filter(finite(p) & p.between(0, 1) & F.col(Y).isin(0, 1)).distinct()


def check_inputs(scored: DataFrame) -> None:
    """Raise on labels or probabilities that metrics can't take, on no rows, and on a group of `rule` with one class."""
    p = F.col(P)
    r = scored.agg(F.count("*").alias("n"), F.count_if(F.coalesce(~finite(p) | ~p.between(0, 1) | ~F.col(Y).isin(0, 1), F.lit(True))).alias("bad")).first()
    if not r.n or r.bad:
        raise ValueError("invalid labels or probabilities")
    one = scored.groupBy("rule").agg(F.min(Y).alias("a"), F.max(Y).alias("b")).filter("a = b").limit(1).collect()
    if one:
        raise ValueError(f"AUC is undefined for the single-class rule {one[0].rule}")


def _curve(scored: DataFrame, by: list[str]) -> DataFrame:
    return sums_below(scored, by, P, {"pos": F.sum(F.col(Y).cast("bigint")), "n": F.count("*")})


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, auc: the chance that a positive row scores above a negative one, ties by half; null where a class is missing."""
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    out = _curve(scored, by).groupBy(*by).agg(F.sum(F.col("pos") * (neg_below + neg / 2.0)).alias("u"), F.sum("pos").alias("n1"), F.sum(neg).alias("n0"))
    return out.select(*by, F.try_divide(F.col("u"), (F.col("n1") * F.col("n0")).cast("double")).alias("auc"))


def macro_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, macro_auc: the plain mean of the AUCs of the rules, by being a part of the rules' groups."""
    return auc(scored, [*by, "rule"]).groupBy(*by).agg(F.avg("auc").alias("macro_auc"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, average_precision: over distinct thresholds from the top, the step in recall times precision."""
    curve = _curve(scored, by)
    total = scored.groupBy(*by).agg(F.sum(F.col(Y).cast("bigint")).alias("n1"), F.count("*").alias("all"))
    curve = curve.join(total, by) if by else curve.crossJoin(total)
    precision = (F.col("n1") - F.col("pos_below")) / (F.col("all") - F.col("n_below")).cast("double")
    return curve.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("n1").cast("double")) * precision).alias("average_precision"))


def bin_of(p: Column) -> Column:
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def calibration(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, bin, mean_probability, observed_rate, count of the ten equal bins that hold rows."""
    return scored.groupBy(*by, bin_of(F.col(P)).alias("bin")).agg(F.avg(P).alias("mean_probability"), F.avg(Y).alias("observed_rate"), F.count("*").alias("count"))


def ece(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, ece: the mean gap of the bins, weighed by their rows."""
    c = calibration(scored, by)
    return c.groupBy(*by).agg((F.sum(F.col("count") * F.abs(F.col("observed_rate") - F.col("mean_probability"))) / F.sum("count")).alias("ece"))


def pointwise(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, rows, log_loss, brier, tn, fp, fn, tp, precision, recall, f1 (threshold 0.5, 0 where undefined), from one pass."""
    p, y = F.col(P), F.col(Y)
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    hit = p >= 0.5
    n = lambda c: F.count_if(c)
    one = scored.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), n(~hit & (y == 0)).alias("tn"), n(hit & (y == 0)).alias("fp"), n(~hit & (y == 1)).alias("fn"), n(hit & (y == 1)).alias("tp"))
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("*", d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), d(2 * tp, 2 * tp + fp + fn).alias("f1"))


def record(scored: DataFrame, by: list[str]) -> DataFrame:
    """by and one struct `metrics` of everything above, with the rules' AUCs as a map and the confusion matrix as arrays."""
    rules = auc(scored, [*by, "rule"]).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "auc")))).alias("per_rule_auc"))
    out = pointwise(scored, by)
    for part in (macro_auc(scored, by), auc(scored, by).withColumnRenamed("auc", "pooled_auc"), average_precision(scored, by), ece(scored, by), rules):
        out = out.join(part, by)
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix_at_0_5")
    names = {"macro_auc": "rule_macro_auc", "per_rule_auc": "per_rule_auc", "pooled_auc": "pooled_auc", "average_precision": "average_precision", "log_loss": "log_loss", "brier": "brier", "ece": "ece_10_equal_width_bins", "precision": "precision_at_0_5", "recall": "recall_at_0_5", "f1": "f1_at_0_5"}
    return out.select(*by, F.struct(*(F.col(a).alias(b) for a, b in names.items()), matrix).alias("metrics"))


def same_number(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))


def differing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two long tables (keys, path, value) whose values differ or of which one side lacks the path."""
    on = [*keys, "path"]
    return expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), on, "full_outer").filter(~F.coalesce(same_number(F.col("expected"), F.col("actual")), F.lit(False)))


def error_review(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows with their absolute error, the largest first, all or the `limit` largest."""
    out = scored.withColumn("absolute_error", F.abs(F.col(Y) - F.col(P))).orderBy(F.desc("absolute_error"), "model", "protocol", "row_id")
    return out if limit is None else out.limit(limit)


def policy_ranks(scored: DataFrame, by: list[str], value: str = P) -> DataFrame:
    """The rows with `rank`: (mean rank within the group - 0.5) / size, ties alike. Groups by the raw rule text; any size of group is ranked side by side."""
    at = sums_below(scored, by, value, {"n": F.count("*")})
    total = scored.groupBy(*by).agg(F.count("*").alias("_all"))
    rank = at.join(total, by).select(*by, value, ((F.col("n_below") + (F.col("n") + 1) / 2.0 - 0.5) / F.col("_all")).alias("rank"))
    return scored.join(rank, [*by, value])


def check_finite(scored: DataFrame, value: str) -> None:
    if scored.filter(F.coalesce(~finite(F.col(value)), F.lit(True))).limit(1).count():
        raise ValueError("invalid decision scores")


def blend(ranks: list[tuple[DataFrame, float]], key: list[str]) -> DataFrame:
    """key, blended: the weighted sum of rank columns of several tables."""
    out = None
    for k, (df, w) in enumerate(ranks):
        part = df.select(*key, (F.col("rank") * w).alias(f"r{k}"))
        out = part if out is None else out.join(part, key)
    return out.select(*key, sum((F.col(f"r{k}") for k in range(len(ranks))), F.lit(0.0)).alias("blended"))
