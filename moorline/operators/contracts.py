"""Contracts of the input and output tables: what breaks them as a table, and checks that raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moorline.functions.numeric import finite
from moorline.sources.tables import TEXTS


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.regexp_replace(F.col(c), r"(?U)\s+", "") == "")


def violations(df: DataFrame, labelled: bool) -> DataFrame:
    """check, violations: how many rows break each check of a labelled or unlabelled table, from one pass. An empty table breaks `empty` once."""
    checks = {"row_id_null": F.count_if(F.col("row_id").isNull()), "row_id_repeated": F.count("row_id") - F.count_distinct("row_id"), "empty": F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint")}
    checks |= {f"{c}_blank": F.count_if(_blank(c)) for c in TEXTS}
    if labelled:
        checks["label_invalid"] = F.count_if(F.coalesce(~F.col("rule_violation").isin(0, 1), F.lit(True)))
    one = df.agg(*(v.alias(k) for k, v in checks.items()))
    return one.unpivot([], list(checks), "check", "violations")


def check_frame(df: DataFrame, labelled: bool) -> None:
    """Raise where a table breaks its contract; an unlabelled table must not hold the target. Further columns are fine."""
    missing = {"row_id", *TEXTS, *(["rule_violation"] if labelled else [])} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if not labelled and "rule_violation" in df.columns:
        raise ValueError("a table without labels must not hold rule_violation")
    bad = violations(df, labelled).filter("violations > 0").collect()
    if bad:
        raise ValueError("broken contract: " + ", ".join(f"{r.check} ({r.violations})" for r in sorted(bad)))


def with_place(df: DataFrame, column: str = "place") -> DataFrame:
    """The place of each row in the order of its source: partitions in order, rows within them. For sources read once; ids are not dense."""
    return df.withColumn(column, F.monotonically_increasing_id())


def misaligned(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows whose row_id differs at the same place, places that one side lacks included."""
    a, b = left.select(place, F.col("row_id").alias("a")), right.select(place, F.col("row_id").alias("b"))
    return a.join(b, place, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def submission_violations(submission: DataFrame, sample: DataFrame, place: str) -> DataFrame:
    """check, violations of a submission against the sample; both hold `place`, the explicit order."""
    p = F.col("rule_violation")
    own = submission.agg(
        F.count_if(F.col("row_id").isNull()).alias("row_id_null"), (F.count("row_id") - F.count_distinct("row_id")).alias("row_id_repeated"),
        F.count_if(F.coalesce(~finite(p) | (p < 0) | (p > 1), F.lit(True))).alias("not_a_probability"),
    ).unpivot([], ["row_id_null", "row_id_repeated", "not_a_probability"], "check", "violations")
    return own.unionByName(misaligned(submission, sample, place).agg(F.lit("misaligned").alias("check"), F.count("*").alias("violations")))


def check_submission(submission: DataFrame, sample: DataFrame) -> None:
    if submission.columns != ["row_id", "rule_violation"]:
        raise ValueError("a submission holds exactly row_id and rule_violation")
    place = Window.orderBy("_at")  # submissions are single files
    at = lambda d: with_place(d, "_at").withColumn("place", F.row_number().over(place)).drop("_at")
    bad = submission_violations(at(submission), at(sample), "place").filter("violations > 0").collect()
    if bad or submission.isEmpty():
        raise ValueError("invalid submission: " + (", ".join(f"{r.check} ({r.violations})" for r in bad) or "no rows"))


def shared_ids(train: DataFrame, test: DataFrame) -> DataFrame:
    """row_ids in both tables."""
    return train.select("row_id").intersect(test.select("row_id"))


def check_load(train: DataFrame, test: DataFrame, sample: DataFrame) -> None:
    """The three tables as one input: contracts, the sample's order, disjoint ids."""
    check_frame(train, True)
    check_frame(test, False)
    check_submission(sample, test.select("row_id", F.lit(0.5).alias("rule_violation")))
    if not shared_ids(train, test).isEmpty():
        raise ValueError("train and test share row ids")


def coverage(oof: DataFrame, train: DataFrame) -> DataFrame:
    """model, protocol, predicted, repeated, missing, unknown: how predictions cover the labelled rows."""
    ids = train.select("row_id").distinct().withColumn("known", F.lit(True))
    per = oof.groupBy("model", "protocol", "row_id").agg(F.count("*").alias("n")).join(ids, "row_id", "left")
    total = ids.count()
    return per.groupBy("model", "protocol").agg(F.count("*").alias("predicted"), F.count_if(F.col("n") > 1).alias("repeated"), (F.lit(total) - F.count("known")).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"))


def grid_gaps(observed: DataFrame, models: list[str], protocols: list[str]) -> DataFrame:
    """model, protocol, side: expected cells that are missing and observed ones that are not expected."""
    spark = observed.sparkSession
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    expected = one("model", models).crossJoin(one("protocol", protocols))  # a few cells
    seen = observed.select("model", "protocol").distinct()
    return expected.exceptAll(seen).withColumn("side", F.lit("missing")).unionByName(seen.exceptAll(expected).withColumn("side", F.lit("extra")))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
