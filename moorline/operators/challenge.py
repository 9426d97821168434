"""Evaluation of decided cases at several levels at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.functions.numeric import rate

DECISIONS = ("allowed", "violation", "abstain")


def invalid_cases(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """id, problem of the cases (id, slice, policy, query, expected) that break the suite's contract."""
    repeated = cases.groupBy("id").agg(F.count("*").alias("n"))
    known = policies.select(F.col("id").alias("policy")).distinct().withColumn("known", F.lit(True))
    p = (
        F.when(~F.coalesce(F.col("id").rlike("^[a-z][a-z0-9-]+$"), F.lit(False)) | (F.col("n") > 1), "invalid or repeated id").when(~F.coalesce(F.col("slice").rlike("^[a-z][a-z0-9-]+$"), F.lit(False)), "invalid slice")
        .when(F.coalesce(F.length(F.trim("query")), F.lit(0)) == 0, "empty query").when(F.length("query") > 1200, "oversized query").when(F.col("known").isNull(), "unknown policy").when(~F.coalesce(F.col("expected").isin(*DECISIONS), F.lit(False)), "invalid expected decision")
    )
    return cases.join(repeated, "id", "left").join(known, "policy", "left").select("id", p.alias("problem")).filter("problem is not null")


def summaries(rows: DataFrame, levels: list[str]) -> DataFrame:
    """One row in all and one for each value of each level: counts and rates of expected and decision; the level columns are null where they are summed over, `level` names the one that is not. Rates over nothing are null."""
    sets = [[], *([x] for x in levels)]
    labelled, decided, right = F.col("expected") != "abstain", F.col("decision") != "abstain", F.col("expected") == F.col("decision")
    n = F.count_if
    agg = rows.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(
        F.concat_ws("", *(F.when(F.grouping(x) == 0, F.lit(x)) for x in levels)).alias("level"), F.count("*").alias("cases"), n(right).alias("correct"), n(~right).alias("failures"), n(labelled).alias("labeled_cases"), n(labelled & decided).alias("decided_labeled_cases"), n(labelled & decided & right).alias("_right"),
        n((F.col("expected") == "allowed") & (F.col("decision") == "violation")).alias("false_violations"), n((F.col("expected") == "violation") & (F.col("decision") == "allowed")).alias("false_allowances"), n(~labelled).alias("unsupported_cases"), n(~labelled & ~decided).alias("unsupported_abstentions"),
    )
    c = F.col
    return agg.select(*levels, "level", "cases", "correct", "failures", rate(c("correct"), c("cases")).alias("agreement"), "labeled_cases", "decided_labeled_cases", rate(c("decided_labeled_cases"), c("labeled_cases")).alias("decision_coverage"), rate(c("_right"), c("decided_labeled_cases")).alias("selective_agreement"), "false_violations", "false_allowances", "unsupported_cases", "unsupported_abstentions")
