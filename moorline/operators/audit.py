"""The audit of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.functions.text import normalize


def body_keys(df: DataFrame) -> DataFrame:
    return df.select(normalize("body").alias("key")).filter("key is not null")


def body_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct normalised bodies that both tables hold."""
    return body_keys(train).intersect(body_keys(test))


def audit(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: train_rows, test_rows, duplicate_bodies, body_overlap, prevalence, train_rules, test_rules. Null bodies count as no body."""
    n = train.agg(F.count("*").alias("train_rows"), F.avg("rule_violation").alias("prevalence"), F.sort_array(F.collect_set("rule")).alias("train_rules"))
    m = test.agg(F.count("*").alias("test_rows"), F.sort_array(F.collect_set("rule")).alias("test_rules"))
    d = body_keys(train).groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicate_bodies"))
    o = body_overlap(train, test).agg(F.count("*").alias("body_overlap"))
    return n.crossJoin(m).crossJoin(d).crossJoin(o)  # one row each


def by_rule(train: DataFrame) -> DataFrame:
    """rule, rows, prevalence."""
    return train.groupBy("rule").agg(F.count("*").alias("rows"), F.avg("rule_violation").alias("prevalence"))


def duplicate_flags(train: DataFrame) -> DataFrame:
    """row_id, duplicate: false for the first row of a normalised body (by row_id), true for the others; null bodies are one body."""
    rows = train.select("row_id", F.coalesce(F.sha2(normalize("body"), 256), F.lit("")).alias("key"))
    firsts = rows.groupBy("key").agg(F.min("row_id").alias("first"))
    return rows.join(firsts, "key").select("row_id", (F.col("row_id") > F.col("first")).alias("duplicate"))
