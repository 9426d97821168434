"""The event log: rows sent twice, time within stages, windows, latest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """Each log_id once, as it was received first; its repeats came later."""
    first = Window.partitionBy("log_id").orderBy("received_at", "logged_at")
    return log.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def stage_elapsed(log: DataFrame) -> DataFrame:
    """run_id, stage, events, started_at, ended_at, seconds, failed: what each stage of a run took."""
    t = F.col("logged_at").cast("timestamp")
    return latest(log).filter("run_id is not null and stage is not null").groupBy("run_id", "stage").agg(
        F.count("*").alias("events"), F.min("logged_at").alias("started_at"), F.max("logged_at").alias("ended_at"), F.round((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / 1e6, 3).alias("seconds"), F.max(F.coalesce(F.col("event_name") == "failed", F.lit(False))).alias("failed"))


def since_start(log: DataFrame) -> DataFrame:
    """log_id, run_id, stage, since_stage, since_run: seconds since the first event of the stage and of the run."""
    us = F.unix_micros(F.col("logged_at").cast("timestamp"))
    of = latest(log).filter("run_id is not null and stage is not null and logged_at is not null").withColumn("us", us)
    a, b = F.min("us").over(Window.partitionBy("run_id", "stage")), F.min("us").over(Window.partitionBy("run_id"))
    return of.select("log_id", "run_id", "stage", F.round((F.col("us") - a) / 1e6, 3).alias("since_stage"), F.round((F.col("us") - b) / 1e6, 3).alias("since_run"))


def window_counts(log: DataFrame, minutes: int = 60, late_minutes: int = 60) -> DataFrame:
    """window_start, event_name, events, late: events per tumbling window of logged_at, and those received later than `late_minutes` after."""
    late = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("logged_at").cast("timestamp")) > late_minutes * 60_000_000
    return latest(log).filter("logged_at is not null").groupBy(F.window("logged_at", f"{minutes} minutes").alias("w"), "event_name").agg(F.count("*").alias("events"), F.count_if(late).alias("late")).select(F.col("w.start").alias("window_start"), "event_name", "events", "late")


def latest_run(log: DataFrame) -> DataFrame:
    """stage, run_id, ended_at: the run whose end of the stage is the latest (ties: the larger run_id); failed stages don't count."""
    done = stage_elapsed(log).filter("not failed")
    return done.groupBy("stage").agg(F.max_by("run_id", F.struct("ended_at", "run_id")).alias("run_id"), F.max("ended_at").alias("ended_at"))


def keep_last(log: DataFrame, by: list[str], k: int) -> DataFrame:
    """The last k rows (by logged_at, then log_id) of each group, each log_id once; null times come first. Only k rows of a group leave a partition."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("logged_at"), F.desc("log_id"))
    return latest(log).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")
