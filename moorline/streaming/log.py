"""The event log and incremental scoring as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moorline.sources.tables import EVENT


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A growing folder of JSON lines."""
    return spark.readStream.schema(EVENT).json(path)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A growing folder of parquet files, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed(events: DataFrame, time: str, name: str, minutes: int = 60, late: str = "1 day", key: str | None = None) -> DataFrame:
    """window_start, name, events of each tumbling window; rows later than `late` are dropped, rows sent twice under one key count once."""
    t = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    if key:
        t = t.dropDuplicatesWithinWatermark([key])
    return t.groupBy(F.window("_t", f"{minutes} minutes"), name).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), name, "events")


def closed(stream: DataFrame, time: str, folder: str, key: str | None = None) -> DataFrame:
    """The stream with an end, written to `folder`: a row later than all others, whose own window is never written, so that a replay of it writes every other window."""
    spark, of = stream.sparkSession, {time: F.lit("9999-01-01 00:00:00")} | ({key: F.lit(-(2**63))} if key else {})
    spark.range(1).select(*(of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema)).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def replay(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over all that is there, then stop; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_shards(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is scored into a shard of its own; a batch that is run again writes the same shard over."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
