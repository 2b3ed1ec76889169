"""Structured Streaming forms of the time buckets and of the rules (an extension: batch is the base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import Rule


def read_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed(stream: DataFrame, ts: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """Counts, sums and means by event-time window, with a watermark for late rows."""
    t = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = t.groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "sum", "mean")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key: rows with no gap longer than ``gap``."""
    t = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = t.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def split_by_rules(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each row with the rules that it fails."""
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(f"r{i}")) for i, r in enumerate(rules)]))
    return stream.withColumn("failed_rules", failed)


def run_once(out: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and give the result as a table (tests and backfills)."""
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)
