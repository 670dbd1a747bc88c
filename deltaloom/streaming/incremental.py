"""Incremental variants: files and events as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaloom.sources.python_code import parsed


def parse_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parses rows (repo, path, module, src) of new Parquet files under source into the index at target, once each."""
    files = spark.readStream.schema("repo string, path string, module string, src string").parquet(source)
    return parsed(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_counts(findings: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by window, file and severity; rows more than `late` behind are left out by the watermark."""
    return findings.withWatermark(at, late).groupBy(F.window(at, window), "file", "severity").agg(F.count(F.lit(1)).alias("n"))
