"""Telemetry extraction over a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.telemetry import extract_readings, rejects
from gleaner.sources.readers import stream_jsonl


def stream_readings(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The batch extraction, applied to a stream: it keeps no state."""
    return extract_readings(stream_jsonl(spark, folder, max_files))


def run_readings(
    spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Extract what is there, then stop; the checkpoint remembers what was read."""
    return append_all(stream_readings(spark, folder, max_files), out, checkpoint)


def append_all(readings: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table; every row is there once, restarts included."""
    return (
        readings.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_with_rejects(
    lines: DataFrame, out: str, checkpoint: str, line: str = "value", gpu_count: int | None = None
) -> StreamingQuery:
    """Readings and rejects of a stream of lines, below ``out``: one folder per batch in each of the two tables.

    A batch that is repeated after a failure replaces its own folders, so both tables hold every row once.
    """

    def sort_out(batch: DataFrame, number: int) -> None:
        extract_readings(batch, line, gpu_count).write.mode("overwrite").parquet(f"{out}/readings/batch={number}")
        rejects(batch, line, gpu_count).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")

    return (
        lines.writeStream.foreachBatch(sort_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def sorted_out(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that ``run_with_rejects`` has written so far."""
    read = lambda kind: spark.read.option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}").drop("batch")
    return read("readings"), read("rejects")
