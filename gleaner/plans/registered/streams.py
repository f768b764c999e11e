"""The streaming forms, run over the tables as file streams until everything there is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.telemetry import extract_readings
from gleaner.plans.registered import lines, table, telemetry
from gleaner.session import shared_folder
from gleaner.streaming.extract import append_all, run_with_rejects, sorted_out
from gleaner.streaming.last_lines import current_views, merged_views, run_keep_last, run_merged_last


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    # As a pattern, because a stream takes a plain path for a folder and the table may be one file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def stream_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    run = run_folder(spark)
    readings = extract_readings(telemetry.as_lines(stream(spark, folder, "events")))
    append_all(readings, f"{run}/out", f"{run}/check").awaitTermination()
    read = spark.read.schema(readings.schema).parquet(f"{run}/out")
    return read.select("event_id", "gpu", F.unix_micros("ts").alias("ts_micros"), "util")


def last_turns_of(spark: SparkSession, folder: str, start, views) -> DataFrame:
    run = run_folder(spark)
    turns = stream(spark, folder, "conversations").select(
        F.col("conv_id").alias("feed"), F.col("turn").alias("seq"), F.col("text").alias("line")
    )
    start(spark, turns, f"{run}/out", f"{run}/check", 3).awaitTermination()
    shown = views(spark.read.option("basePath", f"{run}/out").parquet(f"{run}/out"))
    return shown.select(F.col("feed").alias("conv_id"), F.col("seq").alias("turn"), F.col("line").alias("text"))


def stream_last_turns(spark: SparkSession, folder: str) -> DataFrame:
    return last_turns_of(spark, folder, run_keep_last, current_views)


def stream_merged_turns(spark: SparkSession, folder: str) -> DataFrame:
    return last_turns_of(spark, folder, run_merged_last, merged_views)


def stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry lines next to bare numbers and broken copies: the rejects of the stream, and how many readings it gave."""
    run = run_folder(spark)
    events = stream(spark, folder, "events")
    number = F.get_json_object("props", "$.k")
    mixed = events.select("event_id", F.explode(F.array("props", number, F.concat("props", F.lit(" {")))).alias("other")).select(F.col("other").alias("value"))
    told = telemetry.as_lines(events).select("value").unionByName(mixed)
    run_with_rejects(told, f"{run}/out", f"{run}/check").awaitTermination()
    readings, refused = sorted_out(spark, f"{run}/out")
    n = readings.agg(F.lit("readings").alias("text"), F.lit("").alias("reason"), F.count("*").alias("n"))
    return refused.groupBy("text", "reason").agg(F.count("*").alias("n")).unionByName(n)


def stream_started_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Later turns as a stream that starts from the views of the earlier ones."""
    run = run_folder(spark)
    of = lambda df: df.select(F.col("conv_id").alias("feed"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    start = of(table(spark, folder, "conversations").filter("turn < 4"))
    later = of(stream(spark, folder, "conversations").filter("turn >= 4"))
    run_keep_last(spark, later, f"{run}/out", f"{run}/check", 3, start).awaitTermination()
    shown = current_views(spark.read.option("basePath", f"{run}/out").parquet(f"{run}/out"))
    return shown.select(F.col("feed").alias("conv_id"), F.col("seq").alias("turn"), F.col("line").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (stream_telemetry, stream_last_turns, stream_merged_turns, stream_rejects, stream_started_turns)
}

SQL = {
    "stream_telemetry": telemetry.SQL["telemetry_extract"],
    "stream_merged_turns": f"SELECT conv_id, turn, text FROM ({lines.SQL['last_turns']})",
    "stream_rejects": f"""
        WITH {telemetry.READINGS_SQL}
        SELECT text, reason, n FROM ({telemetry.SQL["telemetry_rejects"]})
        UNION ALL SELECT 'readings', '', count(*) FROM readings
    """,
    "stream_started_turns": f"SELECT conv_id, turn, text FROM ({lines.SQL['last_turns']})",
    "stream_last_turns": f"SELECT conv_id, turn, text FROM ({lines.SQL['last_turns']})",
}
