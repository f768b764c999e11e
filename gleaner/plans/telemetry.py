"""From telemetry files to a table, its summary and a thinned series per device."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.telemetry import DOWNSAMPLE, downsample_readings, extract_readings, summarise
from gleaner.session import write_through
from gleaner.sources.readers import read_jsonl
from gleaner.sources.sinks import write_readings_csv


def telemetry_report(
    spark: SparkSession, path: str, csv: str, max_lines: int | None = None, downsample: int = DOWNSAMPLE
) -> tuple[DataFrame, DataFrame]:
    """Write the sorted table; return the summary per device and the thinned series.

    The lines are parsed once: the long table is written through before its three uses.
    """
    readings = write_through(extract_readings(read_jsonl(spark, path, max_lines)))
    write_readings_csv(readings, csv)
    return summarise(readings, ["gpu"], "util"), downsample_readings(readings, downsample, F.to_date("ts"))
