"""Events as telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.matching import nearest_sync as sync
from gleaner.operators.telemetry import (
    devices,
    downsample,
    downsample_readings,
    extract_readings,
    rejects,
    summarise,
)
from gleaner.plans.registered import table


DAY = 86_400_000_000
# Length of an instant, and number of keys, of the nearest-in-time query.
COARSE = 600_000_000
SHARED_KEYS = 50
# Events whose lines are parsed by one task: a parse takes a good part of a millisecond, and a file may hold a million
# events that only one task can read.
PARSED_ROWS = 25_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds of a zone-less time, from its fields, so that the session zone plays no part."""
    seconds = F.unix_date(ts.cast("date")) * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def cents(value: Column) -> Column:
    """Whole cents: sums and means of them are exact in every engine."""
    return F.round(value * 100).cast("bigint")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over tasks by their number, however they are stored."""
    return rows.repartition(max(-(-rows.count() // PARSED_ROWS), 1))


def telemetry_lines(spark: SparkSession, folder: str) -> DataFrame:
    return as_lines(spread(table(spark, folder, "events")))


def as_lines(events: DataFrame) -> DataFrame:
    """Events written as JSON lines in five shapes, one per event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    micros = epoch_micros(F.col("ts"))
    seconds = F.format_string("%d.%06d", F.floor(micros / 1_000_000), micros % 1_000_000)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    u, v = F.col("user_id"), F.col("value").cast("string")
    listed = F.format_string(
        '{"ts":%s,"host":"a","gpus":[{"index":%d,"utilization":%s},{"index":%d,"mem_usage":"high","util":%d},'
        '{"name":"x"}],"gpu9_util":99}',
        seconds, u % 8, v, (u + 1) % 8, k,
    )
    keyed = F.format_string(
        '{"timestamp":"%sZ","gpu%d_util":%s,"GPU-4-utilization":%d,"my_gpu0_util":5}', iso, u % 4, v, k
    )
    nested = F.format_string(
        '{"ts":null,"time":"%s","node":{"a":{"b":{"gpu_3_util":%s}}},"list":[{"gpu1_util":7}]}', seconds, v
    )
    plain = F.format_string('{"t":%s,"k":%d,"temp":120,"load":%s,"on":true}', seconds, k, v)
    inner = F.format_string(
        '{"meta":{"ts":"%s+00:00"},"gpus":[{"gpu":0,"id":%d,"usage":"7","gpu_util":{"note":"x","gpu":%s}}]}',
        F.translate(iso, "T", " "), u % 16, v,
    )
    line = (
        F.when(F.col("event_type") == "click", listed)
        .when(F.col("event_type") == "view", keyed)
        .when(F.col("event_type") == "error", nested)
        .when(F.col("event_type") == "purchase", plain)
        .otherwise(inner)
    )
    return events.select("event_id", line.alias("value"))


def telemetry_extract(spark: SparkSession, folder: str) -> DataFrame:
    read = extract_readings(telemetry_lines(spark, folder))
    return read.select("event_id", "gpu", F.unix_micros("ts").alias("ts_micros"), "util")


def telemetry_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Props next to their bare numbers and to broken copies: only the numbers are rejects."""
    props = table(spark, folder, "events").select("props")
    number = F.get_json_object("props", "$.k")
    lines = props.select(
        F.explode(F.array("props", number, F.rtrim(F.lit("}"), F.col("props")), F.concat("props", F.lit(" x")))).alias("value")
    )
    return rejects(lines).groupBy("text", "reason").agg(F.count(F.lit(1)).alias("n"))


def telemetry_downsample(spark: SparkSession, folder: str) -> DataFrame:
    thin = downsample_readings(extract_readings(telemetry_lines(spark, folder).select("value")), 100, F.to_date("ts"))
    return thin.select("gpu", F.unix_micros("ts").alias("ts_micros"), "util")


def telemetry_devices(spark: SparkSession, folder: str) -> DataFrame:
    return devices(extract_readings(telemetry_lines(spark, folder).select("value")))


def series_downsample(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return downsample(events, ["user_id"], ["ts", "event_id"], 20, F.to_date("ts")).select("user_id", "event_id", "value")


def series_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type", cents(F.col("value")).alias("cents"))
    return summarise(events, ["user_id", "event_type"], "cents")


def nearest_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Times are cut to ten minutes, so that equal instants abound."""
    events = table(spark, folder, "events").select(
        (F.col("user_id") % SHARED_KEYS).alias("user_id"), "event_type",
        (F.floor(epoch_micros(F.col("ts")) / COARSE) * COARSE).alias("us"), "event_id",
    )
    left = events.filter(F.col("event_type") == "click").withColumnRenamed("event_id", "click_id")
    right = events.filter(F.col("event_type") == "view").withColumnRenamed("event_id", "view_id")
    by_day = F.floor(F.col("us") / DAY)
    return sync(left, right, ["user_id"], "us", "click_id", "view_id", F.lit(6 * 3600 * 1_000_000), by_day)


QUERIES = {
    f.__name__: f
    for f in (
        telemetry_extract, telemetry_rejects, telemetry_downsample, telemetry_devices, series_downsample,
        series_summary, nearest_sync,
    )
}

READINGS_SQL = """
    e AS (
        SELECT event_id, event_type, epoch_us(ts) AS ts_micros, user_id AS u, value AS v,
               CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events
    ),
    readings AS (
        SELECT event_id, u % 8 AS gpu, ts_micros, v AS util FROM e WHERE event_type = 'click'
        UNION ALL SELECT event_id, (u + 1) % 8, ts_micros, k FROM e WHERE event_type = 'click'
        UNION ALL SELECT event_id, u % 4, ts_micros, v FROM e WHERE event_type = 'view'
        UNION ALL SELECT event_id, 4, ts_micros, k FROM e WHERE event_type = 'view'
        UNION ALL SELECT event_id, 3, ts_micros, v FROM e WHERE event_type = 'error'
        UNION ALL SELECT event_id, 0, ts_micros, k FROM e WHERE event_type = 'purchase' AND k BETWEEN 0 AND 100
        UNION ALL SELECT event_id, 0, ts_micros, v FROM e WHERE event_type = 'purchase' AND v BETWEEN 0 AND 100
        UNION ALL SELECT event_id, u % 16, ts_micros, v FROM e WHERE event_type = 'signup'
    )
"""

SQL = {
    "telemetry_extract": f"WITH {READINGS_SQL} SELECT event_id, CAST(gpu AS BIGINT) AS gpu, ts_micros, util FROM readings",
    "telemetry_rejects": """
        SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS text, 'not an object' AS reason, count(*) AS n
        FROM events GROUP BY 1, 2
    """,
    "telemetry_downsample": f"""
        WITH {READINGS_SQL}, p AS (
            SELECT CAST(gpu AS BIGINT) AS gpu, ts_micros, util,
                   row_number() OVER (PARTITION BY gpu ORDER BY ts_micros, util) - 1 AS i,
                   count(*) OVER (PARTITION BY gpu) AS n FROM readings
        )
        SELECT gpu, ts_micros, util FROM p WHERE n <= 100 OR i % greatest(1, n // 100) = 0
    """,
    "telemetry_devices": f"WITH {READINGS_SQL} SELECT DISTINCT CAST(gpu AS BIGINT) AS gpu FROM readings",
    "series_downsample": """
        WITH p AS (
            SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
                   count(*) OVER (PARTITION BY user_id) AS n FROM events
        )
        SELECT user_id, event_id, value FROM p WHERE n <= 20 OR i % greatest(1, n // 20) = 0
    """,
    "series_summary": """
        WITH c AS (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
        SELECT user_id, event_type, count(*) AS n, min(cents) AS low, max(cents) AS high, avg(cents) AS mean
        FROM c GROUP BY ALL
    """,
    "nearest_sync": f"""
        WITH e AS (SELECT event_type, event_id, user_id % {SHARED_KEYS} AS user_id,
                          epoch_us(ts) // {COARSE} * {COARSE} AS us FROM events),
             c AS (SELECT user_id, us, event_id AS click_id FROM e WHERE event_type = 'click'),
             v AS (SELECT user_id, us, event_id AS view_id FROM e WHERE event_type = 'view'),
             near AS (
                SELECT c.user_id, c.us, c.click_id, v.view_id, abs(c.us - v.us) AS gap,
                       row_number() OVER (PARTITION BY c.click_id ORDER BY abs(c.us - v.us), v.us, v.view_id) AS r
                FROM c LEFT JOIN v ON c.user_id = v.user_id
             )
        SELECT user_id, us, click_id,
               CASE WHEN gap <= 21600000000 THEN view_id END AS matched_view_id,
               CASE WHEN gap <= 21600000000 THEN gap END AS gap
        FROM near WHERE r = 1
    """,
}
