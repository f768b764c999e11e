"""Events and orders as the log of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.curves import assign_batches, best_so_far as mark_best, epoch_metrics as metrics_of
from gleaner.operators.curves import low_spread, running_trigger as trigger
from gleaner.operators import sliding
from gleaner.operators.raster import rolling_lower_median as rolling_median
from gleaner.operators.sampling import patches_per_split, seeded_order, split_by_value
from gleaner.plans.registered import table
from gleaner.plans.registered.telemetry import cents, epoch_micros

DAY = 86_400_000_000
# Numbers in a bucket of ids.
RUN = 100_000
TRAIN_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events as batches: the epoch is the day, the loss the value."""
    return table(spark, folder, "events").select(
        F.floor(epoch_micros(F.col("ts")) / DAY).alias("epoch"),
        "event_id",
        "user_id",
        cents(F.col("value")).alias("loss"),
        F.get_json_object("props", "$.k").cast("int").alias("std"),
        (F.col("value") < 5).alias("collapsed"),
    )


def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return mark_best(events, ["user_id"], ["ts", "event_id"], "value", F.to_date("ts")).select(
        "user_id", "event_id", "previous_best", "is_best"
    )


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics_of(batches(spark, folder), ["epoch"], "loss", "std", "collapsed")


def epoch_alerts(spark: SparkSession, folder: str) -> DataFrame:
    metrics = metrics_of(batches(spark, folder), ["epoch", "user_id"], "loss", "std", "collapsed")
    return low_spread(metrics, limit=10).select("epoch", "user_id", "mean_std")


def running_trigger(spark: SparkSession, folder: str) -> DataFrame:
    return trigger(
        batches(spark, folder), ["epoch"], ["event_id"], F.col("collapsed"), bucket=F.floor(F.col("event_id") / RUN)
    ).select(
        "epoch", "event_id", "collapses"
    )


def batch_assign(spark: SparkSession, folder: str) -> DataFrame:
    split = split_by_value(F.col("o_orderpriority"), TRAIN_PRIORITIES, ("train", "val"))
    shuffled = F.when(split == "train", seeded_order(9, F.col("o_orderkey"))).otherwise("")
    orders = table(spark, folder, "orders").select("o_orderkey", split.alias("split"), shuffled.alias("mix"))
    # Prefix of the hash where rows are shuffled, else runs of keys.
    runs = F.when(F.col("mix") == "", F.floor(F.col("o_orderkey") / RUN)).otherwise(0)
    by_mix = F.struct(F.substring("mix", 1, 3), runs)
    return assign_batches(
        orders, ["split"], ["mix", "o_orderkey"], 32, F.col("split") == "train", by_mix
    ).select(
        "o_orderkey", "split", "batch"
    )


def split_by_key(spark: SparkSession, folder: str) -> DataFrame:
    split = split_by_value(F.col("c_nationkey"), list(range(20)))
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", split.alias("split"))


def split_patches(spark: SparkSession, folder: str) -> DataFrame:
    split = split_by_value(F.col("c_nationkey"), list(range(20)), ("train", "val"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", split.alias("split"))
    return patches_per_split(customers, "split", ["c_nationkey"], 13, "c_custkey")


def rolling_lower_median(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return rolling_median(events, ["user_id"], ["ts", "event_id"], "value", 2, bucket=F.to_date("ts")).select(
        "user_id", "event_id", "rolling_median"
    )


def wide_rolling_median(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of 10,001 rows over all events."""
    events = table(spark, folder, "events").select("ts", "event_id", "value")
    return sliding.rolling_median(events, [], ["ts", "event_id"], "value", 5_000, bucket=F.to_date("ts")).select(
        "event_id", "rolling_median"
    )


QUERIES = {
    f.__name__: f
    for f in (
        best_so_far, epoch_metrics, epoch_alerts, running_trigger, batch_assign, split_by_key, split_patches,
        rolling_lower_median, wide_rolling_median,
    )
}

BATCHES_SQL = f"""
    b AS (
        SELECT epoch_us(ts) // {DAY} AS epoch, event_id, user_id, CAST(round(value * 100) AS BIGINT) AS loss,
               CAST(json_extract(props, '$.k') AS INT) AS std, value < 5 AS collapsed FROM events
    )
"""

SQL = {
    "best_so_far": """
        WITH p AS (
            SELECT user_id, event_id, value, min(value) OVER (
                PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
            ) AS previous_best FROM events
        )
        SELECT user_id, event_id, previous_best, previous_best IS NULL OR value < previous_best AS is_best FROM p
    """,
    "epoch_metrics": f"""
        WITH {BATCHES_SQL}
        SELECT epoch, count(*) AS n_batches, avg(loss) AS mean_loss, avg(std) AS mean_std,
               CAST(count(*) FILTER (WHERE collapsed) AS BIGINT) AS collapses FROM b GROUP BY epoch
    """,
    "epoch_alerts": f"""
        WITH {BATCHES_SQL}
        SELECT epoch, user_id, avg(std) AS mean_std FROM b GROUP BY epoch, user_id HAVING avg(std) < 10
    """,
    "running_trigger": f"""
        WITH {BATCHES_SQL}, s AS (
            SELECT epoch, event_id, collapsed, CAST(sum(CAST(collapsed AS INT)) OVER (
                PARTITION BY epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS collapses FROM b
        )
        SELECT epoch, event_id, collapses FROM s WHERE collapsed AND collapses > 5
    """,
    "batch_assign": """
        WITH s AS (
            SELECT o_orderkey,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'train' ELSE 'val' END AS split
            FROM orders
        ), p AS (
            SELECT o_orderkey, split, (row_number() OVER (
                       PARTITION BY split
                       ORDER BY CASE WHEN split = 'train' THEN md5('9|' || o_orderkey) ELSE '' END, o_orderkey
                   ) - 1) // 32 AS batch, count(*) OVER (PARTITION BY split) AS n FROM s
        )
        SELECT o_orderkey, split, batch FROM p WHERE split = 'val' OR (batch + 1) * 32 <= n
    """,
    "split_by_key": """
        SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 20 THEN 'train' ELSE 'test' END AS split FROM customer
    """,
    "split_patches": """
        SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 20 THEN 'train' ELSE 'val' END AS split FROM customer
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('13|' || c_custkey), c_custkey)
                <= CASE WHEN c_nationkey < 20 THEN 4 ELSE 2 END
    """,
    "wide_rolling_median": """
        SELECT event_id, quantile_disc(value, 0.5) OVER (
            ORDER BY ts, event_id ROWS BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) AS rolling_median FROM events
    """,
    "rolling_lower_median": """
        WITH w AS (
            SELECT user_id, event_id, list(value) OVER (
                PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vs FROM events
        )
        SELECT user_id, event_id, list_sort(vs)[(len(vs) - 1) // 2 + 1] AS rolling_median FROM w
    """,
}
