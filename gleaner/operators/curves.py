"""Curves of a run: batches, epochs, best values and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import Measure, group_rows, position, scan_groups

# Alert limits.
LOW_SPREAD = 0.15
COLLAPSE_LIMIT = 5


def epoch_metrics(batches: DataFrame, epoch: list[str], loss: str, std: str, collapsed: str) -> DataFrame:
    """Unweighted means over the batches and the number of collapsed ones."""
    return batches.groupBy(*epoch).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg(loss).alias("mean_loss"),
        F.avg(std).alias("mean_std"),
        F.sum(F.col(collapsed).cast("bigint")).alias("collapses"),
    )


def low_spread(metrics: DataFrame, std: str = "mean_std", limit: float = LOW_SPREAD) -> DataFrame:
    return metrics.filter(F.col(std) < limit)


def best_so_far(
    df: DataFrame, keys: list[str], order: list[str], loss: str, bucket: Column | None = None
) -> DataFrame:
    """Mark every row whose loss is below all earlier ones; NULL and NaN never are."""
    usable = F.when(~F.isnan(loss), F.col(loss))
    scanned = scan_groups(
        df, keys, order, {"previous_best": Measure("min", usable, inclusive=False)}, bucket
    )
    best = usable.isNotNull() & (usable < F.coalesce("previous_best", F.lit(float("inf"))))
    return scanned.withColumn("is_best", best)


def running_trigger(
    df: DataFrame, epoch: list[str], order: list[str], collapsed: Column, limit: int = COLLAPSE_LIMIT,
    bucket: Column | None = None,
) -> DataFrame:
    """Collapsed rows from the one after the ``limit``-th on, with their running count."""
    flags = df.withColumn("_flag", F.coalesce(collapsed, F.lit(False)).cast("bigint"))
    scanned = scan_groups(flags, epoch, order, {"collapses": Measure("sum", F.col("_flag"))}, bucket)
    return scanned.filter((F.col("_flag") == 1) & (F.col("collapses") > limit)).drop("_flag")


def assign_batches(
    df: DataFrame, split: list[str], order: list[str], size: int, drop_last: Column,
    bucket: Column | None = None,
) -> DataFrame:
    """Number the rows of each split and cut them into batches of ``size``.

    Where ``drop_last`` holds, an incomplete last batch goes.
    """
    placed = scan_groups(
        df, split, order, {"_place": position(), "_n": group_rows()}, bucket
    )
    batch = F.floor((F.col("_place") - 1) / size)
    complete = (F.col("batch") + 1) * size <= F.col("_n")
    return placed.withColumn("batch", batch).filter(complete | ~drop_last).drop("_place", "_n")
