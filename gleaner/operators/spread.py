"""How far the points of a group lie apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import distance, first_coordinates, total
from gleaner.operators.sampling import POINTS_PER_GROUP, sample_per_group

# Fixed value: the distance floor.
MIN_DISTANCE = 0.01


def spread(points: DataFrame, group: list[str], coord: str = "coord", dims: int = 3) -> DataFrame:
    """Unbiased deviation per coordinate, averaged over the coordinates."""
    deviations = [F.stddev_samp(F.get(F.col(coord), F.lit(i)).cast("double")) for i in range(dims)]
    mean = sum(deviations[1:], deviations[0]) / dims
    return points.groupBy(*group).agg(F.count(F.lit(1)).alias("n_points"), mean.alias("std"))


def nearest_mean(points: Column) -> Column:
    """Mean distance of each point to its nearest other one; NULL for a single point.

    ``points`` is an array of at most a sample's size, so the pairs live and die inside one row.
    """

    def nearest(p: Column, i: Column) -> Column:
        others = F.filter(
            F.transform(points, lambda q, j: F.when(i != j, distance(p, q))), lambda d: d.isNotNull()
        )
        return F.array_min(others)

    distances = F.transform(points, nearest)
    return F.when(F.size(points) > 1, F.transform(
        F.array(distances), lambda ds: total(ds) / F.size(ds)
    )[0])


def sampled_distance(
    points: DataFrame, group: list[str], key: str, coord: str = "coord", dims: int = 3,
    seed: int | str = 0, sample: int = POINTS_PER_GROUP,
) -> DataFrame:
    """Nearest-neighbour distance over up to ``sample`` points per group."""
    narrow = points.select(*group, key, first_coordinates(F.col(coord), dims).alias("_c"))
    picked = sample_per_group(narrow, group, sample, seed, key)
    return (
        picked.groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(key, "_c"))).alias("_points"))
        .select(*group, nearest_mean(F.col("_points._c")).alias("min_dist"))
    )


def is_collapsed(std: Column, min_dist: Column, min_std: float) -> Column:
    """Too close together, or undefined."""
    undefined = std.isNull() | F.isnan(std) | min_dist.isNull() | F.isnan(min_dist)
    return F.when(undefined, F.lit(True)).otherwise((std < min_std) | (min_dist < MIN_DISTANCE))


def check_collapse(
    points: DataFrame, group: list[str], key: str, min_std: float, coord: str = "coord", dims: int = 3,
    seed: int | str = 0, sample: int = POINTS_PER_GROUP, batch: list[str] | None = None,
) -> DataFrame:
    """Spread, distance and verdict per group, or averaged over the groups of each ``batch``."""
    stats = spread(points, group, coord, dims).join(
        sampled_distance(points, group, key, coord, dims, seed, sample), group
    )
    if batch is not None:
        # One undefined group makes its whole batch undefined.
        stats = stats.groupBy(*batch).agg(
            F.sum("n_points").alias("n_points"),
            *[
                F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c)
                for c in ("std", "min_dist")
            ],
        )
    return stats.withColumn("is_collapsed", is_collapsed(F.col("std"), F.col("min_dist"), min_std))
