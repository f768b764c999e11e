"""Reproducible sampling: the order is a hash of seed and key, so partitioning does not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.ordered import first_per_group

# Sample sizes.
NUM_FILES = 16
POINTS_PER_GROUP = 100
PATCHES = {"train": 4, "val": 2}

# Hex digits of the hash that are counted first: 65,536 ranges at most.
PREFIX = 4


def seeded_order(seed: int | str, *keys: Column) -> Column:
    """Hash of seed and key, equal in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_number(seed: int | str, *keys: Column) -> Column:
    """Number below 2^60 from the first 15 hex digits of the hash."""
    return F.conv(F.substring(seeded_order(seed, *keys), 1, 15), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, n: int, seed: int | str, *keys: str) -> DataFrame:
    """``n`` rows without replacement; the keys must tell rows apart.

    One plan for every ``n``: rows are counted per prefix of their hash, which is combined map-side. A
    running sum over the prefixes tells those that hold the first ``n``; only their rows are shuffled, and
    numbered within their prefix. The list of prefixes is bounded by their digits.
    """
    hashed = df.withColumn("_order", seeded_order(seed, *[F.col(k) for k in keys]))
    hashed = hashed.withColumn("_prefix", F.substring("_order", 1, PREFIX))
    counts = hashed.groupBy("_prefix").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_prefix", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    near = hashed.join(F.broadcast(starts.filter(F.col("_start") < n)), "_prefix")
    inside = F.row_number().over(W.partitionBy("_prefix").orderBy("_order", *keys))
    return near.withColumn("_place", F.col("_start") + inside).filter(F.col("_place") <= n).select(df.columns)


def sample_per_group(df: DataFrame, group: list[str], n: int, seed: int | str, *keys: str) -> DataFrame:
    """Up to ``n`` rows per group, cut down before and after the shuffle."""
    ordered = df.withColumn("_order", seeded_order(seed, *[F.col(k) for k in keys]))
    order = [F.col("_order"), *[F.col(k) for k in keys]]
    return first_per_group(ordered, group, order, n, F.col("_order")).drop("_order")


def patches_per_split(
    df: DataFrame, split: str, group: list[str], seed: int | str, *keys: str, sizes: dict[str, int] = PATCHES
) -> DataFrame:
    """Per group as many rows as its split asks for, in one pass; rows of other splits are left out."""
    asked = F.lit(0)
    for name, n in sizes.items():
        asked = F.when(F.col(split) == name, n).otherwise(asked)
    most = sample_per_group(df.filter(asked > 0), [split, *group], max(sizes.values()), seed, *keys)
    w = W.partitionBy(split, *group).orderBy("_order", *keys)
    placed = most.withColumn("_order", seeded_order(seed, *[F.col(k) for k in keys])).withColumn("_place", F.row_number().over(w))
    return placed.filter(F.col("_place") <= asked).drop("_order", "_place")


def split_by_value(value: Column, train: list, names: tuple[str, str] = ("train", "test")) -> Column:
    """Listed values train, all others test."""
    return F.when(value.isin(train), names[0]).otherwise(names[1])


def draw_size(seed: int | str, *draw: Column) -> Column:
    """1 to 3, uniformly."""
    return (1 + hash_number(f"{seed}|size", *draw) % 3).cast("int")
