"""Lookups, nearest readings and order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import softmax
from gleaner.operators.ordered import Measure, scan_groups

# Fixed value: entries kept per vector.
TOP_ENTRIES = 5


def top_entries(
    df: DataFrame, vector: Column, others: list[str], k: int = TOP_ENTRIES
) -> DataFrame:
    """The ``k`` most probable positions of each vector, ranked from 1; ties by position.

    Sorted inside the row: there is nothing to shuffle.
    """
    ranked = F.slice(
        F.sort_array(F.transform(vector, lambda p, i: F.struct((-p).alias("minus"), i.alias("pos")))), 1, k
    )
    return df.select(*others, F.posexplode(ranked).alias("_i", "e")).select(
        *others, (F.col("_i") + 1).alias("rank"), F.col("e.pos").alias("cat_id"),
        (-F.col("e.minus")).alias("probability"),
    )


def top_classes(df: DataFrame, logits: str, others: list[str], k: int = TOP_ENTRIES) -> DataFrame:
    return top_entries(df, softmax(F.col(logits)), others, k)


def name_classes(entries: DataFrame, classes: DataFrame, cat_id: str = "cat_id") -> DataFrame:
    """Join class names; an entry without a name stays, with NULL. An id that is named twice is an error."""
    others = [c for c in classes.columns if c != cat_id]
    single = classes.groupBy(cat_id).agg(
        F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("class id named twice: "), F.col(cat_id))))
        .otherwise(F.first(F.struct(*others)))
        .alias("_named")
    )
    return entries.join(single, cat_id, "left").select(*entries.columns, *[F.col(f"_named.{c}").alias(c) for c in others])


def read_before_write(
    reads: DataFrame, writes: DataFrame, agent: list[str], key: str = "key", pos: str = "pos",
    bucket: Column | None = None,
) -> DataFrame:
    """Reads of a key that nothing of the same agent has written at an earlier position.

    One running maximum instead of a join of reads with writes, which would pair them all. The
    writes are cut to the first one per key before they move.
    """
    first = writes.groupBy(*agent, key).agg(F.min(pos).alias(pos))
    both = (
        reads.select(*agent, key, pos)
        .withColumn("_write", F.lit(0))
        .unionByName(first.withColumn("_write", F.lit(1)))
    )
    # At one position reads come first: a module does not serve its own reads.
    scanned = scan_groups(
        both, [*agent, key], [pos, "_write"], {"_written": Measure("max", F.col("_write"))}, bucket
    )
    return scanned.filter((F.col("_write") == 0) & (F.col("_written") == 0)).drop("_write", "_written")


def nearest_sync(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str, left_id: str, right_id: str,
    tolerance: Column, bucket: Column | None = None,
) -> DataFrame:
    """For every left row the right row nearest in time within ``tolerance``; ties go to the earlier one.

    Both streams are merged and scanned once in each direction, so no row meets more than two others.
    ``ts`` is a number. Of several right rows at one instant the lowest id counts.
    """
    merged = left.select(*keys, ts, F.col(left_id).alias("_id"), F.lit(1).alias("_side")).unionByName(
        right.groupBy(*keys, ts).agg(F.min(right_id).alias("_id")).withColumn("_side", F.lit(0))
    )
    # One right row per instant is enough, the one of the lowest id; the latest of them is then unique.
    candidate = F.when(F.col("_side") == 0, F.struct(F.col(ts).alias("ts"), F.col("_id").alias("id")))
    scanned = scan_groups(
        merged,
        keys,
        [ts, "_side", "_id"],
        {"_before": Measure("max", candidate), "_after": Measure("min", candidate, "after")},
        bucket,
    )
    back = F.col(ts) - F.col("_before.ts")
    ahead = F.col("_after.ts") - F.col(ts)
    nearest = (
        F.when(F.col("_before").isNull(), F.col("_after"))
        .when(F.col("_after").isNull() | (back <= ahead), F.col("_before"))
        .otherwise(F.col("_after"))
    )
    matched = scanned.filter(F.col("_side") == 1).withColumn("_near", nearest)
    gap = F.abs(F.col(ts) - F.col("_near.ts"))
    within = gap <= tolerance
    return matched.select(
        *keys, ts, F.col("_id").alias(left_id),
        F.when(within, F.col("_near.id")).alias(f"matched_{right_id}"),
        F.when(within, gap).alias("gap"),
    )
