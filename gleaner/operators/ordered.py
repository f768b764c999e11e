"""Running values along ordered groups of any size.

A window hands a whole group to one task, which is no plan once one series holds a third of the table.
So the caller names a ``bucket``: a column that never falls along the order, such as the day of a time or
a prefix of a hash. Rows are shuffled once, by group and bucket; each bucket is scanned on its own and
corrected by a carry from the totals of the buckets before (or after) it, of which there is one row per
group and bucket. There is one plan whatever the sizes, and nothing is counted beforehand.

Without a bucket a group is one window. That is for groups that are small by their definition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUT = "_cut"

# Places of a group that one task sees in ``rolling``.
RUN = 100_000


@dataclass(frozen=True)
class Measure:
    """One running value: ``fn`` of ``value`` over the rows before, after or all over the group."""

    fn: str
    value: Column
    side: str = "before"
    inclusive: bool = True

    def over(self, group: W, order: Sequence[str | Column]) -> Column:
        agg = getattr(F, self.fn)(self.value)
        if self.side == "all":
            return agg.over(group)
        # An unbounded-following frame is recomputed per row; a reversed order is not.
        columns = [F.col(c) if isinstance(c, str) else c for c in order]
        ordered = group.orderBy(*(c.asc() if self.side == "before" else c.desc() for c in columns))
        return agg.over(ordered.rowsBetween(W.unboundedPreceding, 0 if self.inclusive else -1))

    def merged(self, here: Column, elsewhere: Column) -> Column:
        if self.side == "all":
            return F.coalesce(elsewhere, here)
        if self.fn == "min":
            return F.least(here, elsewhere)
        if self.fn == "max":
            return F.greatest(here, elsewhere)
        return F.when(here.isNull(), elsewhere).when(elsewhere.isNull(), here).otherwise(here + elsewhere)


def position(inclusive: bool = True) -> Measure:
    """1-based place of a row in its group."""
    return Measure("count", F.lit(1), "before", inclusive)


def group_rows() -> Measure:
    return Measure("count", F.lit(1), "all")


def scan_groups(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Measure], bucket: Column | None = None
) -> DataFrame:
    """Add the measures to every row. ``order`` (ascending, nulls first) must tell rows apart.

    ``bucket`` must be a function of the row that never falls along ``order`` within a group.
    """
    if bucket is None:
        group = W.partitionBy(*(keys or [F.lit(0)]))
        return df.withColumns({n: m.over(group, order) for n, m in measures.items()})
    fields = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    # A struct is never null, so it joins null keys as well.
    rows = df.withColumn(CUT, F.struct(*fields, bucket.alias("bucket"))).repartition(CUT)
    local = W.partitionBy(CUT)
    scanned = rows.withColumns({n: m.over(local, order) for n, m in measures.items()})
    totals = rows.groupBy(CUT).agg(*[getattr(F, m.fn)(m.value).alias(n) for n, m in measures.items()])
    group = W.partitionBy(*([F.col(f"{CUT}.k{i}") for i in range(len(keys))] or [F.lit(0)]))
    carry = totals.select(
        CUT,
        *[
            Measure("sum" if m.fn == "count" else m.fn, F.col(n), m.side, False)
            .over(group, [F.col(f"{CUT}.bucket")])
            .alias(f"_carry_{n}")
            for n, m in measures.items()
        ],
    )
    return scanned.join(carry, CUT).select(
        *[F.col(c) for c in df.columns],
        *[m.merged(F.col(n), F.col(f"_carry_{n}")).alias(n) for n, m in measures.items()],
    )


def rolling(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    half: int,
    measures: dict[str, Column],
    bucket: Column | None = None,
    run: int = RUN,
) -> DataFrame:
    """Aggregates over the ``half`` rows on both sides of each row (fewer at the ends).

    With a ``bucket`` groups are cut into runs of ``run`` places; a run also receives the ``half`` rows
    next to it, so its frames are whole and nothing else is copied.
    """
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
        return df.withColumns({n: c.over(w) for n, c in measures.items()})
    w = W.partitionBy(*keys, "_run").orderBy("_place").rowsBetween(-half, half)
    copies = in_runs(df, keys, order, half, bucket, run)
    return copies.withColumns({n: c.over(w) for n, c in measures.items()}).filter("_own").drop("_run", "_place", "_own")


def in_runs(
    df: DataFrame, keys: list[str], order: list[str], half: int, bucket: Column | None = None, run: int | None = None
) -> DataFrame:
    """Rows with their ``_place`` in the group and the ``_run`` of places they stand in; the ``half`` rows next to a run
    are in it too, with ``_own`` false."""
    run = max(run or RUN, 2 * half + 1)
    placed = scan_groups(df, keys, order, {"_place": position()}, bucket)

    def run_of(place: Column) -> Column:
        return F.floor((place - 1) / run)

    first = run_of(F.greatest(F.col("_place") - half, F.lit(1)))
    copies = placed.withColumn("_run", F.explode(F.sequence(first, run_of(F.col("_place") + half))))
    return copies.withColumn("_own", F.col("_run") == run_of(F.col("_place")))


def attach(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of one row per key; null keys meet.

    A key may hold any share of ``df``: the other side has one row for it, so Spark can split the rows of
    a skewed key over many tasks.
    """
    side = per_key.select(
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias(CUT),
        *[c for c in per_key.columns if c not in keys],
    )
    own = df.withColumn(CUT, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    return own.join(side, CUT).drop(CUT)


def first_per_group(
    df: DataFrame, group: list[str], order: Sequence[Column], n: int, salt: Column, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group.

    Cut twice: within group and salt, then within the group. However many tasks read the input, the task
    of a hot group sees ``salts * n`` rows at most. ``salt`` must tell rows of a group apart well.
    """
    part = F.pmod(F.xxhash64(salt), F.lit(salts))
    cut = df.withColumn("_salt", part)
    inner = W.partitionBy(*group, "_salt").orderBy(*order)
    outer = W.partitionBy(*group).orderBy(*order)
    few = cut.withColumn("_place", F.row_number().over(inner)).filter(F.col("_place") <= n).drop("_salt")
    return few.withColumn("_place", F.row_number().over(outer)).filter(F.col("_place") <= n).drop("_place")
