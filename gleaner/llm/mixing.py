"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a seeded order, form blocks. Block i of a source of weight w may be placed
from slot floor(i / w) on (its release time) and must be placed before slot ceil((i + 1) / w) (its
deadline). Of the released blocks the one of earliest deadline takes the next slot. The number of blocks
that a source has got then differs from its weight times the slots by less than one, at any time.

Weights are taken as they are, as ratios of whole numbers. The slot of a block follows from all slots
before, so one task on a worker lays them out, with a block of each source in memory, and gives on a row per
block, which meets its documents in a shuffled join. Only where a ``period`` is asked for, weights are rounded to
whole shares of it, one period is laid out on the driver, and the schedule repeats. When
a source is used up, the others go on with their weights in proportion; there are at most as many such
phases as sources. Every document is placed.

Numbers within a source come from counts of hash ranges, as many as the square root of its documents, so
that no task sorts a hot source as a whole: both the ranges and what is in one grow with the square root.

Defined cases: null sources are one source of their own; sources without a weight have the weight of their
share; repeated rows get places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, documents, map_batches

BLOCK = 16
PERIOD = None
SEED = 17
PLAN = "_source string, _first long, _last long, _base long, _share long, _whole long, _places array<int>"


def shares(weights: list[float], period: int | None = PERIOD) -> list[int]:
    """Whole numbers in the ratio of the weights; with a period, its shares, at least 1 each, by largest remainder."""
    if period is None:
        exact = [Fraction(w) for w in weights]
        scale = lcm(*(x.denominator for x in exact))
        whole = [int(x * scale) for x in exact]
        return [x // gcd(*whole) for x in whole]
    period = max(period, len(weights))
    free = period - len(weights)
    exact = [w / sum(weights) * free for w in weights]
    out = [1 + int(x) for x in exact]
    rest = sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in rest[: period - sum(out)]:
        out[i] += 1
    return out


def one_period(own: list[int]) -> list[list[int]]:
    """Slots of the blocks of every source, earliest deadline first."""
    period = sum(own)
    waiting = [(0, -(-period // a), k, 0) for k, a in enumerate(own)]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in own]
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, i))
        _, k, i = heapq.heappop(ready)
        slots[k].append(slot)
        if i + 1 < own[k]:
            heapq.heappush(waiting, ((i + 1) * period // own[k], -(-(i + 2) * period // own[k]), k, i + 1))
    return slots


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """Source and block of every slot, earliest deadline first, by the weights themselves."""
    used = [0] * len(blocks)
    while active := [k for k in range(len(blocks)) if used[k] < blocks[k]]:
        own = dict(zip(active, shares([weights[k] for k in active]), strict=True))
        whole, slot, begin = sum(own.values()), 0, list(used)
        waiting = [(0, -(-whole // own[k]), k) for k in active]  # release, deadline, source
        ready: list[tuple[int, int]] = []
        heapq.heapify(waiting)
        while True:
            while waiting and waiting[0][0] <= slot:
                _, deadline, k = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, k))
            _, k = heapq.heappop(ready)
            yield k, used[k]
            used[k] += 1
            slot += 1
            if used[k] == blocks[k]:
                break
            i = used[k] - begin[k]
            heapq.heappush(waiting, (i * whole // own[k], -(-(i + 1) * whole // own[k]), k))


def scheduled(spark: SparkSession, names: list[str | None], blocks: list[int], weights: list[float]) -> DataFrame:
    """``_source``, ``_at`` (the block) and its ``slot``."""

    def run(batches: Batches) -> Batches:
        for _ in batches:
            order, base = schedule(blocks, weights), 0
            while some := list(islice(order, 50_000)):
                columns = [pa.array([x[i] for x in some], pa.int64()) for i in (0, 1)]
                slots = pa.array(range(base, base + len(some)), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, slots], ["_k", "_at", "slot"])
                base += len(some)

    laid = map_batches(spark.range(1, numPartitions=1), run, "_k long, _at long, slot long")
    known = spark.createDataFrame(list(enumerate(names)), "_of long, _source string")
    return laid.join(F.broadcast(known), F.col("_k") == F.col("_of")).select("_source", "_at", "slot")


def phases(blocks: list[int], weights: list[float], period: int) -> list[tuple]:
    """For each source in each phase: source, first block, the one after the last, first slot, share, period, slots."""
    used, base, out = [0] * len(blocks), 0, []
    while any(u < b for u, b in zip(used, blocks, strict=True)):
        active = [k for k in range(len(blocks)) if used[k] < blocks[k]]
        own = shares([weights[k] for k in active], period)
        slots = one_period(own)
        whole = sum(own)

        def slot_of(j: int, i: int) -> int:
            return i // own[j] * whole + slots[j][i % own[j]]

        end = min(slot_of(j, blocks[k] - used[k] - 1) for j, k in enumerate(active)) + 1
        for j, k in enumerate(active):
            taken = end // whole * own[j] + sum(s < end % whole for s in slots[j])
            out.append((k, used[k], used[k] + taken, base, own[j], whole, slots[j]))
            used[k] += taken
        base += end
    return out


def shuffled(key: Column) -> Column:
    return F.xxhash64(F.lit(SEED), key)


def numbered(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_number``, the place from 0 within the source; ``order[0]`` must be a spread hash."""
    sized = rows.groupBy(source).agg(F.ceil(F.sqrt(F.count("*"))).alias("_ranges")).withColumnRenamed(source, "_of")
    upper = F.shiftrightunsigned(F.col(order[0]).bitwiseXOR(F.lit(-(2**63))), 33)  # 31 bits, in the hash's order
    cut = rows.join(sized, F.col(source).eqNullSafe(F.col("_of"))).withColumn(
        "_range", F.shiftright(upper * F.col("_ranges"), 31)
    )
    counts = cut.groupBy(source, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(source).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col(source).alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy(source, "_range").orderBy(*order)
    placed = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    met = F.col(source).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    return placed.join(starts, met).withColumn("_number", F.col("_start") + F.col("_inside"))


def flattened(counts: dict[str | None, int]) -> dict[str | None, float]:
    """The target of the registered query and the pipeline: the square roots of the sizes."""
    return {s: n**0.5 for s, n in counts.items()}


def mixed(
    docs: DataFrame,
    target: Callable[[dict], dict] | dict[str | None, float] = flattened,
    block: int = BLOCK,
    period: int | None = PERIOD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``source``, ``block``, ``slot`` and ``place`` within the block; ``keep``: more columns.

    ``target`` holds a weight per source, or makes them from the numbers of documents. There is one row
    per source on the driver.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        *keep,
        shuffled(F.col("doc_id")).alias("_hash"),
    )
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator()}
    names = sorted(sizes, key=lambda s: (s is not None, s))
    given = target(sizes) if callable(target) else target
    known = sum(sizes[s] for s in names if s in given) or 1
    per_doc = sum(given[s] for s in names if s in given) / known or 1
    weights = [max(given.get(s, per_doc * sizes[s]), 1e-9) for s in names]
    blocks = [-(-sizes[s] // block) for s in names]
    ordered = numbered(rows, "source", ["_hash", "doc_id", *keep]).withColumns(
        {"_block": F.floor(F.col("_number") / block), "place": (F.col("_number") % block).cast("long")}
    )
    if period is None:
        slots = scheduled(docs.sparkSession, names, blocks, weights).hint("merge")
        met = ordered.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_at")))
        return met.select("doc_id", "source", F.col("_block").alias("block"), "slot", "place", *keep)

    plan = [(names[k], *rest) for k, *rest in phases(blocks, weights, period)]
    met = ordered.join(
        docs.sparkSession.createDataFrame(plan, PLAN),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") >= F.col("_first")) & (F.col("_block") < F.col("_last")),
    )
    turn = F.col("_block") - F.col("_first")
    inside = F.element_at("_places", (turn % F.col("_share") + 1).cast("int"))
    slot = F.col("_base") + F.floor(turn / F.col("_share")) * F.col("_whole") + inside
    return met.select("doc_id", "source", F.col("_block").alias("block"), slot.alias("slot"), "place", *keep)


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """The documents, all of them, in the order of the schedule; the order of rows is that of the written files.

    Places are found from ids and sources alone and then joined, so whole rows are shuffled twice: to meet
    their place and to be sorted. Equal rows stand together at the first of their places.
    """
    rows = docs.select("doc_id", "source", F.struct("*").alias("row"))
    keyed = rows.withColumn("key", F.struct("doc_id", "source", F.xxhash64("row").alias("hash")))
    places = mixed(keyed.drop("row"), keep=("key",)).groupBy("key").agg(F.min(F.struct("slot", "place")).alias("at"))
    return keyed.select("key", "row").join(places, "key").orderBy("at").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


QUERIES = {"op9_pfair_mixing": query}
SQL: dict[str, str] = {}
