"""Medians of wide frames and large kernels, in memory linear in the rows.

A run of a series, or a tile of a grid, is one Arrow table. Its values are ranked once, and ranks are dealt to about
sqrt(n) bins. What slides along is a histogram of the bins: per step one value enters and one leaves, or one column
of the kernel. The bin that holds the middle is found in the histogram, and the middle itself among the few values of
that bin, by their places in rank order. So no window is ever gathered or sorted, and a step costs the same
for a frame of five rows and of ten thousand.

Nulls are left out of a window, one that has none but nulls has the median NULL; a window that holds NaN has the
median NaN. Values may be of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import in_runs
from gleaner.operators.raster import TILE, tiled_cells
from gleaner.session import ship_package

# Outputs whose histograms are held at once.
STEPS = 256


class Ranks:
    """Places of an array by rank, and the bin of every place; -1 for nulls and NaN, which have no rank."""

    def __init__(self, values: pa.Array):
        self.nan = np.zeros(len(values), bool)
        if pa.types.is_floating(values.type):
            self.nan = pc.fill_null(pc.is_nan(values), False).to_numpy(zero_copy_only=False)
        counts = values.is_valid().to_numpy(zero_copy_only=False) & ~self.nan
        order = pc.array_sort_indices(values).to_numpy()
        order = order[counts[order]].astype(np.int64)
        self.n = len(order)
        self.width = max(isqrt(self.n), 1)
        self.bins = -(-self.n // self.width) or 1
        self.bin = np.full(len(values), -1, np.int64)
        self.bin[order] = np.arange(self.n) // self.width
        self.places = np.full(self.bins * self.width, -1, np.int64)
        self.places[: self.n] = order
        self.places = self.places.reshape(self.bins, self.width)

    def middle(self, histogram: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Place of the lower median for every row of bin counts, -1 of none.

        ``inside`` tells which of some places, a row for each row of counts, lie in the window.
        """
        upto = histogram.cumsum(axis=1)
        wanted = (upto[:, -1] - 1) // 2
        bin_ = np.minimum((upto <= wanted[:, None]).sum(axis=1), self.bins - 1)
        before = np.where(bin_ > 0, upto[np.arange(len(upto)), bin_ - 1], 0)
        near = self.places[bin_]
        held = ((near >= 0) & inside(near)).cumsum(axis=1)
        at = np.minimum((held <= (wanted - before)[:, None]).sum(axis=1), self.width - 1)
        return np.where(upto[:, -1] > 0, near[np.arange(len(near)), at], -1)


def rolling_places(ranks: Ranks, half: int) -> np.ndarray:
    """Place of the lower median of the ``half`` places on both sides of each place."""
    n = len(ranks.bin)
    out = np.zeros(n, np.int64)
    for first in range(0, n, STEPS):
        at = np.arange(first, min(first + STEPS, n))
        own = ranks.bin[max(first - half, 0) : first + half + 1]
        change = np.zeros((len(at), ranks.bins), np.int32)
        change[0] = np.bincount(own[own >= 0], minlength=ranks.bins)
        for entering, sign in ((at[1:] + half, 1), (at[1:] - half - 1, -1)):
            rows = np.flatnonzero((entering >= 0) & (entering < n))
            bins = ranks.bin[entering[rows]]
            change[rows[bins >= 0] + 1, bins[bins >= 0]] += sign
        out[at] = ranks.middle(change.cumsum(axis=0), lambda p, at=at: np.abs(p - at[:, None]) <= half)
    return out


def kernel_places(ranks: Ranks, shape: tuple[int, int], kernel: tuple[int, int], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Place of the lower median of the kernels that begin at ``rows`` x ``cols`` of a grid laid out by rows."""
    bins = ranks.bin.reshape(shape)
    column = np.zeros((shape[1], ranks.bins), np.int32)
    all_columns = np.arange(shape[1])

    def count(row: int, sign: int) -> None:
        here = bins[row] >= 0
        column[all_columns[here], bins[row][here]] += sign

    out, low, high = [], 0, 0
    for row in rows.tolist():
        for r in range(high, row + kernel[0]):
            count(r, 1)
        for r in range(low, min(row, high)):
            count(r, -1)
        low, high = row, row + kernel[0]
        sums = np.zeros((shape[1] + 1, ranks.bins), np.int32)
        np.cumsum(column, axis=0, out=sums[1:])

        def inside(p: np.ndarray, row: int = row) -> np.ndarray:
            r, c = p // shape[1], p % shape[1]
            return (r >= row) & (r < row + kernel[0]) & (c >= cols[:, None]) & (c < cols[:, None] + kernel[1])

        out.append(ranks.middle(sums[cols + kernel[1]] - sums[cols], inside))
    return np.array(out, np.int64).reshape(len(rows), len(cols))


def taken(values: pa.Array, places: np.ndarray, has_nan: np.ndarray) -> pa.Array:
    """Values at the places, null at -1, and NaN where a window has one."""
    found = values.take(pa.array(places, mask=places < 0))
    if not has_nan.any():
        return found
    return pc.if_else(pa.array(has_nan), pa.scalar(float("nan"), found.type), found)


def rolling_median(
    df: DataFrame, series: list[str], order: list[str], value: str, half: int,
    name: str = "rolling_median", bucket: Column | None = None, run: int | None = None,
) -> DataFrame:
    """Lower median over the ``half`` rows on both sides of each row of a series, for frames of any width."""
    copies = in_runs(df, series, order, half, bucket, run)
    kept = df.columns
    schema = copies.select(*kept, F.col(value).alias(name)).schema

    def medians(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place").combine_chunks()
        values = table.column(value).combine_chunks() if table.num_rows else table.column(value)
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        ranks = Ranks(values)
        upto = np.concatenate(([0], np.cumsum(ranks.nan)))
        at = np.arange(len(values))
        low, high = np.maximum(at - half, 0), np.minimum(at + half + 1, len(values))
        found = taken(values, rolling_places(ranks, half), upto[high] > upto[low])
        return table.select(kept).append_column(name, found).filter(table.column("_own"))

    ship_package(df.sparkSession)
    return copies.groupBy(*series, "_run").applyInArrow(medians, schema)


def median_pool(
    cells: DataFrame,
    image: list[str] = ("img",),
    channel: list[str] = ("ch",),
    kernel: tuple[int, int] = (31, 31),
    stride: tuple[int, int] = (1, 1),
    padding: tuple[int, int, int, int] = (0, 0, 0, 0),
    same: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """As ``raster.median_pool``, for kernels of any size: the work per cell does not grow with the kernel."""
    tiled = tiled_cells(cells, list(image), list(channel), kernel, stride, padding, same, tile)
    planes = [*image, *channel]
    schema = tiled.select(*planes, F.col("_r").cast("int").alias("row"), F.col("_c").cast("int").alias("col"), "value").schema

    def medians(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_r", "ascending"), ("_c", "ascending")]).combine_chunks()
        # Under strides wider than the kernel some rows and columns of the grid are in no window and not here.
        down, along = (np.unique(table.column(p).to_numpy()) for p in ("_r", "_c"))
        shape = len(down), len(along)
        values = table.column("value").chunk(0)
        one = table.slice(0, 1).to_pylist()[0]
        out_rows = np.arange(one["_tr"] * tile, min((one["_tr"] + 1) * tile, one["_rows"]))
        out_cols = np.arange(one["_tc"] * tile, min((one["_tc"] + 1) * tile, one["_cols"]))
        rows, cols = np.searchsorted(down, out_rows * stride[0]), np.searchsorted(along, out_cols * stride[1])
        ranks = Ranks(values)
        places = kernel_places(ranks, shape, kernel, rows, cols)
        nan = np.zeros((shape[0] + 1, shape[1] + 1), np.int64)
        nan[1:, 1:] = ranks.nan.reshape(shape).cumsum(axis=0).cumsum(axis=1)
        a, b = np.ix_(rows, cols)
        held = nan[a + kernel[0], b + kernel[1]] - nan[a, b + kernel[1]] - nan[a + kernel[0], b] + nan[a, b]
        n = places.size
        columns = [pa.repeat(pa.scalar(one[p], table.schema.field(p).type), n) for p in planes]
        at = [np.repeat(out_rows, len(cols)), np.tile(out_cols, len(rows))]
        columns += [pa.array(x, pa.int32()) for x in at]
        return pa.Table.from_arrays([*columns, taken(values, places.ravel(), held.ravel() > 0)], [*planes, "row", "col", "value"])

    ship_package(cells.sparkSession)
    return tiled.groupBy(*planes, "_tr", "_tc").applyInArrow(medians, schema)
