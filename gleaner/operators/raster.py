"""Median windows over grids and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.grid import (
    first_output,
    last_output,
    output_size,
    padded_positions,
    same_padding,
)
from gleaner.functions.vectors import lower_median
from gleaner.operators.ordered import attach, rolling

# Output cells along one edge of a tile: a task handles whole tiles.
TILE = 256


def checked_size(
    cells: DataFrame, image: list[str], channel: list[str], kernel: tuple[int, int], stride: tuple[int, int],
    padding: tuple[int, int, int, int], same: bool,
) -> DataFrame:
    """Cells with ``height`` and ``width``: their own columns, else the largest row and column of the image.

    Fails for a plane that misses cells or holds some twice, and for a padding that no reflection can fill.
    """
    known = {"height", "width"} <= set(cells.columns)
    height = F.max("height") if known else (F.max("row") + 1).cast("int")
    width = F.max("width") if known else (F.max("col") + 1).cast("int")
    planes = cells.groupBy(*image, *channel).agg(
        F.count("*").alias("_n"), height.alias("height"), width.alias("width")
    )
    if not known:
        per_image = planes.groupBy(*image).agg(F.max("height").alias("height"), F.max("width").alias("width"))
        planes = attach(planes.drop("height", "width"), per_image, image)
    left, right, top, bottom = pads(F.col("height"), F.col("width"), kernel, stride, padding, same)
    fits = (F.greatest(top, bottom) < F.col("height")) & (F.greatest(left, right) < F.col("width"))
    whole = F.col("_n") == F.col("height") * F.col("width")
    checked = (
        F.when(~whole, F.raise_error(F.lit("a grid misses cells or holds some twice")))
        .when(~fits, F.raise_error(F.lit("the padding must be smaller than the grid")))
        .otherwise(F.col("height"))
    )
    sizes = planes.select(*image, *channel, checked.alias("height"), "width")
    return attach(cells.drop("height", "width"), sizes, [*image, *channel])


def incomplete_grids(cells: DataFrame, image: list[str], channel: list[str]) -> DataFrame:
    """Planes that miss cells or hold some twice."""
    planes = cells.groupBy(*image, *channel).agg(
        F.count(F.lit(1)).alias("n_cells"), ((F.max("row") + 1) * (F.max("col") + 1)).alias("n_expected")
    )
    return planes.filter(F.col("n_cells") != F.col("n_expected"))


def illegal_padding(
    cells: DataFrame, image: list[str], kernel: tuple[int, int], stride: tuple[int, int],
    padding: tuple[int, int, int, int] = (0, 0, 0, 0), same: bool = False,
) -> DataFrame:
    """Images that are too small for the padding: a reflection needs ``padding < size``."""
    sizes = cells.groupBy(*image).agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")
    )
    left, right, top, bottom = pads(F.col("height"), F.col("width"), kernel, stride, padding, same)
    fits = (F.greatest(top, bottom) < F.col("height")) & (F.greatest(left, right) < F.col("width"))
    return sizes.filter(~fits)


def pads(
    height: Column, width: Column, kernel: tuple[int, int], stride: tuple[int, int],
    padding: tuple[int, int, int, int], same: bool,
) -> tuple[Column, Column, Column, Column]:
    """Left, right, top and bottom padding."""
    if not same:
        left, right, top, bottom = (F.lit(p) for p in padding)
        return left, right, top, bottom
    top, bottom = same_padding(height, kernel[0], stride[0])
    left, right = same_padding(width, kernel[1], stride[1])
    return left, right, top, bottom


def tiled_cells(
    cells: DataFrame, image: list[str], channel: list[str], kernel: tuple[int, int], stride: tuple[int, int],
    padding: tuple[int, int, int, int], same: bool, tile: int,
) -> DataFrame:
    """Cells of the padded grid (``_r``, ``_c``), once for each tile (``_tr``, ``_tc``) whose outputs they feed.

    ``_rows`` and ``_cols`` are the sizes of the output. Only cells at a tile's edge go to two.
    """
    sized = checked_size(cells, image, channel, kernel, stride, padding, same)
    left, right, top, bottom = pads(F.col("height"), F.col("width"), kernel, stride, padding, same)
    planes = [*image, *channel]
    rows_out = output_size(F.col("height"), top, bottom, kernel[0], stride[0])
    cols_out = output_size(F.col("width"), left, right, kernel[1], stride[1])
    # Rows and columns in one generator: a column that only a second generator uses is not lost.
    down = padded_positions(F.col("row"), F.col("height"), top, bottom)
    along = padded_positions(F.col("col"), F.col("width"), left, right)
    places = F.flatten(
        F.transform(down, lambda r: F.transform(along, lambda c: F.struct(r.alias("_r"), c.alias("_c"))))
    )
    padded = sized.select(
        *planes, "value", rows_out.alias("_rows"), cols_out.alias("_cols"), F.explode(places).alias("_at")
    ).select(*planes, "value", "_rows", "_cols", "_at._r", "_at._c")

    def tiles(position: str, size: int, step: int, outputs: str) -> Column:
        first = first_output(F.col(position), size, step)
        last = last_output(F.col(position), F.col(outputs), step)
        span = F.sequence(F.floor(first / tile).cast("int"), F.floor(last / tile).cast("int"))
        return F.explode(F.when(first <= last, span))

    return padded.withColumn("_tr", tiles("_r", kernel[0], stride[0], "_rows")).withColumn(
        "_tc", tiles("_c", kernel[1], stride[1], "_cols")
    )


def median_pool(
    cells: DataFrame,
    image: list[str] = ("img",),
    channel: list[str] = ("ch",),
    kernel: tuple[int, int] = (3, 3),
    stride: tuple[int, int] = (1, 1),
    padding: tuple[int, int, int, int] = (0, 0, 0, 0),
    same: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """Lower median of every ``kernel`` window of a long grid ``(img, ch, row, col, value)``.

    Every cell of an image must be there, and a padding smaller than the image, else this fails. Cells go to the tile of the
    outputs they feed. Inside the tile the values are gathered along the rows and then along the columns, so after the
    one shuffle every cell is sorted twice, and no copy per window is made. A large kernel is for ``sliding.median_pool``.
    """
    planes = [*image, *channel]

    def starts(position: str, step: int, outputs: str, at: str) -> Column:
        """Whether a window of this tile starts at the position."""
        output = F.floor(F.col(position) / step)
        return (
            (F.col(position) % step == 0) & (output < F.col(outputs)) & (F.floor(output / tile) == F.col(at))
        )

    place = [*planes, "_tr", "_tc"]
    tiled = tiled_cells(cells, list(image), list(channel), kernel, stride, padding, same, tile).repartition(*place)
    along_row = W.partitionBy(*place, "_r").orderBy("_c").rangeBetween(0, kernel[1] - 1)
    along_col = W.partitionBy(*place, "_c").orderBy("_r").rangeBetween(0, kernel[0] - 1)
    across = tiled.withColumn("value", F.collect_list("value").over(along_row)).filter(
        starts("_c", stride[1], "_cols", "_tc")
    )
    whole = across.withColumn("value", F.collect_list("value").over(along_col)).filter(
        starts("_r", stride[0], "_rows", "_tr")
    )
    return whole.select(
        *planes,
        F.floor(F.col("_r") / stride[0]).cast("int").alias("row"),
        F.floor(F.col("_c") / stride[1]).cast("int").alias("col"),
        lower_median(F.flatten("value")).alias("value"),
    )


def rolling_lower_median(
    df: DataFrame, series: list[str], order: list[str], value: str, half: int,
    name: str = "rolling_median", bucket: Column | None = None,
) -> DataFrame:
    """Lower median over the ``half`` rows on both sides of each row of a series. For wide frames see ``sliding``."""
    gathered = rolling(df, series, order, half, {name: F.collect_list(value)}, bucket)
    return gathered.withColumn(name, lower_median(F.col(name)))
