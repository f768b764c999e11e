"""Index arithmetic for windows over a padded axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_padding(size: Column, kernel: int, stride: int) -> tuple[Column, Column]:
    """Padding before and after an axis so that the output covers it: the odd unit goes last."""
    over = size % stride
    total = F.greatest(
        F.when(over == 0, F.lit(kernel - stride)).otherwise(F.lit(kernel) - over), F.lit(0)
    )
    before = F.floor(total / 2).cast("int")
    return before, (total - before).cast("int")


def padded_positions(i: Column, size: Column, before: Column, after: Column) -> Column:
    """Positions of the padded axis, counted from its start, that show source index ``i``."""
    low, high = -i, 2 * (size - 1) - i
    return F.filter(
        F.array(
            i + before,
            F.when((i > 0) & (low >= -before), low + before),
            F.when((i < size - 1) & (high < size + after), high + before),
        ),
        lambda p: p.isNotNull(),
    )


def output_size(size: Column, before: Column, after: Column, kernel: int, stride: int) -> Column:
    return (F.floor((size + before + after - kernel) / stride) + 1).cast("int")


def first_output(position: Column, kernel: int, stride: int) -> Column:
    """First output cell whose window covers a padded position."""
    return F.greatest(F.ceil((position - kernel + 1) / stride), F.lit(0)).cast("int")


def last_output(position: Column, outputs: Column, stride: int) -> Column:
    return F.least(F.floor(position / stride), outputs - 1).cast("int")
