"""Arithmetic inside one array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_coordinates(vector: Column, n: int = 3) -> Column:
    """Leading coordinates as doubles."""
    return F.slice(vector, 1, n).cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def exponentials(vector: Column) -> Column:
    """``exp(x - max)`` per entry; dividing by the total gives the softmax."""
    peak = F.transform(
        F.array(vector.cast("array<double>")),
        lambda v: F.struct(v.alias("v"), F.array_max(v).alias("top")),
    )
    return F.flatten(F.transform(peak, lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"]))))


def softmax(vector: Column) -> Column:
    # Bound through a one-element array so that the powers and their total are computed once.
    powers = F.struct(exponentials(vector).alias("p"))
    summed = F.transform(F.array(powers), lambda s: F.struct(s["p"].alias("p"), total(s["p"]).alias("t")))
    return F.flatten(F.transform(summed, lambda s: F.transform(s["p"], lambda p: p / s["t"])))


def lower_median(values: Column) -> Column:
    """Middle value; the lower of the two when the count is even; NaN if any value is."""
    ordered = F.sort_array(values)  # NaN last
    last = F.get(ordered, F.size(values) - 1)
    middle = F.get(ordered, F.floor((F.size(values) - 1) / 2).cast("int"))
    return F.when(F.isnan(last), last).otherwise(middle)
