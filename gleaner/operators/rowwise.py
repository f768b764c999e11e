"""Costly columns, computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and the new columns.

    A plain projection would be copied into every filter and expression that uses it, and the text
    parsed again for each; a one-row generator is not taken apart by the optimizer.
    """
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*keep, once.alias("_once")).select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])
