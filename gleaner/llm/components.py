"""Connected components of a link table, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import write_through


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has a link; ``links`` holds ``a``, ``b``.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows, until all edges are stars. Takes a number of rounds in the order of log(nodes); each
    is written to the shared folder. Minima are combined map-side, so a hub costs one row per task.
    """
    known = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = write_through(known.filter("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = write_through(stars)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
