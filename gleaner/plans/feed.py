"""The line feed: draw, fall back, keep the last lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.lines import VISIBLE_LINES, last_n, lines_of_draws, sized_draws, with_fallback


def line_feed(
    draws: DataFrame, feed: str, at: str, files: DataFrame, file: str, text: str, snippets: DataFrame,
    seed: int | str, visible: int = VISIBLE_LINES, bucket: Column | None = None,
) -> DataFrame:
    """What each feed shows after its last draw: ``feed, at, pos, line``."""
    draw = [feed, at]
    sized = sized_draws(draws.select(*draw), draw, files, file, text, seed, bucket)
    lines = with_fallback(sized, lines_of_draws(sized, draw, files, file, text, seed), draw, snippets, seed)
    return last_n(lines.select(feed, at, "pos", F.col("line")), [feed], [at, "pos"], visible)
