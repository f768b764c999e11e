"""From texts to clean lines, and from lines to a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import clean_line_array, is_clean_line, split_lines, trim_end
from gleaner.operators.ordered import first_per_group, position, scan_groups
from gleaner.operators.sampling import draw_size, hash_number

# What the feed shows.
VISIBLE_LINES = 24
LAST_RESORT = "// typing source not available"


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line: ``pos`` from 0, ``line`` right-trimmed.

    Trimmed inside the generator, so that later tests on ``line`` do not repeat the trimming.
    """
    others = [c for c in df.columns if c != text]
    trimmed = F.transform(split_lines(F.col(text)), trim_end)
    return df.select(*others, F.posexplode(trimmed).alias("pos", "line"))


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_lines(df, text).filter(is_clean_line(F.col("line")))


def lines_of(manifest: DataFrame, contents: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Clean lines of the files a manifest lists."""
    return clean_lines(manifest.join(contents, file), text)


def choose_files(
    draws: DataFrame, draw: list[str], files: DataFrame, file: str, seed: int | str, bucket: Column | None = None
) -> DataFrame:
    """One file per draw, every file alike however long it is; NULL if there is none.

    Only file names are numbered here, in buckets that never fall along the names.
    """
    names = files.select(file)
    numbered = scan_groups(names, [], [file], {"_place": position()}, bucket)
    n = F.nullif(names.agg(F.count("*")).scalar(), F.lit(0))
    places = draws.withColumn("_place", 1 + hash_number(f"{seed}|file", *[F.col(d) for d in draw]) % n)
    return places.join(numbered, "_place", "left").drop("_place")


def sized_draws(
    draws: DataFrame, draw: list[str], files: DataFrame, file: str, text: str, seed: int | str,
    bucket: Column | None = None,
) -> DataFrame:
    """Per draw its ``file``, its ``size`` and the number ``_n`` of clean lines of the file. No text moves."""
    counted = files.select(file, F.size(clean_line_array(F.col(text))).alias("_n"))
    chosen = choose_files(draws, draw, files, file, seed, bucket).join(counted, file, "left")
    size = draw_size(seed, *[F.col(d) for d in draw])
    return chosen.select(*draw, file, size.alias("size"), F.coalesce("_n", F.lit(0)).alias("_n"))


def wishes(sized: DataFrame, others: list[str], seed: int | str, draw: list[str], n: Column) -> DataFrame:
    """One row per line wished for: ``pos`` in the draw, and ``_at``, its place among ``n`` lines."""
    each = sized.select(*others, n.alias("_of"), F.posexplode(F.sequence(F.lit(1), "size")).alias("pos", "_i"))
    at = hash_number(f"{seed}|item", *[F.col(d) for d in draw], F.col("_i")) % F.nullif("_of", F.lit(0))
    return each.select(*others, "pos", at.alias("_at"))


def draw_lines(
    draws: DataFrame, draw: list[str], files: DataFrame, file: str, text: str, seed: int | str,
    bucket: Column | None = None,
) -> DataFrame:
    """1 to 3 lines with replacement from one file per draw; none from a file without clean lines."""
    return lines_of_draws(sized_draws(draws, draw, files, file, text, seed, bucket), draw, files, file, text, seed)


def lines_of_draws(
    sized: DataFrame, draw: list[str], files: DataFrame, file: str, text: str, seed: int | str
) -> DataFrame:
    """The lines themselves, by file and place: a draw meets the lines it wants and no others.

    Draws of a popular file spread over its lines.
    """
    wanted = wishes(sized.filter("_n > 0"), [*draw, file], seed, draw, F.col("_n"))
    lines = files.select(file, F.posexplode(clean_line_array(F.col(text))).alias("_at", "line"))
    return wanted.join(lines, [file, "_at"]).select(*draw, file, "pos", "line")


def with_fallback(
    sized: DataFrame, lines: DataFrame, draw: list[str], snippets: DataFrame, seed: int | str,
    last_resort: str = LAST_RESORT,
) -> DataFrame:
    """Lines of the file, else snippets (``pos`` from 0, ``line``), else one fixed line."""
    n = snippets.agg(F.count("*")).scalar()
    wanted = wishes(sized.filter("_n = 0"), draw, f"{seed}|snippet", draw, n)
    spare = wanted.join(snippets.select(F.col("pos").cast("bigint").alias("_at"), "line"), "_at", "left")
    found = F.col("line").isNotNull()
    rest = spare.filter(found | (F.col("pos") == 0)).select(
        *draw, F.when(found, "snippet").otherwise("constant").alias("tier"), "pos",
        F.coalesce("line", F.lit(last_resort)).alias("line"),
    )
    return lines.select(*draw, F.lit("file").alias("tier"), "pos", "line").unionByName(rest)


def first_available(tiers: list[DataFrame]) -> DataFrame:
    """All rows of the first tier that has any. A look at one row tells."""
    return next((t for t in tiers[:-1] if not t.isEmpty()), tiers[-1])


def last_n(df: DataFrame, feed: list[str], order: list[str], n: int = VISIBLE_LINES) -> DataFrame:
    """The last ``n`` rows of each feed; a hot feed is cut in parts first."""
    return first_per_group(df, feed, [F.col(c).desc() for c in order], n, F.struct(*order))
