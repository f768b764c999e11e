"""Line dedup by site-relative frequency.

Pages are grouped by host. A line is boilerplate on a host if it stands on at least ``MIN_PAGES`` of its
pages and on a larger share of them than ``RATIO``. Boilerplate lines are dropped from that host's pages.
Lines are compared without the blanks around them, by 128-bit digests.

A page counts a line once. Counts per host and line are combined map-side. The boilerplate lines of a host
are few by construction, its average number of lines per page divided by the ratio at most, so they travel
as one array per host; the texts are joined with them on the host. A host with more than one of ``SHARES``
shares of all pages is split into as many parts as it has shares, so no part is larger, whatever the host
holds. There are fewer than ``SHARES`` such hosts, which is the bound of the only broadcast.

Defined cases: null hosts are one host of their own; a null text has no lines and stays null; blank lines
are kept and not counted; repeated rows are pages of their own; a page of boilerplate only ends up empty
but stays; extra columns of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, documents

RATIO = 0.1
MIN_PAGES = 5

# No part of a host's pages that meets its boilerplate holds more than about one of so many shares of all pages.
SHARES = 1024


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def digest(line: Column) -> Column:
    """128 bits of a trimmed line, as two numbers."""
    hexed = F.md5(line)
    return F.struct(
        F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long").alias("a"),
        F.conv(F.substring(hexed, 16, 15), 16, 10).cast("long").alias("b"),
    )


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host`` and the array ``common`` of digests; ``pages`` holds ``host`` and ``text``."""
    lines = F.filter(F.transform(F.split("text", "\n"), trimmed), lambda x: x != "")
    each = pages.select("host", F.explode(F.array_distinct(lines)).alias("line"))
    counts = each.groupBy("host", digest(F.col("line")).alias("line")).agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    frequent = counts.filter(F.col("n") >= min_pages).join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return (
        frequent.filter(F.col("n") > ratio * F.col("n_pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("common"))
    )


def split_hosts(pages: DataFrame, shares: int = SHARES) -> DataFrame:
    """``hot`` hosts and into how many ``parts`` their pages go; a host of one part has no row."""
    most = max(pages.count() / shares, 1)
    sizes = pages.groupBy(F.col("host").alias("hot")).agg(F.count("*").alias("n"))
    return sizes.filter(F.col("n") > most).select("hot", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def cleaned(pages: DataFrame, page: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the ``text`` without boilerplate, ``n_lines`` before and ``n_dropped``.

    ``pages`` holds ``host``, ``text`` and anything else under names of its own; ``page`` tells pages apart,
    as far as there is something that does.
    """
    hot = F.broadcast(split_hosts(pages))
    parts = F.coalesce("parts", F.lit(1))
    split = lambda df: df.join(hot, F.col("host").eqNullSafe(F.col("hot")), "left").drop("hot")
    common = split(boilerplate(pages, ratio, min_pages)).select(
        F.col("host").alias("h"), "common", F.explode(F.sequence(F.lit(0), parts - 1)).alias("s")
    )
    salted = split(pages).withColumn("salt", F.pmod(F.xxhash64(page), parts).cast("int")).drop("parts")
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s"))
    met = salted.join(common, same, "left").drop("h", "s", "salt")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda x: ~F.array_contains("common", digest(trimmed(x))))
    return (
        met.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("left", F.when(F.col("common").isNull(), lines).otherwise(left))
        .withColumn("n_dropped", F.col("n_lines") - F.coalesce(F.size("left"), F.lit(0)))
        .withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join("left", "\n")).otherwise(F.col("text")))
        .drop("left", "common")
    )


def without_boilerplate(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents with cleaned texts and, where there is such a column, their new ``n_chars``."""
    rows = docs.select(F.col(host).alias("host"), F.col("text"), F.struct("*").alias("row"))
    done = cleaned(rows, F.col("row.doc_id"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_dropped") > 0, n_chars).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir).select("doc_id", F.col("source").alias("host"), "text")
    return cleaned(pages, F.col("doc_id")).select("doc_id", F.col("host").alias("source"), "n_lines", "n_dropped", "text")


def clean_sql(table: str = "documents") -> str:
    blanks = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    SELECT doc_id, source, lang, n_chars, text AS raw,
        CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
        CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
        CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text
    FROM (
        SELECT *, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), trim(x, {blanks}))) AS kept
        FROM (SELECT *, string_split(text, chr(10)) AS lines FROM {table})
        LEFT JOIN (
            SELECT source AS host, list(line) AS common FROM (
                SELECT source, line, count(*) AS n FROM (
                    SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, {blanks})))) AS line
                    FROM {table}
                ) WHERE line <> '' GROUP BY source, line
            ) JOIN (SELECT source AS s, count(*) AS n_pages FROM {table} GROUP BY source) ON source IS NOT DISTINCT FROM s
            WHERE n >= {MIN_PAGES} AND n > {RATIO} * n_pages GROUP BY source
        ) ON source IS NOT DISTINCT FROM host
    )"""


QUERIES = {"op5_site_lines": query}
SQL = {"op5_site_lines": f"SELECT doc_id, source, n_lines, n_dropped, text FROM ({clean_sql()})"}
