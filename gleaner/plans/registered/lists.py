"""Allow and block lists that are tables of many entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.name_lists import drop_listed, filter_names_by_table
from gleaner.plans.registered import table
from gleaner.plans.registered.corpus import page_links


def words(spark: SparkSession, folder: str, letters: str) -> DataFrame:
    """Runs of that many ASCII letters in all documents, as list entries."""
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-z]{letters}"), F.lit(0))
    return table(spark, folder, "documents").select(F.explode(found).alias("entry"))


def listed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by their address: none of the long words of the documents, and one of the short ones."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return filter_names_by_table(pages, words(spark, folder, "{4,5}"), words(spark, folder, "{8,}"), "url").select("page_id", "url")


def excluded_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose path holds none of the words of the documents."""
    links = page_links(spark, folder).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("url").alias("path"))
    return drop_listed(links, words(spark, folder, "{4,}"), "path")


QUERIES = {f.__name__: f for f in (listed_names, excluded_paths)}

ENTRIES = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{}'))) AS entry FROM documents"

SQL = {
    "listed_names": f"""
        WITH block AS ({ENTRIES.format("{8,}")}), allow AS ({ENTRIES.format("{4,5}")})
        SELECT page_id, url FROM pages
        WHERE NOT EXISTS (SELECT 1 FROM block WHERE contains(lower(url), entry))
          AND EXISTS (SELECT 1 FROM allow WHERE contains(lower(url), entry))
    """,
    "excluded_paths": f"""
        WITH entries AS ({ENTRIES.format("{4,}")}), links AS (
            SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS path,
                   unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages
        ), held AS (SELECT DISTINCT path FROM (SELECT DISTINCT path FROM links) p JOIN entries ON contains(lower(path), entry))
        SELECT page_id, pos, path FROM links WHERE path NOT IN (SELECT path FROM held)
    """,
}
