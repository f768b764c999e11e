"""Documents as lines, conversations as feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import utf16_length
from gleaner.operators.lines import (
    clean_lines,
    draw_lines as draw_file_lines,
    explode_lines,
    first_available,
    last_n,
    lines_of,
    lines_of_draws,
    sized_draws,
    with_fallback,
)
from gleaner.plans.feed import line_feed as feed_lines
from gleaner.plans.registered import table

# Lines to fall back to.
SNIPPETS = ["select 1", "for row in rows:", "    total += row.amount", "return total", "# end"]

# Documents of one bucket when they are numbered.
NUMBERED = 100_000


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SNIPPETS)), "pos int, line string")


def by_id() -> Column:
    return F.floor(F.col("doc_id") / NUMBERED)


def clean_lines_by_source(spark: SparkSession, folder: str) -> DataFrame:
    lines = clean_lines(table(spark, folder, "documents").select("source", "text"))
    units = utf16_length(F.col("line"))
    return lines.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(units).alias("n_units"),
        F.max(units).cast("bigint").alias("longest"),
    )


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All lines per document, before the screen."""
    lines = explode_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


def manifest_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest lists all documents."""
    docs = table(spark, folder, "documents")
    manifest = docs.select("doc_id")
    return lines_of(manifest, docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "line"
    )


def draw_lines(spark: SparkSession, folder: str) -> DataFrame:
    draws = table(spark, folder, "conversations").select("conv_id", "turn")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return draw_file_lines(draws, ["conv_id", "turn"], docs, "doc_id", "text", 11, by_id()).select(
        "conv_id", "turn", "doc_id", F.col("pos").cast("bigint").alias("pos"), "line"
    )


def fallback_lines(spark: SparkSession, folder: str) -> DataFrame:
    draws = table(spark, folder, "conversations").select("conv_id", "turn")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    draw = ["conv_id", "turn"]
    sized = sized_draws(draws, draw, docs, "doc_id", "text", 11, by_id())
    lines = lines_of_draws(sized, draw, docs, "doc_id", "text", 11)
    return with_fallback(sized, lines, draw, snippets(spark), 11).select(
        "conv_id", "turn", "tier", F.col("pos").cast("bigint").alias("pos"), "line"
    )


def line_feed(spark: SparkSession, folder: str) -> DataFrame:
    draws = table(spark, folder, "conversations").select("conv_id", "turn")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return feed_lines(
        draws, "conv_id", "turn", docs, "doc_id", "text", snippets(spark), 11, visible=5, bucket=by_id()
    ).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "line"
    )


def first_tier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    tiers = [docs.filter(F.col("lang") == "xx"), docs.filter(F.col("lang") == "es"), docs]
    return first_available(tiers)


def last_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return last_n(turns, ["conv_id"], ["turn"], 3)


def last_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return last_n(events, ["user_id"], ["event_id"])


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines_by_source, line_counts, manifest_lines, draw_lines, fallback_lines, line_feed, first_tier,
        last_turns, last_events,
    )
}

BLANK = r"[\s\x0B\x{FEFF}\p{Z}]"


def lines_sql(columns: str, source: str = "documents") -> str:
    return rf"""
        SELECT {columns}, unnest(range(len(a))) AS pos, regexp_replace(unnest(a), '{BLANK}+$', '') AS line
        FROM (SELECT {columns}, regexp_split_to_array(text, '\r?\n') AS a FROM {source})
    """


UNITS = r"(length(line) + length(regexp_replace(line, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
CLEAN = rf"""line <> '' AND {UNITS} <= 120 AND NOT regexp_matches(line, '^{BLANK}*[{{}}\[\]();,:]+$')"""


def hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


DRAWS_SQL = rf"""
    clean AS (
        SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS at,
               count(*) OVER (PARTITION BY doc_id) AS n
        FROM ({lines_sql("doc_id")}) WHERE {CLEAN}
    ),
    numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents),
    draws AS (
        SELECT conv_id, turn, doc_id, CAST(1 + {hash_sql("'11|size|' || conv_id || '|' || turn")} % 3 AS BIGINT) AS size
        FROM conversations
        JOIN numbered ON place = 1 + {hash_sql("'11|file|' || conv_id || '|' || turn")}
                                     % (SELECT count(*) FROM documents)
    ),
    wishes AS (
        SELECT conv_id, turn, doc_id, unnest(range(1, size + 1)) AS i FROM draws
    ),
    hits AS (
        SELECT w.conv_id, w.turn, w.doc_id, w.i, c.line
        FROM wishes w JOIN (SELECT DISTINCT doc_id, n FROM clean) s USING (doc_id)
        JOIN clean c ON c.doc_id = w.doc_id
            AND c.at = {hash_sql("'11|item|' || w.conv_id || '|' || w.turn || '|' || w.i")} % s.n
    ),
    shown AS (
        SELECT conv_id, turn, 'file' AS tier, i - 1 AS pos, line FROM hits
        UNION ALL
        SELECT w.conv_id, w.turn, 'snippet', i - 1,
               [{", ".join("'" + s + "'" for s in SNIPPETS)}][
                   1 + {hash_sql("'11|snippet|item|' || w.conv_id || '|' || w.turn || '|' || w.i")} % {len(SNIPPETS)}]
        FROM wishes w WHERE doc_id NOT IN (SELECT doc_id FROM clean)
    )
"""

SQL = {
    "clean_lines_by_source": rf"""
        SELECT source, count(*) AS n_lines, CAST(sum({UNITS}) AS BIGINT) AS n_units,
               CAST(max({UNITS}) AS BIGINT) AS longest
        FROM ({lines_sql("source")}) WHERE {CLEAN} GROUP BY source
    """,
    "line_counts": f"""
        SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
        FROM ({lines_sql("doc_id")}) GROUP BY doc_id
    """,
    "manifest_lines": f"""
        SELECT doc_id, pos, line FROM ({lines_sql("doc_id")}) WHERE {CLEAN}
    """,
    "draw_lines": f"WITH {DRAWS_SQL} SELECT conv_id, turn, doc_id, i - 1 AS pos, line FROM hits",
    "fallback_lines": f"WITH {DRAWS_SQL} SELECT conv_id, turn, tier, pos, line FROM shown",
    "line_feed": f"""
        WITH {DRAWS_SQL}
        SELECT conv_id, turn, pos, line FROM shown
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, pos DESC) <= 5
    """,
    "first_tier": "SELECT doc_id, lang, source FROM documents WHERE lang = 'es'",
    "last_turns": """
        SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3
    """,
    "last_events": """
        SELECT user_id, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 24
    """,
}
