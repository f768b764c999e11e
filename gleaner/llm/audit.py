"""Filter interaction audit over failing-id relations.

Every document has a row number, given once and written. Each filter has a table of the ids that fail it,
stored below the shared folder. What an order of filters does at one step depends only on the set of filters
before it, the prefix, so 32 prefixes stand for all 120 orders. With ``gone`` (prefix, id: fails a filter of the
prefix), which is the union of the id tables per prefix,

* the survivors of a prefix are the ids that a left-anti join with ``gone`` leaves,
* a filter removes after a prefix those ids of its table that a left-anti join with ``gone`` leaves,
* and is redundant on those that a left-semi join with ``gone`` finds.

The three joins run once for all prefixes, on (prefix, id), so no part, however large, meets in one task.
Counts per part, filter and prefix are added up before they are shuffled; the orders are laid out from them.

Defined cases: a null text counts as empty; a null ``lang`` is the part of the empty string; repeated rows
are documents of their own (equal rows of one ``doc_id`` are no duplicates of each other, a smaller ``doc_id``
is asked for); a null ``doc_id`` is no duplicate and has no labels; of several labels for one ``doc_id`` any counts;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import BLANK_CLASS, BLANKS, documents, whole_text
from gleaner.operators.rowwise import computed
from gleaner.session import new_path, write_through

COUNTS = ("removed", "redundant", "good_lost", "toxic_lost", "kept")

# Conditions of failure over the signals of ``signals``; E, the exact copies, needs the whole table.
CONDITIONS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_chars",
    "D": "has_symbol",
}
COPIES = "E"


def signals(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, the ``digest`` of the text and what the conditions use."""
    raw = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("raw"))
    trimmed = F.btrim("raw", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK_CLASS}+"))
    split = computed(raw, ["doc_id", "part", "raw"], {"words": words})
    return split.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("raw", 256)).alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("raw", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.length("raw").cast("long").alias("n_chars"),
        F.rlike("raw", F.lit("[#$%&*|]")).alias("has_symbol"),
    )


def identified(docs: DataFrame, labels: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Written: ``id``, ``part``, ``good``, ``toxic``, ``doc_id``, ``digest`` and ``failed``, names of conditions."""
    names = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in conditions.items()]))
    found = signals(docs).select(F.monotonically_increasing_id().alias("id"), "doc_id", "part", "digest", names.alias("failed"))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # Row numbers hold only once they are written: a lost task may number its rows anew.
    numbered = write_through(found)
    # Labels grow with the documents, so they are never broadcast.
    flagged = numbered.join(flags.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    return write_through(flagged.select("id", "part", yes("good"), yes("toxic"), "doc_id", "digest", "failed"))


def copies(ids: DataFrame) -> DataFrame:
    """The rows whose text a smaller ``doc_id`` has.

    First ids per text are found map-side first; the join is on text and id, so a large group of copies is spread.
    """
    named = ids.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return named.join(firsts.hint("merge"), ["digest", "doc_id"], "left_anti")


def id_tables(ids: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """One stored table of failing ids per filter, each in its own folder: ``id``, ``part``, ``good``, ``toxic``."""
    spark, path = ids.sparkSession, new_path(ids.sparkSession)
    kept = ["id", "part", "good", "toxic"]
    by_text = ids.select(*kept, F.explode("failed").alias("filter"))
    by_copy = copies(ids).select(*kept, F.lit(COPIES).alias("filter"))
    rows = by_text.unionByName(by_copy)
    rows.write.partitionBy("filter").parquet(path)
    return {n: spark.read.schema(rows.schema).parquet(path).filter(F.col("filter") == n).drop("filter") for n in names}


def counted(ids: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``part``, ``filter``, ``prefix`` (bits of the filters before) and the ``COUNTS``.

    ``kept`` stands in rows of the empty filter: survivors of the prefix. Cells that count nothing are there too.
    """
    names = list(failing)
    every = range(1 << len(names))
    prefixes = lambda test: F.array(*[F.lit(p) for p in every if test(p)])
    gone = steps = None
    for k, (name, table) in enumerate(failing.items()):
        hit = table.select(F.explode(prefixes(lambda p, k=k: p >> k & 1)).alias("prefix"), "id")
        own = table.select(
            F.lit(name).alias("filter"), F.explode(prefixes(lambda p, k=k: not p >> k & 1)).alias("prefix"),
            "id", "part", "good", "toxic",
        )
        gone = hit if gone is None else gone.unionByName(hit)
        steps = own if steps is None else steps.unionByName(own)
    key = ["prefix", "id"]
    cell = ["part", "filter", "prefix"]
    # Both sides grow with the documents.
    gone = gone.hint("merge")
    removed = steps.join(gone, key, "left_anti").groupBy(*cell).agg(
        F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")
    )
    redundant = steps.join(gone, key, "left_semi").groupBy(*cell).agg(F.count("*").alias("redundant"))
    living = ids.select("part", F.lit("").alias("filter"), F.explode(prefixes(lambda p: True)).alias("prefix"), "id")
    kept = living.join(gone, key, "left_anti").groupBy(*cell).agg(F.count("*").alias("kept"))
    grid = F.array(
        *[F.struct(F.lit(n).alias("filter"), F.lit(p).alias("prefix")) for k, n in enumerate(names) for p in every if not p >> k & 1],
        *[F.struct(F.lit("").alias("filter"), F.lit(p).alias("prefix")) for p in every],
    )
    none = ids.select("part").distinct().select("part", F.explode(grid).alias("c")).select("part", "c.filter", "c.prefix")
    rows = none
    for found in (removed, redundant, kept):
        rows = rows.unionByName(found, allowMissingColumns=True)
    return rows.groupBy(*cell).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])


def interactions(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step."""
    n = len(names)
    size = F.bit_count("prefix")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    key = F.concat("filter", F.col("prefix").cast("string"))
    value = F.struct(*COUNTS)
    parts = cells.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key.alias("key"), value.alias("value")))).alias("cells"),
        *[F.sum(F.when(F.col("filter") == x, weight * F.col("removed"))).alias(f"_{x}") for x in names],
    )
    orders = F.array(*[F.lit("".join(o)) for o in permutations(names)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bits = [F.when(F.instr("filter_order", x) < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(names)]
    at = (
        steps.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
        .withColumn("before", sum(bits[1:], bits[0]))
        .withColumn("own", F.expr("CASE filter " + " ".join(f"WHEN '{x}' THEN {1 << k}" for k, x in enumerate(names)) + " END"))
    )

    def look(filter_: Column, prefix: Column, count: str) -> Column:
        return F.col("cells")[F.concat(filter_, prefix.cast("string"))][count]

    own, before = F.col("filter"), F.col("before")
    return at.select(
        "part",
        "filter_order",
        "step",
        look(F.lit(""), before + F.col("own"), "kept").alias("kept"),
        look(own, before, "removed").alias("removed"),
        look(own, before, "redundant").alias("redundant"),
        look(own, F.lit((1 << n) - 1) - F.col("own"), "removed").alias("unique_fails"),
        look(own, before, "good_lost").alias("good_lost"),
        look(own, before, "toxic_lost").alias("toxic_lost"),
        F.coalesce(*[F.when(own == x, F.col(f"_{x}")) for x in names]).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] | None = None) -> DataFrame:
    """The audit of ``conditions`` (a letter each, SQL over ``signals``) and of exact copies, in all orders."""
    conditions = conditions or CONDITIONS
    names = [*conditions, COPIES]
    ids = identified(docs, labels, conditions)
    return interactions(counted(ids, id_tables(ids, names)), names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH split AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), flags AS (
    SELECT doc_id, part,
        (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM split
), marks AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT [a.x, b.x, c.x, d.x, e.x] AS xs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT array_to_string(xs, '') AS filter_order, unnest(range(1, 6)) AS step, xs, bits FROM orders
), places AS (
    SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step]) - bits[step] AS before FROM steps
), sums AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM places CROSS JOIN masks GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""

QUERIES = {"op13_filter_audit": query}
SQL = {"op13_filter_audit": ORACLE}
