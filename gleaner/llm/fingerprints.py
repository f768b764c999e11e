"""Document fingerprints: threshold-scaled sketches of word shingles, by built-in functions alone.

A shingle of ``WIDTH`` lower-cased words has a 64-bit hash; the sketch keeps every distinct hash below a fixed
fraction of their range, ``2 ** -BITS``. Its size follows the text, so a short document is compared
with a long one on the same shingles: the share of a's kept hashes that b keeps too estimates how much of
a stands in b. Sketches of parts are merged by union, and are that of the whole but for shingles across the seams.
A text whose shingles all lie above the threshold keeps its least hash, so that no text with words has an
empty sketch; a merge drops such hashes as soon as there is one below. A text of fewer words is one shingle.

``in_order`` gives every document the next one by descending id. Ids are cut into at most ``GROUPS`` ranges,
whose ends, two numbers each, are all that the driver sees; the text is shuffled once, by range, and the largest
document of a range goes to the next one too.

Defined cases: a null text counts as empty and, like one of blanks only, has an empty sketch; two empty
sketches are alike (1), an empty one and another are not (0). Rows of one ``doc_id`` follow each other by their
text; null ids come last and pass for the smallest id. The only row of a table is its own next one. Other
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import BLANK_CLASS, BLANKS, documents, whole_text

WIDTH = 5
BITS = 3
# Hashes are signed: the lowest eighth of their range.
BELOW = -(2**63) + 2 ** (64 - BITS)

# Documents in a range of ids, and ranges at most.
GROUP, GROUPS = 1024, 1 << 16

LEAST = -(2**63)


def sketched(df: DataFrame, text: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` and its sketches: ascending distinct hashes of the column ``text`` as ``name``."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK_CLASS}+"))
    nexts = "".join(f", _h[i + {k}]" for k in range(1, width))
    shingles = f"""CASE WHEN size(_h) >= {width} THEN transform(slice(_h, 1, size(_h) - {width - 1}), (x, i) -> xxhash64(x{nexts}))
        WHEN size(_h) > 0 THEN array(xxhash64(_h)) ELSE slice(_h, 1, 0) END"""
    kept = f"filter(_h, x -> x < {BELOW})"
    return (
        df.withColumn("_h", words)
        .withColumn("_h", F.expr("transform(_h, w -> xxhash64(w))"))
        .withColumn("_h", F.expr(shingles))
        .withColumn(name, F.expr(f"CASE WHEN exists(_h, x -> x < {BELOW}) THEN {kept} ELSE slice(sort_array(_h), 1, 1) END"))
        .drop("_h")
        .withColumn(name, F.sort_array(F.array_distinct(name)))
    )


def merged(a: Column, b: Column) -> Column:
    """Sketch of both texts together."""
    both = F.sort_array(F.array_union(a, b))
    # Ascending, so a first hash above the threshold means that all are.
    return F.when(F.size(both) == 0, both).when(
        both[0] < BELOW, F.filter(both, lambda x: x < BELOW)
    ).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null where a keeps nothing below the threshold."""
    own = F.filter(a, lambda x: x < BELOW)
    return F.size(F.array_intersect(own, b)) / F.nullif(F.size(own), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(either, F.lit(0)))


def as_text(sketch: Column) -> Column:
    """Hashes as hexadecimal digits, 16 each."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and its ``sketch``."""
    return sketched(docs.select("doc_id", whole_text().alias("_text")), "_text", "sketch", width).drop("_text")


def ranges(docs: DataFrame, group: int) -> tuple[list[int], list[int]]:
    """Least and greatest key of every range of ids, ascending."""
    keys = docs.select("_key")
    n = min(GROUPS, -(-keys.count() // group)) or 1
    ends = (
        keys.repartitionByRange(n, "_key")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("_key").alias("low"), F.max("_key").alias("high"))
        .orderBy("low")
        .collect()
    )
    return [r.low for r in ends], [r.high for r in ends]


def numbers(values: list[int]) -> Column:
    """A literal array, however long, in one expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def range_of(key: Column, lows: list[int]) -> Column:
    """Place, from 1, of the last low end that is not above ``key``: looked up among every few, then between."""
    step = isqrt(len(lows)) + 1
    at_most = lambda x: x <= key
    wide = (F.size(F.filter(numbers(lows[::step]), at_most)) - 1) * step
    return wide + F.size(F.filter(F.slice(numbers(lows), wide + 1, F.lit(step)), at_most))


def in_order(docs: DataFrame, add, carried: list[str], group: int = GROUP) -> DataFrame:
    """``doc_id``, ``text``, the columns that ``add`` makes of them, and ``next_`` of ``text`` and of ``carried``:
    those of the next document by descending id, after the last one of the first."""
    keyed = docs.select(
        F.col("doc_id").cast("long"), whole_text().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_key")
    )
    lows, highs = ranges(keyed, group)
    own = range_of(F.col("_key"), lows) if lows else F.lit(1)
    placed = keyed.withColumn("_own", own)
    on = F.struct((F.col("_own") % F.lit(len(lows) or 1) + 1).alias("to"), F.lit(True).alias("copy"))
    here = F.struct(F.col("_own").alias("to"), F.lit(False).alias("copy"))
    is_high = F.col("_key") == F.element_at(numbers(highs), F.col("_own")) if highs else F.lit(False)
    sent = placed.withColumn("_at", F.explode(F.when(is_high, F.array(here, on)).otherwise(F.array(here))))
    dealt = sent.select("doc_id", "text", "_key", F.col("_at.to").alias("_to"), F.col("_at.copy").alias("_copy")).repartition("_to")
    order = W.partitionBy("_to").orderBy("_copy", F.desc("_key"), "text")
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carried)]
    return add(dealt).select("*", *nexts).filter("NOT _copy").drop("_key", "_to", "_copy")


def edited(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Fingerprints of every document and of its text edited with that of the next one, and their likeness."""
    rows = in_order(docs, lambda df: sketched(df, "text", "own", width), ["own"], group)
    mixed = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.expr("concat(left(text, length(text) - length(text) div 2), left(next_text, length(text) div 2))").alias("edited"),
        "own",
        "next_own",
    )
    found = sketched(mixed, "edited", "other", width)
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        containment(F.col("own"), F.col("other")).alias("contained_in_edited"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir))


QUERIES = {"op11_scaled_fingerprints": query}
SQL: dict[str, str] = {}
