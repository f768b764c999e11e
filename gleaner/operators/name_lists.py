"""Allow and block lists that are tables: which names hold an entry as a substring.

A short list is an OR of ``contains`` (``repos.filter_names``). A long one is an inverted index: every entry is kept
under one of its grams of ``GRAM`` letters, the one that the fewest names hold, and names meet entries by their own
grams in an equi-join; what met is compared as a whole. Nothing is compared with all of the other side, and neither
side is broadcast. A name only sends the grams that some entry is kept under, which a bitmap of fixed size tells, so
names that hold none are not shuffled at all.

Grams that more than ``SHARE`` names hold are cut: a second bitmap tells them, their entries are repeated, once per
``SHARE`` names of the most frequent one, and the names are spread over the copies. Equal names are looked up once.

Names and entries are compared in lower case. A null name counts as empty; blank entries are no entries; an entry
shorter than a gram is its own gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import write_through

GRAM = 4
SHARE = 100_000
BITS = 1 << 20


def grams(text: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given sizes."""
    of = lambda n: F.when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def marked(found: DataFrame) -> Column:
    """Whether the bit of a ``gram`` is set in the bitmap of those of ``found``: ``BITS`` bits, collected and sent as a literal."""
    at = place(F.col("gram"))
    words = found.groupBy(F.floor(at / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits"))
    bits = [0] * (BITS // 64)
    for row in words.collect():
        bits[row.word] = row.bits
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<long>")  # one literal, folded once
    word = F.get(table, F.floor(at / 64).cast("int"))
    return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def matching(names: DataFrame, entries: DataFrame, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """The distinct ``name`` of ``names`` (one column, lower case) that hold an entry (one column) as a substring."""
    listed = entries.select(F.lower(F.trim(F.col(entries.columns[0]))).alias("entry")).filter("entry <> ''").distinct()
    kept = write_through(
        listed.select("entry", F.explode(grams(F.col("entry"), [gram])).alias("gram")).unionByName(
            listed.filter(F.length("entry") < gram).select("entry", F.col("entry").alias("gram"))
        )
    )
    sizes = [r.n for r in kept.select(F.length("gram").alias("n")).distinct().collect()]  # at most ``gram`` of them
    if not sizes:
        return names.limit(0)
    distinct = names.select(F.col(names.columns[0]).alias("name")).filter("name <> ''").distinct()

    def sent(wanted: DataFrame) -> DataFrame:
        return distinct.select("name", F.explode(grams(F.col("name"), sizes)).alias("gram")).filter(marked(wanted.select("gram")))

    often = sent(kept).groupBy("gram").agg(F.count("*").alias("often"))
    # An entry with a gram that no name holds is in no name.
    counted = kept.join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rarest = counted.groupBy("entry").agg(F.min(F.struct("often", "gram")).alias("key")).filter("key.often > 0")
    index = write_through(rarest.select("entry", "key.gram", "key.often"))
    most = index.agg(F.max("often")).first()[0] or 0
    # The bitmap decides on both sides alike, so a gram that it marks by chance is merely spread too.
    is_cut = marked(index.filter(F.col("often") > share).select("gram")) if most > share else F.lit(False)
    fan = -(-most // share)
    copies = index.select("entry", "gram", F.explode(F.when(is_cut, F.sequence(F.lit(0), F.lit(max(fan, 1) - 1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    asked = sent(index).withColumn("copy", F.when(is_cut, F.pmod(F.hash("name"), F.lit(max(fan, 1)))).otherwise(0))
    return asked.join(copies.hint("merge"), ["gram", "copy"]).filter(F.contains("name", "entry")).select("name").distinct()


def _held(df: DataFrame, entries: DataFrame, name: str, how: str, **options) -> DataFrame:
    names = df.select(F.lower(F.coalesce(F.col(name), F.lit(""))).alias("name"))
    found = matching(names, entries, **options).select(F.col("name").alias("_held"))
    return df.join(found.hint("merge"), F.lower(F.coalesce(F.col(name), F.lit(""))) == F.col("_held"), how)


def drop_listed(df: DataFrame, entries: DataFrame, name: str = "name", **options) -> DataFrame:
    """Rows whose ``name`` holds none of the entries."""
    return _held(df, entries, name, "left_anti", **options)


def keep_listed(df: DataFrame, entries: DataFrame, name: str = "name", **options) -> DataFrame:
    """Rows whose ``name`` holds an entry; an empty list sets no limit."""
    if entries.filter(F.trim(F.col(entries.columns[0])) != "").isEmpty():
        return df
    return _held(df, entries, name, "left_semi", **options)


def filter_names_by_table(
    df: DataFrame, allow: DataFrame | None = None, block: DataFrame | None = None, name: str = "name", **options
) -> DataFrame:
    """As ``repos.filter_names`` with lists that are tables of one column: block list first, then allow list."""
    kept = df if block is None else drop_listed(df, block, name, **options)
    return kept if allow is None else keep_listed(kept, allow, name, **options)
