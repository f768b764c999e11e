"""Near duplicates: fast similarity sketching, banding, exact verification, connected components.

A document's set holds its distinct word shingles (hashes of 64 bits). The sketch has ``BINS`` bins.
In round i every element is hashed to a bin and a value; a bin keeps the least value of the first
round that reaches it. Rounds go on until no bin is empty; after ``BINS`` rounds, round ``BINS + k``
throws all elements into bin k alone, so every coordinate is filled, with the concentration of
independent samples. Large sets are done after a round or two.

Bands of ``ROWS`` coordinates are the buckets. Documents with equal sets are one class, which takes part
once. At a similarity of 0.8 two documents share no bucket with a probability of
(1 - 0.8 ** ROWS) ** (BINS / ROWS), about 1e-6.

The pairs of a bucket are not written out. Its smallest set is the pivot and meets all others; links are
confirmed on the full sets, and components are formed. Buckets of one pivot make a group. Only groups whose
members still lie in several components go on. Those of at most ``GROUP`` members are settled in one task,
by counting shared elements, which gives only the links that join components.

Members of larger groups go through an exact prefix filter, once: elements are ordered by rarity, and of two
linked sets the first n - ceil(0.8 n) + 1 elements share one. So sets that merely have a template in common fall
apart, and what still hangs together by such elements, over several components, is a cluster. Clusters of at most
``GROUP`` members are settled like groups; larger ones are cut into tiles, and each two tiles are settled in one
task, except two tiles of one component. No link that could join two components is lost, however many documents
a group holds; rows are written once per member, element and, in large clusters alone, partner tile.

Defined cases: null and empty texts have an empty set and are linked with nothing; rows that repeat a
``doc_id`` are one document, linked if any of their texts is; a null ``doc_id`` is linked with nothing,
gets a null component and is kept; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, documents, id_and_text, map_batches
from gleaner.llm.components import components
from gleaner.session import write_through

BINS, ROWS = 864, 9
PERCENT = 80

# Members and elements of a group that one task settles.
GROUP, ELEMENTS = 2048, 1 << 22

# Bytes of text that are hashed at once.
CHUNK = 1 << 20

U = np.uint64
EMPTY = U(2**64 - 1)
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = U(pow(int(BASE), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, of: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U) * BASE + U(of))


LETTERS = seeds(256, 1)
PLACES = seeds(64, 2) | U(1)
ROUNDS = seeds(2 * BINS, 3)
BANDS = seeds(BINS // ROWS, 4)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """``BASE ** i`` and its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, BASE)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = INVERSE
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


POWERS = Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of every word; ``data`` must end in a blank."""
    letters = np.frombuffer(data.lower(), np.uint8)
    blank = BLANK[letters]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[::2], edge[1::2]
    up, down = POWERS.upto(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, U)
    np.cumsum(LETTERS[letters] * up[: len(letters)], out=sums[1:])
    words = (sums[end] - sums[begin]) * down[begin]
    return mixed(words + (end - begin).astype(U) * BASE), begin


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    hashes, begin = word_hashes(b"\n".join(texts) + b"\n")
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(begin, ends)
    runs = np.zeros(max(len(hashes) - width + 1, 0), U)
    for k in range(width):
        runs += mixed(hashes[k : k + len(runs)] * PLACES[k])
    out, first = [], 0
    for last in cuts.tolist():
        n = last - first
        if n >= width:
            out.append(np.unique(runs[first : last - width + 1]))
        elif n:
            short = sum((mixed(hashes[first + k : first + k + 1] * PLACES[k]) for k in range(n)), np.zeros(1, U))
            out.append(mixed(short + PLACES[63 - n]))
        else:
            out.append(np.zeros(0, U))
        first = last
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """The bins of a set that is not empty: round number above 48 bits of the least hash."""
    bins = np.full(BINS, EMPTY)
    low = U(2**48 - 1)
    at = 0
    while at < BINS:
        upto = min(BINS, at + max(1, 4000 // len(elements)))
        rounds = np.arange(at, upto, dtype=U)
        x = mixed(elements[:, None] ^ ROUNDS[None, at:upto])
        values = (rounds << U(48))[None, :] | (x & low)
        np.minimum.at(bins, ((x >> U(48)) % U(BINS)).astype(np.int64).ravel(), values.ravel())
        at = upto
        if (bins != EMPTY).all():
            return bins
    for k in np.flatnonzero(bins == EMPTY).tolist():
        bins[k] = (U(BINS + k) << U(48)) | (mixed(elements ^ ROUNDS[BINS + k]) & low).min()
    return bins


def bands(bins: np.ndarray) -> np.ndarray:
    keys = BANDS.copy()
    for column in bins.reshape(-1, ROWS).T:
        keys = mixed(keys ^ column) * BASE
    return keys.view(np.int64)


def chunks(batch: pa.RecordBatch):
    """Rows of a batch in runs of about ``CHUNK`` bytes: first row and the texts."""
    texts, first, size = [], 0, 0
    for i, text in enumerate(batch.column(1).cast(pa.binary())):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= CHUNK:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set (null if empty) and the ``bands``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, texts in chunks(batch):
                sets = shingle_sets(texts, width)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [bands(sketch(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands"])

    schema = "doc_id long, n_shingles long, digest binary, bands array<long>"
    return map_batches(id_and_text(docs), run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id`` and its ``elements``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, texts in chunks(batch):
                sets = shingle_sets(texts, width)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(offsets, values)],
                    ["doc_id", "elements"],
                )

    return map_batches(id_and_text(docs), run, "doc_id long, elements array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough."""
    sides = pairs
    for side in ("a", "b"):
        own = sets.select(F.col("doc_id").alias(side), F.col("elements").alias(f"of_{side}"))
        sides = sides.join(own, side)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - shared
    return sides.filter(percent * either <= 100 * shared).select("a", "b").distinct()


def in_company(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one."""
    size = F.count("*").over(W.partitionBy("bucket"))
    return members.withColumn("size", size).filter("size > 1").drop("size")


def with_links(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """Components with more links; nothing runs where there are none."""
    if found.isEmpty():
        return grouped
    stars = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(found))


def joining_links(sets: list[np.ndarray], component: list[int], percent: int) -> list[tuple[int, int]]:
    """Places of linked sets that join components, as few as do."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[element] > 1
    _, element = np.unique(element[shared], return_inverse=True)
    owner = owner[shared]
    size = np.array([len(x) for x in sets], np.float32)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    step = max(1, (1 << 23) // len(sets))
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, step):
        a, b = np.searchsorted(element, (first, first + step))
        held = np.zeros((len(sets), step), np.float32)
        held[owner[a:b], element[a:b] - first] = 1
        both += held @ held.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    root = {c: c for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    own = np.array(component)
    for i, j in np.argwhere(np.triu(linked & (own[:, None] != own[None, :]), 1)).tolist():
        x, y = find(component[i]), find(component[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def settled(groups: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that join components within groups; ``group``, ``class``, ``component``, ``elements``."""

    def run(batches: Batches) -> Batches:
        now, held = None, []

        def links() -> pa.RecordBatch:
            found = joining_links([h[2] for h in held], [h[1] for h in held], percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())],
                ["a", "b"],
            )

        for batch in batches:
            elements = batch.column(3)
            for k, (group, own, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if group != now and held:
                    yield links()
                    held = []
                now = group
                held.append((own, component, elements[k].values.to_numpy()))
        if held:
            yield links()

    rows = groups.select("group", "class", "component", "elements").repartition("group").sortWithinPartitions("group")
    return map_batches(rows, run, "a long, b long")


def unsettled(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """``group``, ``class``, ``n``, ``component`` of groups that lie in several components, with their ``members`` and ``size``."""
    placed = members.join(grouped.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    sizes = placed.groupBy("group").agg(
        F.count("*").alias("members"), F.sum("n").alias("size"),
        F.min("component").alias("x"), F.max("component").alias("y"),
    )
    return placed.join(sizes.filter("x < y").select("group", "members", "size"), "group")


def clustered(pool: DataFrame, of_class: DataFrame, percent: int) -> DataFrame:
    """``cluster``, ``class``, ``n``, ``component``: what shares a rare element over several components hangs together.

    An element that no other member has comes first in the order of rarity, so only their number is needed.
    """
    rows = pool.join(of_class, "class").select("class", "n", "component", F.explode("elements").alias("element"))
    often = rows.groupBy("element").agg(F.count("*").alias("often")).filter("often > 1")
    shared = rows.join(often, "element").groupBy("class", "n", "component").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("e"))
    own = F.expr(f"n - ceil({percent} * n / 100) + 1 - (n - size(e))").cast("int")
    first = write_through(
        shared.select("class", "component", F.explode(F.slice("e", F.lit(1), F.greatest(own, F.lit(0)))).alias("e")).select(
            "class", "component", "e.element"
        )
    )
    hubs = first.groupBy("element").agg(F.min("class").alias("hub"), F.min("component").alias("x"), F.max("component").alias("y"))
    edges = first.join(hubs.filter("x < y"), "element").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    found = components(edges).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    return pool.join(found, "class").select("cluster", "class", "n", "component")


def dealt(clusters: DataFrame, group: int) -> DataFrame:
    """``group``, ``class``, ``component``: clusters that one task can settle, of others every two tiles.

    A component that fills a tile has tiles of its own, which never meet each other; small ones share tiles.
    """
    by_part = clusters.groupBy("cluster", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    tiles = lambda c, s: F.greatest(F.ceil(F.col(c) / max(group // 2, 1)), F.ceil(F.col(s) / (ELEMENTS // 2)))
    big = (F.col("c") > max(group // 2, 1)) | (F.col("s") > ELEMENTS // 2)
    small = lambda x: F.sum(F.when(F.col("big"), 0).otherwise(F.col(x)))
    whole = (
        by_part.withColumn("big", big)
        .groupBy("cluster")
        .agg(
            F.sum("c").alias("members"), F.sum("s").alias("size"), small("c").alias("c"), small("s").alias("s"),
            F.min("component").alias("x"), F.max("component").alias("y"),
        )
        .filter("x < y")
        .select("cluster", ((F.col("members") <= group) & (F.col("size") <= ELEMENTS)).alias("few"), tiles("c", "s").alias("n_small"))
    )
    parts = by_part.withColumn("big", big).withColumn("n_big", tiles("c", "s")).join(whole, "cluster")
    place = F.when(F.col("few"), 0).when(F.col("big"), F.pmod(F.xxhash64("class"), "n_big")).otherwise(F.pmod(F.xxhash64("component"), "n_small"))
    own = F.struct(
        (F.col("big") & ~F.col("few")).alias("big"),
        F.when(F.col("big") & ~F.col("few"), F.col("component")).otherwise(0).alias("of"),
        place.cast("long").alias("place"),
    )
    rows = clusters.join(parts.select("cluster", "component", "big", "few", "n_big", "n_small"), ["cluster", "component"])
    tiled = write_through(rows.select("cluster", "class", "component", own.alias("tile")))
    each = tiled.select("cluster", "tile").distinct()
    partners = each.join(each.groupBy("cluster").agg(F.collect_set("tile").alias("tiles")), "cluster")
    met = F.expr("filter(tiles, t -> NOT (t.big AND tile.big AND t.of = tile.of))")
    pairs = partners.select("cluster", "tile", F.explode(met).alias("other"))
    key = F.xxhash64("cluster", F.array_sort(F.array("tile", "other")))
    return tiled.join(pairs, ["cluster", "tile"]).select(key.alias("group"), "class", "component")


def near_groups(docs: DataFrame, width: int = 5, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept``, one row for each row of ``docs``."""
    sketched = write_through(sketches(docs, width))
    known = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(
        F.min("doc_id").alias("class"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    buckets = write_through(in_company(classes.select(F.explode("bands").alias("bucket"), "class", "n")))
    asked = buckets.select(F.col("class").alias("doc_id")).distinct()
    sets = write_through(full_sets(docs.join(asked, "doc_id", "left_semi"), width))

    pivots = buckets.groupBy("bucket").agg(F.min(F.struct("n", "class")).alias("p"))
    stars = (
        buckets.join(pivots, "bucket")
        .filter(F.col("class") != F.col("p.class"))
        .select(F.col("p.class").alias("pivot"), "class", "n", F.col("p.n").alias("n_pivot"))
        .distinct()
    )
    stars = write_through(stars)
    near = stars.filter(f"{percent} * n <= 100 * n_pivot")
    found = write_through(confirmed(near.select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct(), sets, percent))
    none = buckets.select(F.col("class").alias("node"), F.col("class").alias("component")).limit(0)
    grouped = with_links(none, found)
    # The pivot itself is linked with all that it can be linked with.
    members = stars.select(F.col("pivot").alias("group"), "class", "n")
    open_groups = write_through(unsettled(members, grouped))
    few = (F.col("members") <= group) & (F.col("size") <= ELEMENTS)
    of_class = sets.select(F.col("doc_id").alias("class"), "elements")
    found = write_through(settled(open_groups.filter(few).join(of_class, "class"), percent))
    grouped = with_links(grouped, found)
    many = open_groups.filter(~few).select("group", "class", "n")
    if not many.isEmpty():
        pool = unsettled(many, grouped).select("class", "n", "component").distinct()
        clusters = write_through(clustered(write_through(pool), of_class, percent))
        found = write_through(settled(dealt(clusters, group).join(of_class, "class"), percent))
        grouped = with_links(grouped, found)

    of_class = known.groupBy("digest").agg(F.min("doc_id").alias("class"))
    of_doc = sketched.join(of_class, "digest", "left").join(grouped.withColumnRenamed("node", "class"), "class", "left")
    component = F.coalesce("component", "class", "doc_id")
    return of_doc.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def without_copies(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of every group, the one of smallest id, and one row of it; rows without an id all stay."""
    gone = near_groups(docs, width, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    named = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(left.filter("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), width=4)


QUERIES = {"op6_minhash_near_dedup": query}
SQL: dict[str, str] = {}
