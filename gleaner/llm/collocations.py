"""Phrase collocation mining by direct-address tiling.

Words get ids by frequency, so counts of pairs of frequent words crowd into a few square tiles of the table
(left id, right id). A task holds the tiles where many pairs are expected as dense arrays, addressed directly
and counted with ``bincount``; all other tiles as coordinates, sorted and added up (COO). Frequent pairs are then
ranked by frequency themselves and, as left ids, counted against the word that follows: the same tiles again.

1. Words are counted per language. The ``HEAD`` most frequent ones of at most ``BYTES`` bytes have ids; this table is
   bounded and goes to every worker. Other words keep their text.
2. Pairs of words that stand ``LEAST`` times or more, as ids in tiles or as text, are counted over all tasks.
3. The ``UNITS`` most frequent pairs of ids have ids of their own; triples are counted.

What else is frequent is known to the workers by a bitmap of ``BITS`` bits: words and pairs outside of it are rare for
certain and are left out early, those inside are counted, and the exact counts decide. So a large vocabulary costs
time, never a phrase. Counts go through one shuffle per level, on the phrase, after they were added up per task.

Counts of the parts of a phrase are joined by broadcast for parts in the bounded head, by shuffle for all others, which
are rare by definition; so no frequent part meets in one task. Scores are exact, in decimals of 38 digits.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; other columns
are left out; an empty table gives an empty result. Phrases of equal score are ordered by count, then by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, documents, map_batches, whole_text
from gleaner.session import write_through

LEAST = 10
BEST = 2000
HELD_BY_LONGER = 50

# Words and pairs with ids, and the longest text of such a word (and name of its language).
HEAD, UNITS, BYTES = 1 << 16, 1 << 17, 64
SHIFT = 20
MASK = (1 << SHIFT) - 1
BITS = 1 << 25

# Ids on a side of a tile, and dense tiles of a task.
TILE, DENSE = 256, 16

# Bytes of text of one language that are counted at once, and coordinates that a task holds.
CHUNK = 1 << 20
HELD = 1 << 18

# Fixed values of the definition: blanks between words, ends of pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def by_language(batches: Batches) -> Iterator[tuple[str, bytes]]:
    """Texts of a language, lower-cased and joined by an end of piece, in runs of about ``CHUNK`` bytes."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = text.as_py()
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data) + 1
            full = [lang] if sizes[lang] >= CHUNK else list(held) if sum(sizes.values()) >= 4 * CHUNK else []
            for own in full:
                del sizes[own]
                yield own, b"\n".join(held.pop(own)).lower()
    for own in list(held):
        yield own, b"\n".join(held.pop(own)).lower()


def tokens(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word of every token, and whether a token and the one after it stand in one piece."""
    letters = np.frombuffer(data, np.uint8)
    kind = KIND[letters]
    inside = np.zeros(len(kind) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, bool)
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside[1:-1]])])
    coded = words.dictionary_encode()
    ends = np.cumsum(kind == 2, dtype=np.int32)[begin]
    return coded.dictionary, coded.indices.to_numpy(), ends[1:] == ends[:-1]


def words_of(docs: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (a word; null: all of them) and ``n``, how often it stands in a run of texts."""

    def run(batches: Batches) -> Batches:
        for lang, data in by_language(batches):
            distinct, token, _ = tokens(data)
            n = np.append(np.bincount(token, minlength=len(distinct)), len(token))
            phrases = pa.concat_arrays([distinct.cast(pa.string()), pa.array([None], pa.string())])
            yield from rows({"lang": pa.repeat(lang, len(n)), "phrase": phrases, "n": pa.array(n, pa.int64())})

    return map_batches(docs, run, "lang string, phrase string, n long")


def rows(columns: dict) -> Batches:
    n = len(columns["n"])
    for at in range(0, n, 50_000):
        yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns.values()], list(columns))


@dataclass
class Side:
    """Ids of one language by rank: their ``codes`` and counts."""

    codes: np.ndarray
    counts: np.ndarray

    def mass(self) -> np.ndarray:
        return np.add.reduceat(self.counts.astype(float), np.arange(0, len(self.counts), TILE)) if len(self.counts) else np.zeros(0)


@dataclass
class Level:
    """What a worker needs to count phrases of ``width`` words; bounded, whatever the documents hold."""

    width: int
    words: dict[str, dict[bytes, int]]  # id by word
    rank: np.ndarray  # by id: rank in its language
    right: dict[str, Side]
    left: dict[str, Side]
    frequent: np.ndarray  # bitmap of words
    pairs: np.ndarray | None = None  # bitmap of pairs
    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # codes of pairs with an id, ascending
    unit_rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    slots: dict[str, np.ndarray] = field(default_factory=dict)  # by tile: place among the dense ones, or -1

    def choose(self) -> Level:
        """The tiles that hold most pairs by the frequency of their sides, if that is a pair per cell or more."""
        found = []
        for lang, left in self.left.items():
            a, b = left.mass(), self.right[lang].mass()
            expected = np.outer(a, b) / max(self.right[lang].counts.sum(), 1)
            self.slots[lang] = np.full(expected.shape, -1, np.int32)
            best = np.argsort(expected, axis=None)[::-1][:DENSE]
            found += [(expected.flat[k], lang, k) for k in best.tolist() if expected.flat[k] >= TILE * TILE]
        places: dict[str, int] = {}
        for _, lang, k in sorted(found, reverse=True)[:DENSE]:
            self.slots[lang].flat[k] = places.setdefault(lang, 0)
            places[lang] += 1
        return self


def marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their sums."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(n, starts) if len(starts) else n


class Counter:
    """Dense tiles and sorted coordinates of one task."""

    def __init__(self, level: Level):
        self.level = level
        self.dense = {lang: np.zeros((s.max() + 1) * TILE * TILE, np.int64) for lang, s in level.slots.items() if (s >= 0).any()}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, lang: str, left: np.ndarray, left_rank: np.ndarray, right: np.ndarray) -> Batches:
        """Phrases of a left code (its rank, or -1) and a right word id."""
        if lang in self.dense:
            rank = self.level.rank[right]
            slot = np.where(left_rank >= 0, self.level.slots[lang][left_rank // TILE, rank // TILE], -1)
            at = slot >= 0
            cell = (slot[at].astype(np.int64) * TILE + left_rank[at] % TILE) * TILE + rank[at] % TILE
            self.dense[lang] += np.bincount(cell, minlength=len(self.dense[lang]))
            left, right = left[~at], right[~at]
        codes, n = np.unique(left << SHIFT | right, return_counts=True)
        self.parts.append((codes, n))
        self.size += len(codes)
        if self.size > HELD:
            self.parts = [added(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
            if self.size > HELD // 2:
                yield from self.sparse()

    def sparse(self) -> Batches:
        if self.parts:
            codes, n = added(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.size = [], 0
            yield from coded(codes, n)

    def all(self) -> Batches:
        yield from self.sparse()
        for lang, counts in self.dense.items():
            slots = self.level.slots[lang]
            tiles = np.zeros((slots.max() + 1, 2), np.int64)
            tiles[slots[slots >= 0]] = np.argwhere(slots >= 0)
            cell = np.flatnonzero(counts)
            tile = tiles[cell // TILE**2]
            left = self.level.left[lang].codes[tile[:, 0] * TILE + cell // TILE % TILE]
            right = self.level.right[lang].codes[tile[:, 1] * TILE + cell % TILE]
            yield from coded(left << SHIFT | right, counts[cell])


def coded(codes: np.ndarray, n: np.ndarray) -> Batches:
    none = pa.nulls(len(codes), pa.string())
    yield from rows({"code": pa.array(codes, pa.int64()), "lang": none, "phrase": none, "n": pa.array(n, pa.int64())})


def spelled(lang: str, distinct: pa.Array, places: list[np.ndarray]) -> Batches:
    """Phrases by their text; ``places`` holds the words of each."""
    key = places[0].astype(np.int64)
    for place in places[1:]:
        # Renumbered in between, so that keys stay below the number of tokens times that of words.
        key = np.unique(key, return_inverse=True)[1] * len(distinct) + place
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    words = [distinct.take(pa.array(p[first])).cast(pa.string()) for p in places]
    phrase = pc.binary_join_element_wise(*words, " ")
    yield from rows({"code": pa.nulls(len(n), pa.int64()), "lang": pa.repeat(lang, len(n)), "phrase": phrase, "n": pa.array(n, pa.int64())})


def phrases_of(docs: DataFrame, level: Level) -> DataFrame:
    """Counts per task: ``code`` (ids of the words) or ``lang`` and ``phrase``, and ``n``."""
    k = level.width

    def run(batches: Batches) -> Batches:
        counter = Counter(level)
        for lang, data in by_language(batches):
            distinct, token, together = tokens(data)
            if len(token) < k:
                continue
            ids, seed = level.words.get(lang, {}), crc32(lang.encode())
            texts = distinct.to_pylist()
            hashed = np.array([crc32(w, seed) for w in texts], np.int64)
            own = np.array([ids.get(w, -1) for w in texts], np.int64)
            # -1: rare for certain, -2: maybe not.
            own[(own < 0) & marked(level.frequent, hashed % BITS)] = -2
            word = own[token]
            at = np.ones(len(token) - k + 1, bool)
            for j in range(k):
                at &= word[j : len(word) - k + 1 + j] != -1
            for j in range(k - 1):
                at &= together[j : len(together) - k + 2 + j]
            at = np.flatnonzero(at)
            left, rank = word[at], None
            if k == 3:
                sums = [hashed[token[at + j]] * 1000003 + hashed[token[at + j + 1]] for j in (0, 1)]
                ok = marked(level.pairs, sums[0] % BITS) & marked(level.pairs, sums[1] % BITS)
                at = at[ok]
                left = word[at] << SHIFT | word[at + 1]
            known = np.ones(len(at), bool)
            for j in range(k):
                known &= word[at + j] >= 0
            code, right = left[known], word[at[known] + k - 1]
            if k == 2:
                rank = level.rank[code]
            else:
                place = np.minimum(np.searchsorted(level.units, code), max(len(level.units) - 1, 0))
                rank = np.where(level.units[place] == code, level.unit_rank[place], -1) if len(level.units) else np.full(len(code), -1)
            yield from counter.add(lang, code, rank, right)
            if not known.all():
                yield from spelled(lang, distinct, [token[at[~known] + j] for j in range(k)])
        yield from counter.all()

    return map_batches(docs, run, "code long, lang string, phrase string, n long")


def bitmap(places: DataFrame) -> np.ndarray:
    """The bits at ``place``: ``BITS`` of them reach the driver, in pieces of 4 KiB."""
    found = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits")
    )
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in found.toLocalIterator():
        out[r.piece - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def place_of(*words: Column) -> Column:
    """The place of a word, or of a pair, in the bitmap; workers compute the same."""
    at = [F.crc32(F.concat("lang", w)) for w in words]
    return (at[0] if len(at) == 1 else at[0] * 1000003 + at[1]) % BITS


def sides(langs: list[str], codes: np.ndarray, counts: np.ndarray) -> tuple[dict[str, Side], np.ndarray]:
    """Ids in the order of their frequency, dealt by language, and the rank of each there."""
    rank = np.zeros(len(codes), np.int32)
    out = {}
    own = np.array(langs, object)
    for lang in dict.fromkeys(langs):
        at = np.flatnonzero(own == lang)
        rank[at] = np.arange(len(at))
        out[lang] = Side(codes[at], counts[at])
    return out, rank


def decoded(found: DataFrame, langs: list[str], words: list[str], width: int) -> DataFrame:
    """``code``, ``lang``, ``phrase``, ``n`` with all phrases spelled out; ids are places in the bounded head."""

    def run(batches: Batches) -> Batches:
        of_lang, of_word = pa.array(langs, pa.string()), pa.array(words, pa.string())
        for batch in batches:
            ids = [pc.bit_wise_and(pc.shift_right(batch.column(0), SHIFT * j), MASK) for j in reversed(range(width))]
            phrase = pc.binary_join_element_wise(*[of_word.take(i) for i in ids], " ")
            lang = pc.coalesce(batch.column(1), of_lang.take(ids[0]))
            columns = [batch.column(0), lang, pc.coalesce(batch.column(2), phrase), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["code", "lang", "phrase", "n"])

    return map_batches(found.select("code", "lang", "phrase", "n"), run, "code long, lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written: words (and, of phrase null, all of them), pairs and triples that stand ``least`` times, and the head."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    of_word = words_of(texts).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = write_through(of_word.filter((F.col("n") >= least) | F.col("phrase").isNull()))
    short = (F.octet_length("phrase") <= BYTES) & (F.octet_length("lang") <= BYTES)
    head = words.filter(short).orderBy(F.desc("n"), "lang", "phrase").limit(HEAD).collect()
    langs, names, counts = [r.lang for r in head], [r.phrase for r in head], np.array([r.n for r in head], np.int64)
    right, rank = sides(langs, np.arange(len(head)), counts)
    ids: dict[str, dict[bytes, int]] = {}
    for i, r in enumerate(head):
        ids.setdefault(r.lang, {})[r.phrase.encode()] = i
    schema = "id long, lang string, phrase string, n long"
    named = spark.createDataFrame([(i, r.lang, r.phrase, r.n) for i, r in enumerate(head)], schema)

    frequent = bitmap(words.filter("phrase IS NOT NULL").select(place_of(F.col("phrase")).alias("place")))
    level = Level(2, ids, rank, right, right, frequent).choose()
    total = lambda level: (
        phrases_of(texts, level).groupBy("code", "lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    )
    pairs = write_through(decoded(total(level), langs, names, 2))

    two = F.split("phrase", " ")
    marks = bitmap(pairs.select(place_of(two[0], two[1]).alias("place")))
    best = pairs.filter("code IS NOT NULL").orderBy(F.desc("n"), "code").limit(UNITS).select("code", "n").toArrow()
    codes, n = best.column(0).to_numpy(), best.column(1).to_numpy()
    left, unit_rank = sides([langs[i] for i in (codes & MASK).tolist()], codes, n)
    order = np.argsort(codes)
    of_units = {"units": codes[order], "unit_rank": unit_rank[order]}
    level = Level(3, ids, rank, {x: right[x] for x in left}, left, frequent, marks, **of_units).choose()
    triples = write_through(decoded(total(level), langs, names, 3))
    return words, pairs, triples, named


def parts_counted(asked: DataFrame, counts: DataFrame, head: DataFrame) -> DataFrame:
    """``asked`` (``lang``, ``part``, ...) with ``f``, the count of the part."""
    known = F.broadcast(head.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    rest = asked.join(known, ["lang", "part"], "left_anti")
    others = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    return asked.join(known, ["lang", "part"]).unionByName(rest.join(others, ["lang", "part"]))


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, percent: int = HELD_BY_LONGER) -> DataFrame:
    """The ``best`` phrases of two and three words of each language, by the score of their weakest cut."""
    words, pairs, triples, head = frequent_phrases(docs, least)
    two = pairs.select("lang", "phrase", "n", F.split("phrase", " ").alias("w"))
    three = triples.select("lang", "phrase", "n", F.split("phrase", " ").alias("w"))
    inner = three.select("lang", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"), "n")
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = two.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {percent} * n").drop("longer")

    def cut(k: int, n: int) -> list[Column]:
        join = lambda a, b: F.array_join(F.slice("w", a, b), " ")
        return [F.struct(F.lit(f"{side}{k}").alias("side"), join(a, b).alias("part")) for side, a, b in (("l", 1, k), ("r", k + 1, n - k))]

    asked = alone.select("lang", "phrase", "n", F.explode(F.array(*cut(1, 2))).alias("c")).unionByName(
        three.select("lang", "phrase", "n", F.explode(F.array(*cut(1, 3), *cut(2, 3))).alias("c"))
    )
    counts = words.filter("phrase IS NOT NULL").unionByName(pairs.select("lang", "phrase", "n"))
    met = parts_counted(asked.select("lang", "phrase", F.col("n").alias("a"), "c.side", "c.part"), counts, head)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    cuts = met.groupBy("lang", "phrase", "a").agg(*[of(s) for s in ("l1", "r1", "l2", "r2")])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    for k in (1, 2):
        cuts = cuts.withColumn(f"_p{k}", big(f"l{k}") * big(f"r{k}")).withColumn("_q", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"))
        cuts = cuts.withColumn(f"s{k}", F.expr(f"_q div _p{k}"))
    weakest = F.when(F.col("s2") < F.col("s1"), F.struct("l2", "r2", "s2")).otherwise(F.struct(*[F.col(c + "1").alias(c + "2") for c in "lrs"]))
    scored = cuts.select("lang", "phrase", "a", weakest.alias("c")).select("lang", "phrase", "a", F.col("c.l2").alias("l"), F.col("c.r2").alias("r"), F.col("c.s2").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
    sizes = words.filter("phrase IS NULL").select("lang", "n")
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = rf"""
WITH split AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents
), runs AS (
    SELECT lang, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase
    FROM split
), f AS (SELECT lang, phrase, count(*) AS f FROM runs GROUP BY lang, phrase
), sizes AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), found AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= {LEAST} AND contains(phrase, ' ')
), cuts AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM (
        SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, len(w))) AS k FROM found)
    ) c
    JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_pairs AS (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM found WHERE len(w) = 3
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_pairs GROUP BY lang, phrase
), ranked AS (
    SELECT c.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM weakest c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {HELD_BY_LONGER} * a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= {BEST}
"""

QUERIES = {"op12_phrase_tiles": query}
SQL = {"op12_phrase_tiles": ORACLE}
