"""Language-model scoring by cross-entropy difference.

Two bigram models with one vocabulary and one smoothing are matched: one of the target (documents that
``labels`` calls good), one of the background (all documents). A document's score is the mean over its
tokens of the background's loss minus the target's, in nats: the higher, the more like the target.

The vocabulary is that of the documents. Words and pairs of a word and its follower are named by hashes of 63
bits, the last bit of the name tells the two apart; the same in both models. Counts are taken over all documents.

Texts are written once, in blocks of bounded size. A block sends each of its distinct types once, in order, with
their counts in the block, to the parts of the range of hashes; there are as many parts as the texts have multiples
of ``PART`` bytes, and a part adds up what the blocks sent. It answers each block with the whole counts in the order
of what the block sent, so answers hold no names. The block's texts meet the answers and are scored there. A type
travels once for each block that holds it, however often it stands there, and no row per document and type exists.
The driver holds a row of totals.

The probability of a word w after v is (c(v, w) + M p(w)) / (c(v) + M) with Dirichlet weight M, where
p(w) = (c(w) + 1) / (n + types). There are as many types as distinct words, but ``2 ** WORD_BITS`` at least.
A text starts after the type of the empty word. c(v) is how often v stands before a token: as often as it stands
anywhere, less the texts that it ends. Losses are added up in units of ``UNIT``, so in any order alike.

Defined cases: null and empty texts have no tokens and the score 0; repeated rows are scored and counted
each on their own; documents without a label, or with several, count as target if one calls them good;
other columns are left out; without target documents the target model is uniform but for smoothing; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, documents, id_and_text, map_batches
from gleaner.llm.minhash import CHUNK, U, mixed, word_hashes
from gleaner.session import write_through

WORD_BITS = 17
WEIGHT = 50.0
START = mixed(np.array([7], U))
UNIT = 2.0**-30

# A block ends with the text that reaches this many bytes, or with this many texts.
BLOCK = 1 << 23
TEXTS = 1 << 16

# Bytes of text for which there is a part of the range of hashes. Messages are as many as blocks times parts, so the
# larger both are, the fewer; a part's types are in memory at once.
PART = 1 << 24

# Bytes of messages after which a worker gives them on.
BATCH = 1 << 22

COUNTS = ("n_all", "n_target", "ends_all", "ends_target")


def types_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word type (even) and pair type (odd) of every token, and where each text's tokens end."""
    hashes, begin = word_hashes(b"\n".join(texts) + b"\n")
    ends = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
    before = np.concatenate((START, hashes[:-1]))[: len(hashes)]
    firsts = np.concatenate(([0], ends[:-1]))
    before[firsts[firsts < ends]] = START
    pairs = mixed(before * U(0x9E3779B97F4A7C15) + hashes)
    return (hashes & ~U(1)).view(np.int64), (pairs | U(1)).view(np.int64), ends


def types_in_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``types_of``, worked out for about ``CHUNK`` bytes of text at once, which bounds the memory of the letters' hashes."""
    found, cuts, size = [types_of([])], [0], 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or i + 1 == len(texts):
            found.append(types_of(texts[cuts[-1] : i + 1]))
            cuts.append(i + 1)
            size = 0
    before = np.cumsum([0, *[len(words) for words, _, _ in found[:-1]]])
    words, pairs, ends = zip(*found, strict=True)
    return np.concatenate(words), np.concatenate(pairs), np.concatenate([e + b for e, b in zip(ends, before, strict=True)])


def previous(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Type of the word before each token."""
    start = (START & ~U(1)).view(np.int64)
    before = np.concatenate((start, words[:-1]))[: len(words)]
    firsts = np.concatenate(([0], ends[:-1]))
    before[firsts[firsts < ends]] = start
    return before


def packed(values: np.ndarray) -> bytes:
    """Their number, then their bytes, those of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(n)


def steps(keys: np.ndarray) -> np.ndarray:
    """Rising numbers as differences; ``np.cumsum`` is the way back."""
    return np.diff(keys, prepend=U(0))


def blocks(docs: DataFrame) -> DataFrame:
    """Written blocks: ``block``, its ``ids``, the lengths of its texts in bytes, the texts and their ``size``."""
    names = ["block", "ids", "lengths", "texts", "size"]

    def row(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        data = b"".join(texts)
        values = [block, ids, packed(np.array([len(t) for t in texts], np.int64)), packed(np.frombuffer(data, np.uint8)), len(data)]
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches: Batches) -> Batches:
        block, size = TaskContext.get().partitionId() << 32, 0
        ids, texts = [], []
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BLOCK or len(texts) >= TEXTS:
                    yield row(block, ids, texts)
                    block, size, ids, texts = block + 1, 0, [], []
        if texts:
            yield row(block, ids, texts)

    return write_through(map_batches(id_and_text(docs), run, "block long, ids array<long>, lengths binary, texts binary, size long"))


def texts_of(lengths: bytes, texts: bytes) -> list[bytes]:
    data, cuts = unpacked(texts, np.uint8).tobytes(), np.cumsum(unpacked(lengths, np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def train(docs: DataFrame, good: DataFrame) -> tuple[DataFrame]:
    """The blocks to count, with the ``places`` of the target's texts in them; ``good`` holds the ``doc_id`` of the target."""
    found = blocks(docs)
    # Labels grow with the documents, so they are never broadcast: one plan at every size.
    flags = good.select(F.col("doc_id").alias("_good")).distinct().hint("merge")
    each = found.select("block", F.posexplode("ids").alias("place", "doc_id"))
    places = each.join(flags, F.col("doc_id") == F.col("_good")).groupBy("block").agg(F.collect_list("place").alias("places"))
    return (found.join(places, "block", "left"),)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> U(32)) * U(parts) >> U(32)


def summed(keys: np.ndarray, sums: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of every key among them, and sums by key."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[starts], place, [np.add.reduceat(s[order], starts, dtype=s.dtype) if len(starts) else s for s in sums]


def messages(found: DataFrame, parts: int, counts: bool, asks: bool) -> DataFrame:
    """What the blocks send: ``part``, ``block``, whether it ``asks``, the types and, if it ``counts``, their counts in it.

    ``ends_all`` and ``ends_target``, the texts that end with a word, hold numbers for words alone.
    """
    names = ["part", "block", "asks", "keys", *COUNTS]
    types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]

    def of_block(block: int, texts: list[bytes], places: list[int]) -> Iterator[tuple]:
        words, pairs, ends = types_in_runs(texts)
        keys = np.concatenate((words, pairs)).view(U)
        if not counts:
            keys, sums = np.unique(keys), []
        else:
            lengths = np.diff(ends, prepend=0)
            good = np.zeros(len(texts), np.uint32)
            good[places] = 1
            last = np.zeros(len(words), np.uint32)
            last[ends[lengths > 0] - 1] = 1
            target, none = np.repeat(good, lengths), np.zeros(len(words), np.uint32)
            each = (np.ones(len(keys), np.uint32), np.concatenate((target, target)), np.concatenate((last, none)), np.concatenate((last * target, none)))
            keys, _, sums = summed(keys, each)
        is_word = keys & U(1) == 0
        cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=U))
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[part], cuts[part + 1])
            seen = [packed(s[some] if i < 2 else s[some][is_word[some]]) for i, s in enumerate(sums)] or [None] * 4
            yield part, block, asks, packed(steps(keys[some])), *seen

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block, lengths, texts, places in zip(*batch.columns, strict=True):
                sent = of_block(block.as_py(), texts_of(lengths.as_py(), texts.as_py()), places.as_py() or [])
                yield from batches_of(sent, names, types)

    places = F.col("places") if "places" in found.columns else F.lit(None).cast("array<int>").alias("places")
    schema = "part int, block long, asks boolean, keys binary, " + ", ".join(f"{c} binary" for c in COUNTS)
    return map_batches(found.select("block", "lengths", "texts", places), run, schema)


def batches_of(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Batches:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def answers(sent: DataFrame) -> DataFrame:
    """Written answers: ``block``, ``part`` and the whole counts, in the order of the types that the block sent there.

    For each part there is a row without a block that holds the part's totals: ``types`` that are counted
    words, tokens and texts with tokens of both models.
    """
    totals = ["types", "tokens_all", "tokens_target", "starts_all", "starts_target"]
    names = ["block", "part", *COUNTS, *totals]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 5]

    def of_part(part: int, rows: list[tuple]) -> Iterator[tuple]:
        asked = [np.cumsum(unpacked(r[2], U)) for r in rows]
        keys = np.concatenate(asked)
        is_word = keys & U(1) == 0
        sums = [np.zeros(len(keys), np.int64) for _ in COUNTS]
        at = 0
        for own, (_, _, _, *seen) in zip(asked, rows, strict=True):
            if seen[0] is not None:
                some = slice(at, at + len(own))
                for i, s in enumerate(seen):
                    sums[i][some if i < 2 else np.flatnonzero(is_word[some]) + at] = unpacked(s, np.uint32)
            at += len(own)
        keys, place, sums = summed(keys, sums)
        word = keys & U(1) == 0
        whole = [int(np.count_nonzero(sums[0][word])), *[int(s[word].sum()) for s in sums]]
        yield None, part, *[None] * 4, *whole
        at = 0
        for own, (block, asks, *_) in zip(asked, rows, strict=True):
            if asks:
                mine = place[at : at + len(own)]
                of_words = mine[own & U(1) == 0]
                yield block, part, *[packed(s[mine if i < 2 else of_words]) for i, s in enumerate(sums)], *[None] * 5
            at += len(own)

    def run(batches: Batches) -> Batches:
        for part, rows in grouped(batches):
            yield from batches_of(of_part(part, rows), names, types)

    schema = "block long, part int, " + ", ".join([f"{c} binary" for c in COUNTS] + [f"{c} long" for c in totals])
    return write_through(map_batches(sent.repartition("part").sortWithinPartitions("part", "block"), run, schema))


def grouped(batches: Batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal first column, which stand together: that column and the others."""
    key, held = None, []
    for batch in batches:
        for first, *rest in zip(*batch.columns, strict=True):
            if held and first.as_py() != key:
                yield key, held
                held = []
            key = first.as_py()
            held.append(tuple(x.as_py() for x in rest))
    if held:
        yield key, held


def with_answers(found: DataFrame, answered: DataFrame, totals: Row) -> DataFrame:
    """The documents of the blocks with their number of tokens and their losses in both models."""
    models = ("target", "all")
    size = {m: totals[f"tokens_{m}"] + max(totals["types"], 1 << WORD_BITS) for m in models}
    starts = {m: totals[f"starts_{m}"] for m in models}
    names = ["doc_id", "n_tokens", *[f"loss_{m}" for m in models]]

    def of_block(rows: list[tuple]) -> pa.RecordBatch:
        _, ids, lengths, texts, *_ = rows[0]
        words, pairs, ends = types_in_runs(texts_of(lengths, texts))
        keys, place = np.unique(np.concatenate((words, pairs)).view(U), return_inverse=True)
        own, pair = place[: len(words)], place[len(words) :]
        parts = np.concatenate(([0], ends))
        columns = [pa.array(ids, pa.int64()), pa.array(np.diff(parts))]
        firsts = parts[:-1][np.diff(parts) > 0]
        for m in models:
            get = lambda c: np.concatenate([np.zeros(0, np.int64), *[unpacked(r[4 + COUNTS.index(c)], np.int64) for r in rows[1:]]])
            n, after = get(f"n_{m}"), np.zeros(len(keys), np.int64)
            is_word = keys & U(1) == 0
            after[is_word] = n[is_word] - get(f"ends_{m}")
            seen = np.roll(after[own], 1)
            seen[firsts] = starts[m]
            loss = np.log(seen + WEIGHT) - np.log(n[pair] + WEIGHT * (n[own] + 1) / size[m])
            sums = np.concatenate(([0], np.cumsum(np.rint(loss / UNIT).astype(np.int64))))
            columns.append(pa.array(np.diff(sums[parts])))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Batches) -> Batches:
        for _, rows in grouped(batches):
            yield of_block(rows)

    none = lambda kind, *columns: [F.lit(None).cast(kind).alias(c) for c in columns]
    texts = found.select("block", F.lit(-1).alias("part"), "ids", "lengths", "texts", *none("binary", *COUNTS))
    counts = answered.filter("block IS NOT NULL").select(
        "block", "part", *none("array<long>", "ids"), *none("binary", "lengths", "texts"), *COUNTS
    )
    together = texts.unionByName(counts).repartition("block").sortWithinPartitions("block", "part")
    return map_batches(together, run, "doc_id long, n_tokens long, loss_target long, loss_all long")


def scored(docs: DataFrame | None, counted: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, mean losses of both models, and ``score``, their difference.

    Without ``docs`` the documents that are counted are scored, and their types travel once for both.
    """
    asking = counted if docs is None else blocks(docs)
    tables = [counted] if docs is None else [counted, asking]
    n_bytes = sum(t.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for t in tables)
    parts = max(-(-n_bytes // PART), 1)
    sent = messages(counted, parts, True, docs is None)
    if docs is not None:
        sent = sent.unionByName(messages(asking, parts, False, True))
    answered = answers(sent)
    names = ["types", *[f"{c}_{m}" for c in ("tokens", "starts") for m in ("target", "all")]]
    totals = answered.filter("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    n = F.col("n_tokens")
    mean = {m: F.when(n > 0, F.col(f"loss_{m}") * F.lit(UNIT) / n).otherwise(F.lit(0.0)) for m in ("target", "all")}
    return with_answers(asking, answered, totals).select(
        "doc_id",
        "n_tokens",
        F.round(mean["target"], 6).alias("target_loss"),
        F.round(mean["all"], 6).alias("background_loss"),
        F.round(mean["all"] - mean["target"], 6).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return scored(None, *train(docs, good))


QUERIES = {"op8_entropy_difference": query}
SQL: dict[str, str] = {}
