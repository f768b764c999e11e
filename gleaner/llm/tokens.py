"""Token files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next
chunk of those ids that need one, and so on. A bitmap per level marks the ids that go on, and a rank
directory counts the marks before every block of 512 bits. The chunk of token i on the next level stands
at the rank of i, so any token is read with one lookup a level; nothing before it is decoded.

``write_tokens`` encodes the texts, orders the documents by id in range partitions and writes segments of
about ``SEGMENT`` tokens; a segment is one row of a Parquet table and holds whole documents: the
levels, the ids and lengths of its documents and its place in its partition. A second small table, the
directory, holds the first token of every partition. ``read_documents`` decodes segments, ``tokens_at``
reads single tokens by their global place.

Defined cases: a null text counts as empty and holds only the end id; documents of one ``doc_id`` stand
in the order of their texts; null ids come first; other columns are left out; an empty table gives empty
files. A document of more than ``SEGMENT`` tokens is a segment of its own. Where a special token of the vocabulary
stands literally in a text (``<|endoftext|>``), it gets its own id, as in the library; in other letter case it is text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, Memo, documents, id_and_text, map_batches
from gleaner.session import new_path

SEGMENT = 1 << 18
BLOCK = 512
MEMO = 900_000
LEVEL_TYPE = "array<struct<chunks: binary, marks: binary, ranks: binary>>"
SEGMENTS = f"part int, place int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, levels {LEVEL_TYPE}"


class Level:
    """One level: chunks, and which of them go on."""

    def __init__(self, chunks: bytes, marks: bytes, ranks: bytes):
        self.chunks = np.frombuffer(chunks, np.uint8)
        self.marks = np.frombuffer(marks, np.uint8)
        self.ranks = np.frombuffer(ranks, "<u4")

    def marked(self, at: np.ndarray) -> np.ndarray:
        return (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each place: the directory's count, then the bits of its block."""
        block = at // BLOCK
        count = self.ranks[block].astype(np.int64)
        padded = np.concatenate([self.marks, np.zeros(BLOCK // 8, np.uint8)])
        rows = padded[(block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
        inside = (at % BLOCK)[:, None] - 8 * np.arange(BLOCK // 8)
        masks = ((1 << np.clip(inside, 0, 8)) - 1).astype(np.uint8)
        return count + np.bitwise_count(rows & masks).sum(axis=1, dtype=np.int64)


def pack(ids: np.ndarray) -> list[dict]:
    """The levels of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.cumsum(blocks) - blocks
        levels.append(
            {
                "chunks": (rest & 0xFF).astype(np.uint8).tobytes(),
                "marks": np.packbits(more, bitorder="little").tobytes(),
                "ranks": ranks.astype("<u4").tobytes(),
            }
        )
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def unpack(levels: list[dict]) -> np.ndarray:
    """All ids."""
    below = None
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        if below is not None and len(below):
            marks = np.frombuffer(level["marks"], np.uint8)
            more = np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)
            chunks[more] |= below << np.uint32(8)
        below = chunks
    return below


def at_places(levels: list[dict], places: np.ndarray) -> np.ndarray:
    """Ids at the places, without decoding any other."""
    out = np.zeros(len(places), np.uint32)
    rows, at = np.arange(len(places)), places.astype(np.int64)
    for k, level in enumerate(levels):
        part = Level(level["chunks"], level["marks"], level["ranks"])
        out[rows] |= part.chunks[at].astype(np.uint32) << np.uint32(8 * k)
        more = part.marked(at)
        rows, at = rows[more], part.rank(at[more])
        if not len(rows):
            break
    return out


class Encoder:
    """Whole texts through the tokenizers library, a word at a time.

    No match of the vocabulary's splitting pattern contains white space, and none holds a letter and then
    something else, so words between ASCII blanks, and punctuation after a letter, can be encoded alone.
    Each distinct word is encoded once and kept in a bounded memo. Plain lower-case words need no
    normalizing or splitting and go to the library's model at once; all others through its whole pipeline.
    """

    PUNCTUATION = b".,!?;:|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        # Special tokens are cut out of the raw text, before anything else; what lies between them holds none.
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("only plain special tokens are known")
        self.special = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")").split if longest else lambda text: [text]
        # What all of them begin with, which few texts hold.
        self.mark = commonprefix(longest)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.of_word = Memo(self._word, MEMO)

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(self.PUNCTUATION)
        text = core.decode()
        if text.isalpha() and max(text) < "ɐ" and text == text.lower() and unicodedata.is_normalized("NFC", text):
            if len(core) < len(word):
                return self.of_word[core] + self.of_word[word[len(core) :]]
            if len(core) < 200:
                tokens = self.model.tokenize(core.decode("latin-1").translate(self.letters))
                return np.array([t.id for t in tokens], "<u4").tobytes()
        ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special or self.mark not in text:
            return self._part(text)
        parts = self.cut(text)
        return b"".join([self.special[p] if k % 2 else self._part(p) for k, p in enumerate(parts)])

    def _part(self, text: bytes) -> bytes:
        return b"".join(map(self.of_word.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Read once per worker; ``path`` must be readable there."""
    return Encoder(path)


def _segment(part: int, place: int, first: int, docs: list, ids: list[bytes]) -> dict:
    lengths = [len(x) // 4 for x in ids]
    levels = pack(np.frombuffer(b"".join(ids), "<u4"))
    return {
        "part": part, "place": place, "first": first, "n_tokens": sum(lengths),
        "doc_ids": docs, "lengths": lengths, "levels": levels,
    }


def segments(docs: DataFrame, path: str, end_id: int, size: int = SEGMENT) -> DataFrame:
    """Rows of the segment table, by ascending document within ascending partitions."""
    ordered = (
        id_and_text(docs)
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    level = pa.struct([("chunks", pa.binary()), ("marks", pa.binary()), ("ranks", pa.binary())])
    schema = pa.schema(
        [("part", pa.int32()), ("place", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64())]
        + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("levels", pa.list_(level))]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part = place = first = held = 0
        doc_ids, ids = [], []
        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                row = own.encode(text.as_py()) + end
                if ids and held + len(row) > 4 * size:
                    yield pa.RecordBatch.from_pylist([_segment(part, place, first, doc_ids, ids)], schema)
                    place, first, held, doc_ids, ids = place + 1, first + held // 4, 0, [], []
                doc_ids.append(doc.as_py())
                ids.append(row)
                held += len(row)
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(part, place, first, doc_ids, ids)], schema)

    return map_batches(ordered, run, SEGMENTS)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, size: int = SEGMENT) -> None:
    """Write the segment table and the directory below ``folder``.

    Partition totals are added up in two steps, groups of 1,024 partitions and then the groups, so that
    no task sees more than that many rows per million partitions.
    """
    spark = docs.sparkSession
    table = segments(docs, path, end_id, size)
    table.write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/segments")
    totals = read_segments(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    grouped = totals.withColumn("wide", F.floor(F.col("part") / 1024))
    inside = W.partitionBy("wide").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    groups = grouped.groupBy("wide").agg(F.sum("n").alias("all"))
    earlier = W.orderBy("wide").rowsBetween(W.unboundedPreceding, -1)
    starts = groups.select("wide", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    (
        grouped.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, "wide")
        .select("part", (F.col("base") + F.col("own")).alias("start"))
        .write.mode("overwrite")
        .parquet(f"{folder}/directory")
    )


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, start long").parquet(f"{folder}/directory")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of every document."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["levels"]).astype("<u4").tobytes()
                cuts = np.concatenate(([0], np.cumsum(row["lengths"])))
                places = cuts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(cuts[:-1] + row["first"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(places, places[1:])], pa.binary()),
                    ],
                    ["part", "doc_id", "first", "n_tokens", "ids"],
                )

    schema = "part int, doc_id long, first long, n_tokens long, ids binary"
    docs = map_batches(read_segments(spark, folder).drop("place", "n_tokens"), run, schema)
    return docs.join(read_directory(spark, folder), "part").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids"
    )


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``token`` and ``id`` for every ``token`` (global place) of ``wanted``; places outside give no row.

    Segments and wanted places meet on spans of ``SEGMENT`` places; a segment's places are looked up
    directly in its levels. Places are asked for in blocks of 4,096 at most per row.
    """
    table = read_segments(spark, folder).join(read_directory(spark, folder), "part")
    begin = F.col("start") + F.col("first")
    spans = F.sequence(F.floor(begin / SEGMENT), F.floor((begin + F.col("n_tokens") - 1) / SEGMENT))
    spread = table.select(begin.alias("begin"), "n_tokens", "levels", F.explode(spans).alias("span"))
    asked = (
        wanted.select(F.col("token").cast("long").alias("token")).distinct()
        .withColumn("span", F.floor(F.col("token") / SEGMENT))
        .groupBy("span", F.floor(F.col("token") / 4096).alias("block"))
        .agg(F.collect_list("token").alias("tokens"))
    )
    met = spread.join(asked, "span")
    inside = F.expr("filter(tokens, t -> t >= begin AND t < begin + n_tokens)")
    rows = met.select("begin", "levels", inside.alias("tokens")).filter(F.size("tokens") > 0)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                places = np.array(row["tokens"], np.int64)
                ids = at_places(row["levels"], places - row["begin"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array(ids.astype(np.int64))], ["token", "id"]
                )

    return map_batches(rows, run, "token long, id long")


def end_and_path() -> tuple[str, int]:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, end_id = end_and_path()
    folder = new_path(spark)
    write_tokens(documents(spark, sf_dir), folder, path, end_id)
    return read_documents(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {"op1_token_files": query}
SQL: dict[str, str] = {}
