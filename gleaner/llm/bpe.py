"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

The next merge is always that of lowest rank. Every rank has a bucket of the list positions where its pair
starts; a bitmap of two levels marks the ranks that have any, and find-first-set on each level gives the next one.
Merges relink neighbours of a linked list; entries of pairs that no longer exist stay in their buckets and are skipped
when they come up. The pre-tokens of a whole run of texts stand in one list side by side, with no links between them,
so a bucket is merged at once, in numpy. Where entries overlap, as in a run of one letter, the leftmost go first.
Should a merge make a pair of lower rank, which would be next, only the first entry of its pre-token is merged, and the
others go back to the bucket. A pre-token of n bytes costs O(n log n), so one of a million bytes is no problem.

A run of texts is cut at blanks into units, of which each distinct one is looked up once: its ids are in a bounded
memo of the worker, or its matches of the pattern are merged. The ids of the texts are gathered from those of the
units, and bytes from the pieces of the ids. Nothing is shuffled.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded each on their own;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, documents, map_batches, whole_text

# Entries of a generation of a worker's memo of units and matches, and the longest that is kept: 60 MB at most in two.
MEMO = 200_000
MEMO_BYTES = 40

# Bits in a word of the bitmaps.
WORD = 256

# Bytes of text whose new units are merged together, and whose ids are gathered at once.
GROUP = 4 << 20
CHUNK = 1 << 20

# Runs of ids or bytes whose places are listed at once when they are gathered.
GATHERED = 1 << 15

# Blanks of one byte, and what begins other white space. Texts with the latter are not cut.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
OTHER_BLANK = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class RankQueue:
    """Buckets of positions by rank under two levels of bitmaps with words of ``WORD`` bits."""

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // WORD + 1)
        self.bit = [1 << i for i in range(max(WORD, len(self.low)))]
        self.top = 0
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, position) -> None:
        """``position``: one, or an array of them."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank // WORD
        self.top |= self.bit[word]
        self.low[word] |= self.bit[rank % WORD]

    def pop(self) -> tuple[int, list] | None:
        """Lowest rank and its bucket, None when empty."""
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        first = bits & -bits
        self.low[word] = bits ^ first
        if bits == first:
            self.top ^= self.bit[word]
        rank = word * WORD + first.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Codec:
    """A vocabulary of ranks and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.n = max(ranks.values()) + 1
        self.pieces = [b""] * self.n
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_ends = np.cumsum(lengths)
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = rank
        # Two parts of the vocabulary and the rank of what they make; the last entry is met by nothing.
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        first = np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        self.byte_pairs = self.rank_of(*first).reshape(256, 256)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where there is none; an id of -1 pairs with nothing."""
        key = a.astype(np.int64) * self.n + b
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, each by itself."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        begins = np.concatenate(([0], ends[:-1]))
        # Place n stands before and after every pre-token.
        symbol = np.append(self.of_byte[data], -1).astype(np.int32)
        following = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        following[ends - 1] = n
        before[begins] = n
        pair = np.full(n + 1, -1, np.int32)  # rank of the pair that starts here, if there is one now
        pair[: n - 1] = self.byte_pairs[data[:-1], data[1:]]
        pair[ends - 1] = -1
        gone = np.zeros(n + 1, bool)
        queue = RankQueue(self.n)
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        first = np.flatnonzero(np.diff(pair[at], prepend=-1))
        for rank, positions in zip(pair[at[first]].tolist(), np.split(at, first[1:])):
            queue.push(rank, positions)

        def merge(now: np.ndarray, rank: int, all_at_once: bool) -> np.ndarray | None:
            """Merge the pairs at ``now``. Where that makes pairs of lower rank, and not all may go at once, undo it
            and return where they are."""
            right = following[now]
            after = following[right]
            held = symbol[now], before[after], pair[right]
            symbol[now] = rank
            gone[right] = True
            pair[right] = -1
            following[now] = after
            before[after] = now
            begin = np.concatenate((now, before[now]))
            new = self.rank_of(symbol[begin], symbol[np.concatenate((after, now))])
            if not all_at_once:
                low = begin[(new >= 0) & (new < rank)]
                touching = np.flatnonzero(after[:-1] == now[1:])  # the right neighbour is merged too, but later
                if len(touching):
                    between = self.rank_of(np.full(len(touching), rank), held[0][touching + 1])
                    low = np.concatenate((low, now[touching[(between >= 0) & (between < rank)]]))
                if len(low):
                    symbol[now], following[now], gone[right] = held[0], right, False
                    before[after], pair[right] = held[1], held[2]
                    return low
            pair[begin] = new
            pair[n] = -1
            made = new >= 0
            for r, p in zip(new[made].tolist(), begin[made].tolist(), strict=True):
                queue.push(r, p)
            return None

        while (least := queue.pop()) is not None:
            rank, bucket = least
            several = [x for x in bucket if type(x) is not int]
            now = several[0] if len(bucket) == len(several) == 1 else np.unique(np.concatenate([*several, [x for x in bucket if type(x) is int]])).astype(np.int64)
            now = valid = now[pair[now] == rank]  # the others are stale
            if len(now) > 1:
                linked = following[now[:-1]] == now[1:]
                if linked.any():  # of overlapping ones every other, from the left
                    place = np.arange(len(now))
                    chain = np.maximum.accumulate(np.where(np.concatenate(([True], ~linked)), place, 0))
                    now = now[(place - chain) % 2 == 0]
            if len(now) and (low := merge(now, rank, len(now) == 1)) is not None:
                own = np.searchsorted(ends, now, "right")
                first = np.diff(own, prepend=-1) > 0
                ready = first | ~np.isin(own, np.searchsorted(ends, low, "right"))
                queue.push(rank, np.setdiff1d(valid, now[ready], assume_unique=True))
                merge(now[ready], rank, True)
        kept = ~gone[:n]
        ids = symbol[:n][kept].astype("<u4").tobytes()
        upto = (np.cumsum(np.add.reduceat(kept, begins, dtype=np.int64)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *upto], upto)]

    def learn(self, units: set[bytes]) -> dict[bytes, bytes]:
        """Ids of the units. Those of short units and matches are kept in two generations of at most ``MEMO`` each."""
        young, old = self.young, self.old
        found = {u: ids for u in units if (ids := young.get(u) or old.get(u))}
        parts = {u: [m.encode() for m in self.matches(u.decode())] for u in units if u not in found}
        fresh: dict[bytes, bytes] = {}
        long = []
        for p in dict.fromkeys(p for own in parts.values() for p in own):
            if ids := young.get(p) or old.get(p):
                found[p] = ids
            elif (rank := self.ranks.get(p)) is not None:
                fresh[p] = rank.to_bytes(4, "little")
            else:
                long.append(p)
        fresh.update(zip(long, self.merged(long), strict=True))
        found.update(fresh)
        for unit, own in parts.items():
            if unit not in found:
                found[unit] = fresh[unit] = b"".join([found[p] for p in own])
        if len(young) + len(fresh) > MEMO:
            self.old, self.young = young, {}
        self.young.update(islice(((u, ids) for u, ids in fresh.items() if len(u) <= MEMO_BYTES), MEMO))
        return found

    def encode_runs(self, group: list[tuple[np.ndarray, np.ndarray]]):
        """For every run of texts that lie one after another, and their ends: the ids, and where those of each text end."""
        cuts, coded = [], []
        for data, ends in group:
            cut = units(data, ends)
            offsets = pa.py_buffer(np.append(cut, len(data)).astype(np.int32))
            cuts.append(cut)
            coded.append(pa.Array.from_buffers(pa.binary(), len(cut), [None, offsets, pa.py_buffer(data)]).dictionary_encode())
        names = [c.dictionary.to_pylist() for c in coded]
        found = self.learn(set().union(*names))
        for (_, ends), cut, code, own in zip(group, cuts, coded, names, strict=True):
            rows = [found[u] for u in own]
            ids = np.frombuffer(b"".join(rows), "<u4")
            lengths = np.array([len(r) for r in rows], np.int64) // 4
            unit = code.indices.to_numpy()
            after = np.concatenate(([0], np.cumsum(lengths[unit])))
            yield gathered(ids, np.cumsum(lengths), lengths, unit), after[np.searchsorted(cut, ends)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of texts that end at ``ends``, and where those of each text end."""
        lengths = np.diff(self.piece_ends, prepend=0)
        after = np.concatenate(([0], np.cumsum(lengths[ids])))
        return gathered(self.piece_bytes, self.piece_ends, lengths, ids), after[ends]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(text.encode(), np.uint8)
        return next(self.encode_runs([(data, np.array([len(data)]))]))[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4")
        return self.decode_all(own, np.array([len(own)]))[0].tobytes()


def units(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin: at texts, at single spaces, and at and after single line ends.

    A single blank, with none on either side, always opens a match: no match holds white space after other
    characters, and only runs of blanks are divided by what follows them.
    """
    begins = np.concatenate(([0], ends[:-1]))
    begins, last = begins[begins < ends], ends[begins < ends] - 1
    blank = BLANK[data]
    single = (data == 32) | (data == 10)
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[begins], after[last] = False, False
    single &= ~before & ~after
    mark = single.copy()
    mark[1:] |= single[:-1] & (data[:-1] == 10)
    whole = data.tobytes()
    if OTHER_BLANK.search(whole):
        for a, b in zip(begins.tolist(), last.tolist(), strict=True):
            if OTHER_BLANK.search(whole, a, b + 1):
                mark[a : b + 1] = False
    mark[begins] = True
    return np.flatnonzero(mark)


def gathered(values: np.ndarray, ends: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that are named by ``at``, one after another.

    ``GATHERED`` runs at a time, as the places of what is gathered take up to 24 times the memory of its bytes.
    """
    own = lengths[at]
    out = np.cumsum(own)
    if not len(out):
        return values[:0]
    found = np.empty(out[-1], values.dtype)
    for first in range(0, len(at), GATHERED):
        now = slice(first, first + GATHERED)
        begin, end = out[first] - own[first], out[now][-1]
        found[begin:end] = values[np.arange(begin, end) + np.repeat(ends[at[now]] - out[now], own[now])]
    return found


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of the rows that end at ``ends``."""
    offsets = np.concatenate(([0], ends * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def runs(texts: pa.Array, size: int):
    """Texts in runs of about ``size`` bytes: first row, bytes and where each text ends in them."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + size)), first + 1)
        last = min(last, len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """Read once per worker; ``path`` must be readable there."""
    with open(path, "rb") as file:
        lines = [line.split() for line in file if line.strip()]
    return Codec({base64.b64decode(piece): int(rank) for piece, rank in lines}, pattern)


def encode(df: DataFrame, path: str, pattern: str, decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit); with ``decoded`` also their bytes.

    ``keep``: more columns to pass through.
    """
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded + list(keep)

    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for begin, data, ends in runs(texts, GROUP):
                group = list(runs(texts.slice(begin, len(ends)), CHUNK))
                for (first, *_), (ids, upto) in zip(group, c.encode_runs([g[1:] for g in group]), strict=True):
                    columns = [
                        batch.column(0).slice(begin + first, len(upto)),
                        pa.array(np.diff(upto, prepend=0), pa.int64()),
                        binaries(ids, upto),
                    ]
                    if decoded:
                        columns.append(binaries(*c.decode_all(ids, upto)))
                    columns += [x.slice(begin + first, len(upto)) for x in batch.columns[2:]]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    schema += "".join(f", {k} {df.select(k).dtypes[0][1]}" for k in keep)
    return map_batches(df.select(F.col("doc_id").cast("long"), whole_text(), *keep), run, schema)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the ``text`` bytes of ``ids``."""

    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(c.decode, ids), pa.binary())], ["doc_id", "decoded"]
            )

    return map_batches(df.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    return encode(df, path, pattern, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *vocabulary())


QUERIES = {"op7_byte_bpe": query}
SQL: dict[str, str] = {}
