import base64
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import AWKWARD, documents, saved
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import bpe

PATH, PATTERN = bpe.vocabulary()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODEC = bpe.codec(PATH, PATTERN)


def ids_of(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'aeßx1é😀 \x0b\x1c.,s"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_equals_the_library(library, text):
    assert ids_of(text) == library.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r'aß1\x1c\x85\xa0\u2003\u2028\u3000ab."), max_size=12), max_size=12))
def test_runs_of_texts_equal_the_library(library, texts):
    data = [t.encode() for t in texts]
    run = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data], dtype=np.int64)
    ids, ends = next(CODEC.encode_runs([run]))
    assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(texts)] == [library.encode_ordinary(t) for t in texts]
    back, upto = CODEC.decode_all(ids, ends)
    assert [x.tobytes() for x in np.split(back, upto[:-1])][: len(texts)] == data


def test_small_chunks_and_clashing_columns(spark, monkeypatch, library):
    monkeypatch.setattr(bpe, "CHUNK", 10)
    docs = documents(spark, AWKWARD).withColumns({"n_tokens": F.lit("mine"), "ids": F.lit(1), "decoded": F.lit(2)})
    for r in bpe.encode(docs, PATH, PATTERN, decoded=True).collect():
        text = AWKWARD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert (r.n_tokens, bytes(r.decoded)) == (len(r.ids) // 4, text.encode())


def one_by_one(ranks, piece):
    """Always the leftmost pair of lowest rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_vocabularies_whose_ranks_fall_along_merges(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(60)}
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {p: 256 + k for k, p in enumerate(rng.sample(sorted(pieces), len(pieces)))}
    codec = bpe.Codec(ranks, PATTERN)
    texts = [bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(60)]
    texts = [t for t in dict.fromkeys(texts) if t not in ranks]
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.merged(texts)]
    assert got == [one_by_one(ranks, t) for t in texts]


def test_a_small_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 4)
    small = bpe.Codec(CODEC.ranks, PATTERN)
    rng = random.Random(5)
    for _ in range(50):
        text = " ".join(rng.choice(["alpha", "beta,", "gamma-delta", "x" * 60, "Ωmega"]) + str(rng.randrange(3)) for _ in range(30))
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_long_pre_tokens_equal_the_library(library):
    rng = random.Random(3)
    for text in ("a" * 3000, "ab" * 2500, "".join(rng.choice("etaoin") for _ in range(4000)), "x1" * 1000):
        assert ids_of(text) == library.encode_ordinary(text)


def test_very_long_pre_token_ends(library):
    text = "abcdefghij" * 30_000
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_queue_pops_in_order_of_rank():
    rng = random.Random(1)
    queue = bpe.RankQueue(50_000)
    items = [(rng.randrange(50_000), rng.randrange(99)) for _ in range(3000)]
    for x in items:
        queue.push(*x)
    ranks = sorted({r for r, _ in items})
    assert [queue.pop() for _ in ranks] == [(r, [p for q, p in items if q == r]) for r in ranks]
    assert queue.pop() is None
    queue.push(7, 1)
    queue.push(3, 2)
    assert (queue.pop(), queue.pop(), queue.pop()) == ((3, [2]), (7, [1]), None)


def test_query(spark, library, tmp_path):
    texts = AWKWARD + ["the same", "the same"]
    folder = saved(spark, tmp_path, documents(spark, texts))
    got = {r.doc_id: r for r in bpe.query(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_and_empty_table(spark):
    docs = documents(spark, AWKWARD)
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {i: t or "" for i, t in enumerate(AWKWARD)}
    assert bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_batches_are_cut_by_size(spark, monkeypatch):
    docs = documents(spark, [f"words {i} " * 50 for i in range(40)]).coalesce(1)
    assert bpe.encode(docs, PATH, PATTERN).count() == 40


def test_gathering_takes_little_more_memory_than_what_is_gathered():
    lengths = np.array([0, 1, 3, 200_000, 7])
    ends = np.cumsum(lengths)
    values = np.random.default_rng(1).integers(0, 256, ends[-1], np.uint8)
    at = np.append(np.tile([2, 0, 4, 1], 250_000), [3, 0, 3])
    want = b"".join([values[e - n : e].tobytes() for e, n in zip(ends[at].tolist(), lengths[at].tolist(), strict=True)])
    held = 3 * at.nbytes  # the lengths and ends of the runs themselves
    tracemalloc.start()
    got = bpe.gathered(values, ends, lengths, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tobytes() == want
    assert peak < held + 4 * len(want)
