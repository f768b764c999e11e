import random
import zlib

import numpy as np
import pytest
from fixtures import AWKWARD, documents, saved
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import tokens

PATH, END = tokens.end_and_path()
ENCODER = tokens.encoder(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'saeÖßς Σéx1́.,!|:“<|>\x0b\x1c"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_equals_the_library(library, text):
    check(library, text)


PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", "a", "'", "s", " ", "É", "́", "\n", "<|start", "oftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_special_tokens_equal_the_library(library, text):
    check(library, text)


def test_special_tokens_have_their_ids():
    got = np.frombuffer(ENCODER.encode(b"a<|endoftext|> <|startoftext|>"), "<u4").tolist()
    assert got[1:] == [49407, 49406] and len(got) == 3


def check(library, text):
    got = np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60_000), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    levels = tokens.pack(ids)
    assert (tokens.unpack(levels) == ids).all()
    if len(ids):
        places = np.random.default_rng(0).integers(0, len(ids), 50)
        assert (tokens.at_places(levels, places) == ids[places]).all()


def expected(texts, ids, library):
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i] or ""))
    start, out = 0, []
    for i in order:
        row = library.encode(texts[i] or "", add_special_tokens=False).ids + [END]
        out.append((ids[i], start, row))
        start += len(row)
    return out


TEXTS = AWKWARD + [f"Some words, No. {i}: déjà-vu ÉTÉ it's {i * 37}!" * (i % 9) for i in range(60)]


def test_query(spark, library, tmp_path):
    ids = list(range(len(TEXTS)))
    random.Random(3).shuffle(ids)
    folder = saved(spark, tmp_path, documents(spark, TEXTS, ids=ids).repartition(3))
    got = sorted(map(tuple, tokens.query(spark, folder).collect()))
    want = [(d, s, len(r), zlib.crc32(np.array(r, "<u4").tobytes())) for d, s, r in expected(TEXTS, ids, library)]
    assert got == want


def test_small_segments_repeated_ids_and_single_tokens(spark, library, tmp_path):
    ids = [i // 2 for i in range(len(TEXTS))]
    tokens.write_tokens(documents(spark, TEXTS, ids=ids), str(tmp_path), PATH, END, size=300)
    want = expected(TEXTS, ids, library)
    got = tokens.read_documents(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    flat = [t for _, _, row in want for t in row]
    places = [0, 1, len(flat) - 1, len(flat), 10**9] + random.Random(1).sample(range(len(flat)), 200)
    asked = spark.createDataFrame([(p,) for p in places], "token long")
    found = {r.token: r.id for r in tokens.tokens_at(spark, str(tmp_path), asked).collect()}
    assert found == {p: flat[p] for p in places if p < len(flat)}


def test_clashing_columns(spark, tmp_path):
    docs = documents(spark, TEXTS[:12]).withColumns({c: F.lit("mine") for c in ("part", "place", "first", "ids", "start", "n_tokens", "levels")})
    plain = tokens.query(spark, saved(spark, tmp_path / "a", documents(spark, TEXTS[:12])))
    assert sorted(map(tuple, tokens.query(spark, saved(spark, tmp_path / "b", docs)).collect())) == sorted(map(tuple, plain.collect()))


def test_empty_table(spark, tmp_path):
    tokens.write_tokens(documents(spark, ["x"]).limit(0), str(tmp_path), PATH, END)
    assert tokens.read_documents(spark, str(tmp_path)).count() == 0
