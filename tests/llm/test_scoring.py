import math
import re
from collections import Counter

import numpy as np
from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import scoring


def brute(texts, good):
    """Plain dictionaries over the same types."""
    def tokens(text):
        words, pairs, _ = scoring.types_of([(text or "").encode()])
        before = scoring.previous(words, np.array([len(words)]))
        return list(zip(words.tolist(), pairs.tolist(), before.tolist(), strict=True))

    models = []
    for rows in ([t for i, t in enumerate(texts) if i in good], texts):
        words, pairs, befores = Counter(), Counter(), Counter()
        for t in rows:
            for w, p, b in tokens(t):
                words[w] += 1
                pairs[p] += 1
                befores[b] += 1
        models.append((words, pairs, befores, sum(words.values()) + 2**scoring.WORD_BITS))
    out = []
    for t in texts:
        means = []
        for words, pairs, befores, total in models:
            loss = [
                -math.log((pairs[p] + scoring.WEIGHT * (words[w] + 1) / total) / (befores[b] + scoring.WEIGHT))
                for w, p, b in tokens(t)
            ]
            means.append(sum(loss) / max(len(loss), 1))
        out.append((len(tokens(t)), *means, means[1] - means[0]))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = AWKWARD + [f"good words {i % 3} here and there" if i % 2 else f"bad stuff {i % 5} out out" for i in range(40)]
    good = {i for i in range(len(AWKWARD), len(texts)) if i % 2 == 0} | {4}
    folder = saved(spark, tmp_path, documents(spark, texts).repartition(3))
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, len(texts))] + [(4, 1, 0)], "doc_id long, quality int, toxic int")
    saved(spark, tmp_path, labels, "labels")
    got = {r.doc_id: tuple(r)[1:] for r in scoring.query(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, good)):
        assert got[i][0] == want[0]
        assert np.allclose(got[i][1:], want[1:], atol=2e-5), i


def test_words_do_not_depend_on_their_neighbours_or_chunks():
    texts = [(t or "").encode() for t in AWKWARD]
    words, pairs, ends = scoring.types_of(texts)
    begin = 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        w, p, _ = scoring.types_of([t])
        assert words[begin:end].tolist() == w.tolist() and pairs[begin:end].tolist() == p.tolist()
        begin = end


def test_held_out_documents_like_the_target_score_higher(spark):
    rng = np.random.default_rng(1)
    kinds = [[f"{k}{i}" for i in range(200)] for k in "ab"]
    texts = [" ".join(rng.choice(kinds[i % 2], 60)) for i in range(300)]
    docs = documents(spark, texts)
    good = docs.filter("doc_id % 2 = 0 AND doc_id < 200").select("doc_id")
    scores = {r.doc_id: r.score for r in scoring.scored(docs, *scoring.train(docs, good)).collect()}
    held = [scores[i] for i in range(200, 300)]
    assert min(held[0::2]) > max(held[1::2])


def test_empty_tables(spark):
    docs = documents(spark, ["x y"])
    none = docs.limit(0)
    assert scoring.scored(none, *scoring.train(none, none.select("doc_id"))).count() == 0
    assert scoring.scored(docs, *scoring.train(docs, none.select("doc_id"))).first().n_tokens == 2


def by_real_words(texts, good):
    """The scores from the words and pairs themselves, with nothing hashed."""
    rows = [re.findall(r"[^ \t\n\x0b\f\r]+", t) for t in texts]
    types = max(len({w for r in rows for w in r}), 2**scoring.WORD_BITS)
    models = []
    for part in ([r for i, r in enumerate(rows) if i in good], rows):
        words = Counter(w for r in part for w in r)
        pairs = Counter(p for r in part for p in zip(["", *r], r))
        befores = Counter(v for r in part for v in ["", *r][: len(r)])
        models.append((words, pairs, befores, sum(words.values()) + types))
    out = []
    for r in rows:
        means = []
        for words, pairs, befores, total in models:
            loss = [
                -math.log((pairs[v, w] + scoring.WEIGHT * (words[w] + 1) / total) / (befores[v] + scoring.WEIGHT))
                for v, w in zip(["", *r], r)
            ]
            means.append(sum(loss) / max(len(loss), 1))
        out.append((len(r), *means, means[1] - means[0]))
    return out


def test_many_words_are_counted_by_themselves(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 1500) % 300_000) for _ in range(300)] + [""]
    texts += [" ".join(f"v{k}x{i}" for i in range(10_000)) for k in range(14)]
    good = set(range(0, 300, 2))
    docs = documents(spark, texts).repartition(3)
    labels = docs.filter("doc_id % 2 = 0 AND doc_id < 300").select("doc_id")
    got = {r.doc_id: tuple(r)[1:] for r in scoring.scored(docs, *scoring.train(docs, labels)).collect()}
    assert len({w for t in texts for w in t.split()}) > 2**scoring.WORD_BITS
    for i, want in enumerate(by_real_words(texts, good)):
        assert got[i][0] == want[0]
        assert np.allclose(got[i][1:], want[1:], atol=2e-6), i


def test_words_of_no_counted_document(spark):
    docs = documents(spark, ["a b a", "a c"])
    seen = docs.filter("doc_id = 0")
    got = {r.doc_id: r for r in scoring.scored(docs, *scoring.train(seen, seen.select("doc_id"))).collect()}
    total = 3 + 2**scoring.WORD_BITS
    loss = -math.log((1 + 50 * 3 / total) / 51) - math.log((50 * 1 / total) / 51)
    assert abs(got[1].target_loss - loss / 2) < 2e-6 and got[1].score == 0


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [t or "" for t in AWKWARD] + [" ".join(f"w{x}" for x in rng.zipf(1.4, 80) % 5000) for _ in range(120)] + ["one"] * 60 + [""] * 9
    good = set(range(0, len(texts), 3))
    docs = documents(spark, texts).repartition(3).withColumns({c: F.lit(1) for c in ("block", "part", "place", "_good", "keys")})
    labels = docs.filter("doc_id % 3 = 0").select("doc_id")
    monkeypatch.setattr(scoring, "BLOCK", 1500)
    monkeypatch.setattr(scoring, "TEXTS", 7)
    monkeypatch.setattr(scoring, "PART", 900)
    monkeypatch.setattr(scoring, "BATCH", 300)
    (counted,) = scoring.train(docs, labels)
    assert counted.count() > 28 and max(len(r.ids) for r in counted.collect()) == 7
    itself = {r.doc_id: tuple(r)[1:] for r in scoring.scored(None, counted).collect()}
    others = {r.doc_id: tuple(r)[1:] for r in scoring.scored(docs, counted).collect()}
    assert itself == others and len(itself) == len(texts)
    for i, want in enumerate(brute(texts, good)):
        assert itself[i][0] == want[0]
        assert np.allclose(itself[i][1:], want[1:], atol=2e-6), i


def test_types_in_runs_are_those_of_all_texts(monkeypatch):
    texts = [(t or "").encode() for t in AWKWARD] * 2
    want = scoring.types_of(texts)
    for size in (1, 100, 10**6):
        monkeypatch.setattr(scoring, "CHUNK", size)
        assert all(a.tolist() == b.tolist() for a, b in zip(scoring.types_in_runs(texts), want, strict=True))
    assert [len(x) for x in scoring.types_in_runs([])] == [0, 0, 0]


def test_packed_numbers_come_back():
    for dtype in (np.uint8, np.uint32, np.int64, np.uint64):
        for values in (np.zeros(0, dtype), np.arange(1000, dtype=dtype) * dtype(7919 if dtype != np.uint8 else 1)):
            back = scoring.unpacked(scoring.packed(values), dtype)
            assert back.dtype == dtype and back.tolist() == values.tolist()
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 500, np.uint64))
    assert np.cumsum(scoring.steps(keys)).tolist() == keys.tolist()
