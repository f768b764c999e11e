import random
import re

import numpy as np
import pytest
from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import minhash
from gleaner.llm.components import components


def brute_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_groups(texts, ids, width, percent):
    sets = [brute_set(t, width) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= percent * len(a | sets[j]):
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in zip(ids, sets, strict=True)}


def varied(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed=5):
    """Groups of near copies with chains around the limit, exact copies, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = list(AWKWARD)
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(1, 8)):
            base = varied(rng, base, rng.randrange(0, 1 + len(base) // 25))
            texts.append(" ".join(base))
    for _ in range(40):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(3, 30))]))
    texts += [texts[-1], texts[-1].upper(), "a b", "A  b", "a b c", "a b c d", "a b c d e"]
    return texts


@pytest.mark.parametrize(("width", "group"), [(4, 2048), (5, 2)])
def test_groups_equal_brute_force(spark, width, group):
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    random.Random(2).shuffle(ids)
    got = minhash.near_groups(documents(spark, texts, ids=ids), width, 80, group).collect()
    want = brute_groups(texts, ids, width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_hashes_are_those_of_single_texts():
    texts = [t.encode() for t in corpus() if t is not None]
    for width in (4, 5):
        for text, one in zip(texts, minhash.shingle_sets(texts, width), strict=True):
            assert len(one) == len(brute_set(text.decode(), width))
            assert (minhash.shingle_sets([text], width)[0] == one).all()


def test_sketch_fills_all_bins_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        elements = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (minhash.sketch(elements) != minhash.EMPTY).all()
    off = []
    for k in range(30):
        pool = minhash.mixed(np.arange(10_000 * k, 10_000 * k + 1100, dtype=np.uint64))
        a, b = pool[:1000], pool[100:]
        off.append((minhash.sketch(a) == minhash.sketch(b)).mean() - 900 / 1100)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_sketch_equals_one_round_at_a_time():
    for n in (1, 3, 50, 700):
        elements = minhash.mixed(np.arange(n, dtype=np.uint64) + np.uint64(9))
        bins, low = {}, (1 << 48) - 1
        for i in range(2 * minhash.BINS):
            for x in minhash.mixed(elements ^ minhash.ROUNDS[i]).tolist():
                b = (x >> 48) % minhash.BINS if i < minhash.BINS else i - minhash.BINS
                if b not in bins or bins[b] >> 48 == i:
                    bins[b] = min(bins.get(b, 2**64), i << 48 | x & low)
            if len(bins) == minhash.BINS and i < minhash.BINS:
                break
        assert minhash.sketch(elements).tolist() == [bins[b] for b in range(minhash.BINS)]


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [long, long, long, "other words are here now", None], ids=[3, 3, None, 8, 9])
    got = sorted(minhash.near_groups(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id == 3] == [(3, 3, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    left = minhash.without_copies(docs.withColumnRenamed("lang", "component"))
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 3, 8, 9] and "component" in left.columns


def test_joining_links_equal_brute_force():
    rng = random.Random(6)
    pool = minhash.mixed(np.arange(400, dtype=np.uint64))
    sets = []
    for _ in range(120):
        base = rng.randrange(3) * 100
        sets.append(np.sort(pool[[base + i for i in range(60) if rng.random() < 0.93] + rng.sample(range(300, 400), rng.randrange(4))]))
    component = [rng.randrange(10) if i < 40 else i for i in range(len(sets))]
    links = [
        (i, j) for j in range(len(sets)) for i in range(j)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    ]
    got = minhash.joining_links(sets, component, 80)
    assert set(got) <= set(links) and len(got) < len(set(component))

    def joined(pairs):
        root = {c: c for c in component}
        find = lambda c: c if root[c] == c else find(root[c])
        for i, j in pairs:
            x, y = find(component[i]), find(component[j])
            root[max(x, y)] = min(x, y)
        return [find(c) for c in component]

    assert joined(got) == joined(links)


def test_empty_table(spark):
    docs = documents(spark, ["x"]).limit(0)
    assert minhash.near_groups(docs).count() == 0 and minhash.without_copies(docs).count() == 0


def test_query_takes_four_words(spark, tmp_path):
    texts = ["a b c d e f", "a b c d", "q r s t u v w x y z " * 3]
    got = minhash.query(spark, saved(spark, tmp_path, documents(spark, texts))).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {0: 3, 1: 1, 2: 10}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    chain = list(range(60))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(100 + i, 99) for i in range(50)] + [(300, 301), (301, 302), (302, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(chain, 0), **dict.fromkeys(range(99, 150), 99), **dict.fromkeys((300, 301, 302), 300)}


def similar(n, edits, seed=3):
    """Documents of about 97 shingles; with two edited words each any two are at 0.72, with one at 0.85."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(100)]
    return [" ".join(varied(rng, template, edits)) for _ in range(n)]


def test_large_groups_without_links_do_not_explode(spark, monkeypatch):
    """Written rows at most quadruple with twice the documents."""
    written = []
    plain = minhash.write_through

    def counting(df, *a):
        table = plain(df, *a)
        written.append(table.count())
        return table

    monkeypatch.setattr(minhash, "write_through", counting)
    sums = []
    for n in (48, 96):
        texts = similar(n, 2)
        written.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_groups(documents(spark, texts), 4, 80, group=4).collect()}
        assert got == {k: c for k, (_, c) in brute_groups(texts, list(range(n)), 4, 80).items()}
        sums.append(sum(written))
    assert sums[1] <= 4 * sums[0]


@pytest.mark.parametrize("group", [4, 16])
def test_large_groups_of_copies_chains_and_strangers(spark, group):
    rng = random.Random(11)
    texts = similar(20, 1) + similar(20, 2, 4) + similar(10, 3, 5)
    for k in range(3):  # chains, where only neighbours are linked
        words = [f"c{k}x{i}" for i in range(90)]
        for _ in range(12):
            words = varied(rng, words, 2)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    got = {r.doc_id: r.component_id for r in minhash.near_groups(documents(spark, texts, ids=ids), 4, 80, group).collect()}
    assert got == {k: c for k, (_, c) in brute_groups(texts, ids, 4, 80).items()}


def test_clashing_columns(spark):
    docs = documents(spark, corpus()[:30])
    more = docs.withColumns({c: F.lit("mine") for c in ("class", "n", "digest", "bands", "component", "group", "elements")})
    assert sorted(map(tuple, minhash.near_groups(more).collect())) == sorted(map(tuple, minhash.near_groups(docs).collect()))
