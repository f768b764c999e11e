import random
from collections import Counter
from fractions import Fraction

from fixtures import documents, saved
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=12), st.integers(1, 200))
def test_deviation_stays_below_one_block(weights, period):
    own = mixing.shares(weights, period)
    assert sum(own) == max(period, len(weights)) and min(own) >= 1
    slots = mixing.one_period(own)
    assert sorted(s for x in slots for s in x) == list(range(sum(own)))
    for a, places in zip(own, slots, strict=True):
        got = 0
        for t in range(1, 2 * sum(own) + 1):
            got += (t - 1) % sum(own) in set(places)
            assert abs(got - Fraction(a * t, sum(own))) < 1
        for i, s in enumerate(places):
            assert i * sum(own) // a <= s < -(-(i + 1) * sum(own) // a)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(5, 40))
def test_phases_place_every_block_once(blocks, period):
    weights = [1.0 + k for k in range(len(blocks))]
    slots, counts = [], Counter()
    for k, first, last, base, share, whole, places in mixing.phases(blocks, weights, period):
        for i in range(first, last):
            turn = i - first
            slots.append(base + turn // share * whole + places[turn % share])
            counts[k] += 1
    assert sorted(slots) == list(range(sum(blocks)))
    assert [counts[k] for k in range(len(blocks))] == blocks


def brute(rows, weights, block, period, hashes):
    """The schedule slot by slot, with exact fractions."""
    names = sorted({s for _, s in rows}, key=lambda s: (s is not None, s))
    queues = {s: [] for s in names}
    for d, s in sorted(rows, key=lambda r: (hashes[r[0]], r[0])):
        queues[s].append(d)
    left = {s: [q[i : i + block] for i in range(0, len(q), block)] for s, q in queues.items()}
    number, out, slot = Counter(), [], 0
    while any(left.values()):
        active = [s for s in names if left[s]]
        own = dict(zip(active, mixing.shares([weights[s] for s in active], period), strict=True))
        whole, begin, got = sum(own.values()), slot, Counter()
        while all(left[s] for s in active):
            t = slot - begin
            ready = [s for s in active if got[s] * whole // own[s] <= t]
            s = min(ready, key=lambda s: (-(-(got[s] + 1) * whole // own[s]), active.index(s)))
            for place, d in enumerate(left[s].pop(0)):
                out.append((d, s, number[s], slot, place))
            number[s] += 1
            got[s] += 1
            slot += 1
    return sorted(out, key=str)


def table(spark, n=400):
    rng = random.Random(5)
    sources = [rng.choice(["hot"] * 6 + ["a", "b", "c", None]) for _ in range(n)]
    return documents(spark, [f"text {i}" for i in range(n)], sources), [(i, s) for i, s in enumerate(sources)]


def test_equals_a_schedule_made_slot_by_slot(spark):
    docs, rows = table(spark)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", mixing.shuffled(F.col("doc_id")).alias("h")).collect()}
    weights = {"hot": 0.2, "a": 0.5, "b": 0.1, "c": 0.15, None: 0.05}
    got = mixing.mixed(docs, weights, block=3, period=37).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, weights, 3, 37, hashes)


def test_query_places_all(spark, tmp_path):
    docs, rows = table(spark)
    got = mixing.query(spark, saved(spark, tmp_path, docs)).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    assert {r.slot for r in got} == set(range(max(r.slot for r in got) + 1))


def test_stage_keeps_rows_and_order_of_files(spark, tmp_path):
    docs, rows = table(spark)
    docs = docs.unionByName(docs.limit(3)).withColumn("slot", F.lit("x")).withColumn("_hash", F.lit(1))
    mixing.in_mixed_order(docs).write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.columns == docs.columns and back.count() == len(rows) + 3
    first = [r.source for r in spark.read.parquet(*sorted(map(str, (tmp_path / "m").glob("part-00000*")))).collect()]
    assert len(set(first[:160])) > 2
    assert mixing.in_mixed_order(docs.limit(0)).count() == 0


def test_null_ids_and_sources_without_weight(spark):
    docs = documents(spark, ["x"] * 6, ["a", "a", "b", None, None, "a"], ids=[None, None, 1, 1, 2, 3])
    got = mixing.mixed(docs, {"a": 1.0}, block=2, period=5).collect()
    assert len(got) == 6 and sorted(r.slot for r in got) == [0, 0, 1, 1, 2, 3] or len({(r.slot, r.place) for r in got}) == 6


def test_deviation_from_the_target_itself_stays_below_one_block():
    targets = (
        [0.5] + [0.5 / 20] * 20,
        [0.5] + [0.5 / 599] * 599,
        [0.5] + [0.5 / 1499] * 1499,
        [(1 / 3) ** 0.5] + [(2 / 57) ** 0.5] * 19,
    )
    for weights in targets:
        total = sum(map(Fraction, weights))
        scaled = [int(Fraction(w) / total * 10**40) for w in weights]
        got, steps = [0] * len(weights), 100_000 // len(weights) + 2000
        for t, (k, block) in enumerate(mixing.schedule([10**9] * len(weights), weights), 1):
            assert block == got[k]
            got[k] += 1
            assert max(abs(g * 10**40 - w * t) for g, w in zip(got, scaled, strict=True)) < 10**40
            if t == steps:
                break


def test_many_sources_do_not_lower_a_weight(spark):
    sources = ["hot"] * 600 + [f"s{i // 2}" for i in range(600)]
    weights = {"hot": 0.5} | {f"s{i}": 0.5 / 300 for i in range(300)}
    got = mixing.mixed(documents(spark, ["x"] * 1200, sources), weights, block=1).collect()
    assert sorted(r.slot for r in got) == list(range(1200))
    for t in (100, 250, 500):
        assert abs(sum(r.source == "hot" and r.slot < t for r in got) - t / 2) < 1
