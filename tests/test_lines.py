import collections

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lines as L


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", "one"), ("b", "{}\n;\n"), ("c", "\n".join(f"line {i}" for i in range(50)))]
    return spark.createDataFrame(rows, "file string, text string")


@pytest.fixture(scope="module")
def draws(spark):
    return spark.range(300).select(F.col("id").alias("d"))


def test_draw_repeats_a_single_line(spark, files, draws):
    got = L.draw_lines(draws, ["d"], files.filter("file = 'a'"), "file", "text", 5)
    per_draw = collections.defaultdict(list)
    for r in got.collect():
        per_draw[r.d].append(r.line)
    assert len(per_draw) == 300
    assert {len(v) for v in per_draw.values()} == {1, 2, 3}
    assert {x for v in per_draw.values() for x in v} == {"one"}


def test_draw_picks_files_evenly_and_empty_files_give_nothing(files, draws):
    chosen = L.choose_files(draws, ["d"], files, "file", 5).groupBy("file").count().collect()
    assert all(70 < r["count"] < 130 for r in chosen) and len(chosen) == 3
    drawn = {r.file for r in L.draw_lines(draws, ["d"], files, "file", "text", 5).collect()}
    assert drawn == {"a", "c"}


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_draw_does_not_depend_on_partitions(files, draws, partitions):
    rows = lambda f, d: sorted(map(tuple, L.draw_lines(d, ["d"], f, "file", "text", 5).collect()))
    assert rows(files.repartition(partitions), draws.repartition(partitions)) == rows(files, draws)


def test_numbering_of_many_files(files, draws):
    few = sorted(map(tuple, L.choose_files(draws, ["d"], files, "file", 5).collect()))
    many = sorted(map(tuple, L.choose_files(draws, ["d"], files, "file", 5, F.ascii("file")).collect()))
    assert few == many


def test_fallback_chain(spark, files, draws):
    sized = L.sized_draws(draws, ["d"], files, "file", "text", 5)
    lines = L.lines_of_draws(sized, ["d"], files, "file", "text", 5)
    both = spark.createDataFrame([(0, "s1"), (1, "s2")], "pos int, line string")
    tiers = {r.tier for r in L.with_fallback(sized, lines, ["d"], both, 5).collect()}
    assert tiers == {"file", "snippet"}
    empty = sized.filter("file = 'b'")
    bare = L.with_fallback(empty, lines.limit(0), ["d"], both.limit(0), 5).collect()
    assert {(r.tier, r.pos, r.line) for r in bare} == {("constant", 0, L.LAST_RESORT)}
    snippets = L.with_fallback(empty, lines.limit(0), ["d"], both, 5)
    assert {r.line for r in snippets.collect()} == {"s1", "s2"}


def test_no_files_at_all(spark, files, draws):
    none = files.filter("false")
    sized = L.sized_draws(draws, ["d"], none, "file", "text", 5)
    lines = L.lines_of_draws(sized, ["d"], none, "file", "text", 5)
    got = L.with_fallback(sized, lines, ["d"], spark.createDataFrame([(0, "s")], "pos int, line string"), 5)
    assert got.select("d").distinct().count() == 300
    assert {r.line for r in got.collect()} == {"s"}


def test_first_available(spark):
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert [r.x for r in L.first_available([t(), t(2, 3), t(4)]).collect()] == [2, 3]
    assert L.first_available([t(), t()]).count() == 0


def test_last_n(spark):
    df = spark.range(72).select(F.col("id").alias("seq"), F.when(F.col("id") < 23, "a").when(F.col("id") < 47, "b").otherwise("c").alias("feed"))
    got = L.last_n(df, ["feed"], ["seq"])
    sizes = {r.feed: (r.n, r.low) for r in got.groupBy("feed").agg(F.count("seq").alias("n"), F.min("seq").alias("low")).collect()}
    assert sizes == {"a": (23, 0), "b": (24, 23), "c": (24, 48)}
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [24, 100, 1500])
def test_last_n_of_a_hot_feed(spark, n):
    df = spark.range(4000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 > 0, "hot").otherwise("b").alias("feed"))
    got = L.last_n(df.repartition(9), ["feed"], ["seq"], n).collect()
    for feed, keep in (("hot", lambda i: i % 10), ("b", lambda i: not i % 10)):
        want = [i for i in range(4000) if keep(i)][-n:]
        assert sorted(r.seq for r in got if r.feed == feed) == want


def test_a_draw_never_meets_the_lines_of_a_whole_file(files, draws):
    plan = L.draw_lines(draws, ["d"], files, "file", "text", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "_clean" not in plan


def test_manifest_lines(spark, files):
    manifest = spark.createDataFrame([("a",), ("zzz",)], "file string")
    assert [tuple(r) for r in L.lines_of(manifest, files).collect()] == [("a", 0, "one")]
