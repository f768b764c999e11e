import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import repos as R
from gleaner.operators import sampling as S


def kept(spark, values, condition):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, path string")
    hit = {r.i for r in df.filter(condition).collect()}
    return [i in hit for i in range(len(values))]


def test_paths(spark):
    paths = [
        "src/layout/a.py", "lib/builder.py", ".github/x.yml", "src/a.py", "a/b.tar.GZ", "Makefile", "", None, "X.PY",
        "a.py/b", "distance.py",
    ]
    want = [False, False, False, True, False, False, False, False, True, False, False]
    assert kept(spark, paths, R.is_allowed_path(F.col("path"))) == want


def test_names_block_before_allow(spark):
    df = spark.createDataFrame([("One-Lib",), ("two-lib",), (None,), ("three",)], "name string")
    names = lambda **kw: [r.name for r in R.filter_names(df, **kw).collect()]
    assert names() == ["One-Lib", "two-lib", None, "three"]
    assert names(allow=["LIB"]) == ["One-Lib", "two-lib"]
    assert names(allow=["lib"], block=["two"]) == ["One-Lib"]
    assert names(block=["e"]) == ["two-lib", None]


def test_forks(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, fork boolean")
    assert [r.name for r in R.drop_forks(df).collect()] == ["b", "c"]
    assert R.drop_forks(df, include_forks=True).count() == 3


def test_recent(spark):
    rows = [("a", "", "2024-05"), ("b", "2024-04", "2025"), ("c", None, None), ("d", "2024-05", None), ("e", "2024-06", "")]
    df = spark.createDataFrame(rows, "name string, pushed_at string, updated_at string")
    assert [r.name for r in R.most_recent(df, 8).collect()] == ["e", "a", "d", "b", "c"]
    assert [r.name for r in R.most_recent(df, 2).collect()] == ["e", "a"]


def test_defaults(spark):
    df = spark.createDataFrame([(None, ""), ("o", None), ("", "dev")], "owner string, ref string")
    assert [tuple(r) for r in R.fill_defaults(df, "me").collect()] == [("me", "main"), ("o", "main"), ("", "dev")]


def test_trees(spark):
    df = spark.createDataFrame(
        [("r", [("blob", "a.py"), ("tree", "src"), ("blob", None)]), ("s", [])],
        "repo string, tree array<struct<type:string,path:string>>",
    )
    assert [tuple(r) for r in R.only_files(R.tree_entries(df)).collect()] == [("r", "blob", "a.py"), ("r", "blob", "")]


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_samples_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(500).withColumn("g", F.col("id") % 3).repartition(partitions)
    ids = lambda d: sorted(r.id for r in d.collect())
    base = spark.range(500).withColumn("g", F.col("id") % 3).coalesce(1)
    assert ids(S.sample_rows(df, 16, 42, "id")) == ids(S.sample_rows(base, 16, 42, "id"))
    assert ids(S.sample_per_group(df, ["g"], 5, 42, "id")) == ids(S.sample_per_group(base, ["g"], 5, 42, "id"))


@pytest.mark.parametrize("n", [0, 1, 123, 499, 500, 900])
def test_sample_is_the_first_n_by_hash(spark, n):
    df = spark.range(500).select("id", F.lit("x").alias("_kept"))
    want = sorted(range(500), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())[:n]
    got = S.sample_rows(df, n, 1, "id")
    assert sorted(r.id for r in got.collect()) == sorted(want) and got.columns == df.columns


def test_one_plan_for_every_size(spark):
    shape = lambda n: re.sub(r"\d+", "", S.sample_rows(spark.range(9), n, 1, "id")._jdf.queryExecution().executedPlan().toString())
    assert shape(10) == shape(5_000) == shape(50_000)


def test_sample_per_group_of_many_rows(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") % 10 > 0).cast("int")).repartition(7)
    got = S.sample_per_group(df, ["g"], 1500, 4, "id").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 300, 1: 1500}


def test_sample_is_a_permutation_prefix(spark):
    df = spark.range(50)
    ten = {r.id for r in S.sample_rows(df, 10, 9, "id").collect()}
    assert len(ten) == 10
    assert ten < {r.id for r in S.sample_rows(df, 20, 9, "id").collect()}
    assert ten != {r.id for r in S.sample_rows(df, 10, 10, "id").collect()}
    assert S.sample_rows(df, 100, 9, "id").count() == 50


def test_patches(spark):
    df = spark.range(60).select(
        "id", (F.col("id") % 6).alias("room"), F.when(F.col("id") % 6 < 4, "train").otherwise("val").alias("split")
    )
    got = S.patches_per_split(df, "split", ["room"], 3, "id").groupBy("room").count().collect()
    assert {r.room: r["count"] for r in got} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 2, 5: 2}


def test_draw_sizes_are_even(spark):
    got = spark.range(6000).groupBy(S.draw_size(1, F.col("id")).alias("n")).count().collect()
    assert sorted(r.n for r in got) == [1, 2, 3]
    assert all(1800 < r["count"] < 2200 for r in got)
