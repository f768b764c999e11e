"""Large groups give the same values as moderate ones, whatever the partitioning."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.ordered import Measure, attach, first_per_group, group_rows, position, rolling, scan_groups


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(600):
        key = rng.choice(["a"] * 6 + ["b", "c", None])  # one key holds most rows
        out.append((key, rng.randrange(40), i, rng.choice([None, *range(50)])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7).cache()


def measures():
    return {
        "place": position(),
        "n": group_rows(),
        "low": Measure("min", F.col("v"), inclusive=False),
        "high": Measure("max", F.col("v"), "after"),
        "run": Measure("sum", F.col("v")),
        "rest": Measure("sum", F.col("v"), "after", inclusive=False),
        "top": Measure("max", F.struct("v", "id"), inclusive=False),
    }


def brute(rows):
    out = []
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[1], r[2]))
        for i, r in enumerate(members):
            before = [m[3] for m in members[:i] if m[3] is not None]
            upto = [m[3] for m in members[: i + 1] if m[3] is not None]
            after = [m[3] for m in members[i:] if m[3] is not None]
            later = [m[3] for m in members[i + 1 :] if m[3] is not None]
            tops = [(m[3] if m[3] is not None else -1, m[2]) for m in members[:i]]
            out.append(
                (r[2], i + 1, len(members), min(before, default=None), max(after, default=None),
                 sum(upto) if upto else None, sum(later) if later else None,
                 max(tops)[1] if tops else None)
            )
    return sorted(out)


def bucket(width):
    return None if width is None else F.floor(F.col("t") / width)


@pytest.mark.parametrize("width", [None, 100, 10, 3, 1])
def test_scan_equals_brute_force(rows, df, width):
    got = scan_groups(df, ["k"], ["t", "id"], measures(), bucket(width))
    listed = sorted(
        (r.id, r.place, r.n, r.low, r.high, r.run, r.rest, r.top.id if r.top else None) for r in got.collect()
    )
    assert listed == brute(rows)
    assert set(got.columns) == {"k", "t", "id", "v", *measures()}


@pytest.mark.parametrize("width", [None, 7])
def test_scan_without_keys(rows, df, width):
    got = scan_groups(df, [], ["t", "id"], {"place": position(), "n": group_rows()}, bucket(width))
    want = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [(r.id, r.place, r.n) for r in got.orderBy("place").collect()] == [
        (r[2], i + 1, len(rows)) for i, r in enumerate(want)
    ]


@pytest.mark.parametrize(("width", "run"), [(None, 9), (5, 10_000), (5, 40), (2, 1)])
def test_rolling_equals_one_window(df, width, run):
    got = rolling(df, ["k"], ["t", "id"], 3, {"ids": F.collect_list("id")}, bucket(width), run)
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(-3, 3)
    want = df.withColumn("ids", F.collect_list("id").over(w))
    assert sorted((r.id, r.ids) for r in got.collect()) == sorted((r.id, r.ids) for r in want.collect())


def test_attach_keeps_every_row(df):
    per_key = df.groupBy("k").agg(F.max("id").alias("last"))
    got = attach(df, per_key, ["k"])
    want = df.withColumn("last", F.max("id").over(W.partitionBy("k")))
    assert sorted((r.id, r.last) for r in got.collect()) == sorted((r.id, r.last) for r in want.collect())


def test_nothing_runs_before_the_action(spark, df):
    spark.sparkContext.setJobGroup("plans", "")
    scan_groups(df, ["k"], ["t", "id"], measures(), bucket(5))
    rolling(df, ["k"], ["t", "id"], 3, {"ids": F.collect_list("id")}, bucket(5))
    first_per_group(df, ["k"], [F.col("id")], 5, F.col("id"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_input_is_shuffled_once(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "t"))
    got = scan_groups(spark.read.parquet(str(tmp_path / "t")), ["k"], ["t", "id"], {"place": position()}, bucket(5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2  # the second is the same exchange, reused at run time
