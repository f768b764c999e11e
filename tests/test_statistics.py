import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.vectors import lower_median, softmax
from gleaner.operators import curves as C
from gleaner.operators import raster as G
from gleaner.operators import spread as S
from gleaner.operators.matching import name_classes, nearest_sync, read_before_write, top_classes


def pooled(image, kernel, stride, pads):
    left, right, top, bottom = pads
    padded = np.pad(image, ((top, bottom), (left, right)), mode="reflect")
    rows = (padded.shape[0] - kernel[0]) // stride[0] + 1
    cols = (padded.shape[1] - kernel[1]) // stride[1] + 1
    out = {}
    for r in range(rows):
        for c in range(cols):
            w = padded[r * stride[0] : r * stride[0] + kernel[0], c * stride[1] : c * stride[1] + kernel[1]]
            out[r, c] = float(np.sort(w, axis=None)[(w.size - 1) // 2])
    return out


def same(size, kernel, stride):
    over = size % stride
    total = max(kernel - (stride if over == 0 else over), 0)
    return total // 2, total - total // 2


def cells_of(spark, images):
    rows = [
        (i, ch, r, c, float(img[r, c]))
        for i, img in enumerate(images) for ch in (0, 1)
        for r in range(img.shape[0]) for c in range(img.shape[1])
    ]
    return spark.createDataFrame(rows, "img int, ch int, row int, col int, value double")


@pytest.mark.parametrize(
    "kernel,stride,pads,same_flag,tile",
    [
        ((3, 3), (1, 1), (0, 0, 0, 0), False, 256),
        ((3, 3), (1, 1), (0, 0, 0, 0), True, 4),
        ((2, 2), (1, 1), (1, 0, 0, 1), False, 3),
        ((2, 3), (2, 3), (2, 1, 1, 2), False, 2),
        ((5, 4), (3, 2), (0, 0, 0, 0), True, 2),
        ((1, 1), (2, 2), (0, 0, 0, 0), False, 2),
    ],
)
def test_median_pool(spark, kernel, stride, pads, same_flag, tile):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 50, (9, 7)), rng.integers(0, 50, (6, 11))]
    got = G.median_pool(
        cells_of(spark, images), kernel=kernel, stride=stride, padding=pads, same=same_flag, tile=tile,
    )
    found = {(r.img, r.ch, r.row, r.col): r.value for r in got.collect()}
    want = {}
    for i, img in enumerate(images):
        p = pads
        if same_flag:
            top, bottom = same(img.shape[0], kernel[0], stride[0])
            left, right = same(img.shape[1], kernel[1], stride[1])
            p = (left, right, top, bottom)
        for (r, c), v in pooled(img, kernel, stride, p).items():
            for ch in (0, 1):
                want[i, ch, r, c] = v
    assert found == want


def test_lower_median_of_four(spark):
    assert spark.range(1).select(lower_median(F.array(*map(F.lit, [4, 1, 3, 2])))).first()[0] == 2


def test_padding_must_fit(spark):
    cells = cells_of(spark, [np.zeros((2, 5)), np.zeros((4, 4))])
    bad = G.illegal_padding(cells, ["img"], (3, 3), (1, 1), (1, 1, 2, 2))
    assert [r.img for r in bad.collect()] == [0]


def test_holes_are_reported(spark):
    cells = cells_of(spark, [np.zeros((2, 3)), np.zeros((2, 2))]).filter("not (img = 1 and ch = 0 and col = 0 and row = 1)")
    assert [(r.img, r.ch) for r in G.incomplete_grids(cells, ["img"], ["ch"]).collect()] == [(1, 0)]


@pytest.mark.parametrize("same_flag", [False, True])
def test_any_columns_can_be_pruned(spark, same_flag):
    got = G.median_pool(cells_of(spark, [np.arange(25.0).reshape(5, 5)]), same=same_flag)
    n = 2 * (25 if same_flag else 9)
    assert got.count() == n and got.filter("row = 0").select("img", "col").count() == n // (5 if same_flag else 3)
    for c in got.columns:
        assert len(got.select(c).collect()) == n
    assert {r["count"] for r in got.groupBy("img").count().collect()} == {n}


def test_holes_and_bad_padding_fail(spark):
    hole = cells_of(spark, [np.zeros((3, 3))]).filter("row + col > 0")
    with pytest.raises(Exception, match="misses cells"):
        G.median_pool(hole).count()
    with pytest.raises(Exception, match="padding must be smaller"):
        G.median_pool(cells_of(spark, [np.zeros((3, 3))]), padding=(4, 4, 4, 4)).count()


def test_nan_spreads_over_its_windows(spark):
    img = np.arange(9.0).reshape(3, 3)
    img[0, 0] = np.nan
    got = {(r.row, r.col): r.value for r in G.median_pool(cells_of(spark, [img]), kernel=(2, 2)).filter("ch = 0").collect()}
    assert np.isnan(got[0, 0]) and got[1, 1] == 5.0


@pytest.mark.parametrize("width", [None, 8])
def test_rolling_median(spark, width):
    rng = random.Random(3)
    values = [float(rng.randrange(100)) for _ in range(60)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, i int, v double")
    got = G.rolling_lower_median(df, ["s"], ["i"], "v", 2, bucket=width and F.floor(F.col("i") / width)).orderBy("i").collect()
    for i, r in enumerate(got):
        w = sorted(values[max(0, i - 2) : i + 3])
        assert r.rolling_median == w[(len(w) - 1) // 2]


@pytest.mark.parametrize("width", [None, 2])
def test_best_so_far(spark, width):
    losses = [5.0, 5.0, 4.0, None, 3.0, float("nan"), 2.0, float("inf")]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(losses)], "k int, epoch int, loss double")
    got = C.best_so_far(df, ["k"], ["epoch"], "loss", width and F.floor(F.col("epoch") / width)).orderBy("epoch").collect()
    assert [r.is_best for r in got] == [True, False, True, False, True, False, True, False]


@pytest.mark.parametrize("width", [None, 4])
def test_running_trigger(spark, width):
    flags = [True, False, True, True, None, True, True, True, False, True]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "epoch int, batch int, c boolean")
    got = C.running_trigger(df, ["epoch"], ["batch"], F.col("c"), 5, width and F.floor(F.col("batch") / width))
    assert sorted((r.batch, r.collapses) for r in got.collect()) == [(7, 6), (9, 7)]


@pytest.mark.parametrize("width", [None, 4])
def test_batches(spark, width):
    df = spark.range(20).select("id", F.when(F.col("id") < 10, "train").otherwise("val").alias("split"))
    got = C.assign_batches(df, ["split"], ["id"], 4, F.col("split") == "train", width and F.floor(F.col("id") / width))
    sizes = {(r.split, r.batch): r["count"] for r in got.groupBy("split", "batch").count().collect()}
    assert sizes == {("train", 0): 4, ("train", 1): 4, ("val", 0): 4, ("val", 1): 4, ("val", 2): 2}


def test_epoch_metrics(spark):
    rows = [(1, 2.0, 0.1, True), (1, 4.0, 0.3, False), (2, 1.0, 0.1, True)]
    df = spark.createDataFrame(rows, "epoch int, loss double, std double, c boolean")
    m = C.epoch_metrics(df, ["epoch"], "loss", "std", "c")
    assert sorted((r.epoch, r.n_batches, r.mean_loss, round(r.mean_std, 6), r.collapses) for r in m.collect()) == [
        (1, 2, 3.0, 0.2, 1), (2, 1, 1.0, 0.1, 1),
    ]
    assert [r.epoch for r in C.low_spread(m).collect()] == [2]


def cloud(spark, groups):
    rows = [(g, i, [float(x) for x in p]) for g, ps in groups.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "g string, id int, coord array<double>")


def test_collapse(spark):
    rng = random.Random(2)
    wide = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    nan = [[0.0, 1.0, 2.0], [float("nan"), 5.0, 6.0], [9.0, 8.0, 7.0]]
    df = cloud(spark, {"one": [[1, 2, 3]], "same": [[1, 1, 1]] * 5, "nan": nan, "wide": wide})
    got = {r.g: r for r in S.check_collapse(df, ["g"], "id", min_std=0.1).collect()}
    assert {g: r.is_collapsed for g, r in got.items()} == {"one": True, "same": True, "nan": True, "wide": False}
    pts = np.array(wide)[:, :3]
    assert math.isclose(got["wide"].std, pts.std(axis=0, ddof=1).mean(), rel_tol=1e-9)
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2) + np.eye(60) * 1e10
    assert math.isclose(got["wide"].min_dist, d.min(axis=1).mean(), rel_tol=1e-9)
    assert got["wide"].n_points == 60


def test_collapse_per_batch(spark):
    df = cloud(spark, {"a": [[0, 0, 0], [4, 4, 4]], "b": [[0, 0, 0], [2, 2, 2]], "c": [[1, 1, 1]]})
    df = df.withColumn("batch", F.when(F.col("g") == "c", 2).otherwise(1))
    got = {r.batch: r for r in S.check_collapse(df, ["batch", "g"], "id", 0.1, batch=["batch"]).collect()}
    assert math.isclose(got[1].min_dist, (math.sqrt(48) + math.sqrt(12)) / 2)
    assert (got[1].is_collapsed, got[2].is_collapsed) == (False, True)


def test_sample_is_cut_before_the_pairs(spark):
    df = cloud(spark, {"g": [[i, 0, 0] for i in range(300)]})
    got = S.sampled_distance(df, ["g"], "id", sample=100)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert "Join" not in got._jdf.queryExecution().toString()


def test_top_classes(spark):
    x = [0.5, 3.0, 3.0, -1.0, 90.0, 2.0]
    df = spark.createDataFrame([(1, x)], "id int, x array<double>")
    got = top_classes(df, "x", ["id"], 3).collect()
    assert [(r.rank, r.cat_id) for r in got] == [(1, 4), (2, 1), (3, 2)]
    p = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<float>").select(softmax(F.col("x"))).first()[0]
    e = np.exp([1.0, 2.0, 3.0])
    assert np.allclose(p, e / e.sum())
    classes = spark.createDataFrame([(4, "cat"), (1, "dog")], "cat_id int, name string")
    assert {r.name for r in name_classes(top_classes(df, "x", ["id"], 3), classes).collect()} == {"cat", "dog", None}
    assert "Exchange" not in top_classes(df, "x", ["id"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("width", [None, 12])
@pytest.mark.parametrize("span", [300, 20])
def test_nearest_sync(spark, width, span):
    rng = random.Random(8)
    left = [(rng.choice("aab"), rng.randrange(span), i) for i in range(80)]
    right = [(rng.choice("aac"), rng.randrange(span), i) for i in range(60)]
    a = spark.createDataFrame(left, "k string, t bigint, l int")
    b = spark.createDataFrame(right, "k string, t bigint, r int")
    got = nearest_sync(a, b, ["k"], "t", "l", "r", F.lit(5), width and F.floor(F.col("t") / width)).collect()
    assert len(got) == len(left)
    for row in got:
        gaps = sorted((abs(t - row.t), t, r) for k, t, r in right if k == row.k)
        if not gaps or gaps[0][0] > 5:
            assert row.matched_r is None and row.gap is None
        else:
            assert row.gap == gaps[0][0]
            assert row.matched_r == gaps[0][2]


@pytest.mark.parametrize("width", [None, 6])
def test_read_before_write(spark, width):
    rng = random.Random(5)
    reads = [(rng.choice("aab"), rng.choice("xxy"), rng.randrange(12)) for _ in range(50)]
    writes = [(rng.choice("aab"), rng.choice("xyz"), rng.randrange(4, 12)) for _ in range(12)]
    # Equal reads stay apart, each with its own answer.
    r = spark.createDataFrame(reads, "agent string, key string, pos int")
    w = spark.createDataFrame(writes, "agent string, key string, pos int")
    got = read_before_write(r, w, ["agent"], bucket=width and F.floor(F.col("pos") / width)).select("agent", "key", "pos").collect()
    want = [x for x in reads if not any(y[:2] == x[:2] and y[2] < x[2] for y in writes)]
    assert sorted(map(tuple, got)) == sorted(want)
