import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import sliding as S
from gleaner.operators.raster import median_pool as small_pool


def lower(values):
    values = [v for v in values if v is not None]
    if any(v != v for v in values):
        return float("nan")
    return sorted(values)[(len(values) - 1) // 2] if values else None


def same(a, b):
    return a == b or (a is not None and b is not None and a != a and b != b)


def series(seed, n, nulls=0.1, nans=0.005):
    rng = random.Random(seed)
    return [None if rng.random() < nulls else float("nan") if rng.random() < nans else rng.choice([rng.uniform(-9, 9), float(rng.randrange(4))]) for _ in range(n)]


@pytest.mark.parametrize("half", [0, 1, 7, 60, 1000])
def test_places_of_a_series(half):
    for seed, n in ((1, 0), (2, 1), (3, 700)):
        values = series(seed, n, nans=0)
        places = S.rolling_places(S.Ranks(pa.array(values, pa.float64())), half)
        got = [None if p < 0 else values[p] for p in places.tolist()]
        assert got == [lower(values[max(i - half, 0) : i + half + 1]) for i in range(n)]


@pytest.mark.parametrize("width", [None, 10])
@pytest.mark.parametrize("half", [2, 40])
def test_rolling_equals_brute_force(spark, half, width):
    rows = [(s, i, v) for s, n in ((None, 90), ("a", 160), ("b", 1)) for i, v in enumerate(series(n, n))]
    df = spark.createDataFrame(rows, "s string, i int, v double").withColumn("_r", F.lit("mine"))
    got = S.rolling_median(df.repartition(3), ["s"], ["i"], "v", half, "m", width and F.floor(F.col("i") / width), run=50)
    assert got.columns == ["s", "i", "v", "_r", "m"]
    found = {(r.s, r.i): r.m for r in got.collect()}
    assert len(found) == len(rows)
    for s in (None, "a", "b"):
        own = [v for t, _, v in rows if t == s]
        for i in range(len(own)):
            assert same(found[s, i], lower(own[max(i - half, 0) : i + half + 1])), (s, i)


def test_types_are_kept(spark):
    df = spark.createDataFrame([(i, str(9 - i), i % 3, None) for i in range(9)], "i int, t string, n int, d decimal(9,2)")
    for column, want in (("t", "5"), ("n", 1), ("d", None)):
        got = S.rolling_median(df, [], ["i"], column, 100, "m")
        assert got.schema["m"].dataType == df.schema[column].dataType
        assert {r.m for r in got.collect()} == {want}
    assert S.rolling_median(df.limit(0), [], ["i"], "n", 5, "m").count() == 0


def test_memory_of_a_wide_frame_is_linear():
    import tracemalloc

    values = pa.array(np.random.default_rng(1).random(40_000))
    tracemalloc.start()
    S.rolling_places(S.Ranks(values), 5_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000 * 200  # a frame of 10,001 places per row would be 400 times as much


@pytest.mark.parametrize(
    ("kernel", "stride", "padding", "same_size", "tile"),
    [((3, 3), (1, 1), (1, 1, 1, 1), False, 4), ((5, 2), (2, 3), (1, 0, 2, 1), False, 3), ((7, 7), (1, 1), (0, 0, 0, 0), True, 256), ((1, 9), (3, 1), (0, 0, 0, 0), False, 2), ((9, 10), (1, 1), (0, 0, 0, 0), False, 5)],
)
def test_kernels_equal_the_gathered_windows(spark, kernel, stride, padding, same_size, tile):
    rows = []
    for img, (h, w) in enumerate([(9, 10), (12, 11)]):
        for ch in range(2):
            values = series(10 * img + ch, h * w, nulls=0.2 * ch, nans=0.02 * img)
            rows += [(img, ch, i // w, i % w, v) for i, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "img long, ch int, row int, col int, value double")
    args = dict(kernel=kernel, stride=stride, padding=padding, same=same_size, tile=tile)
    got, want = S.median_pool(cells, **args), small_pool(cells, **args)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    as_set = lambda df: {tuple(r)[:4]: r.value for r in df.collect()}
    a, b = as_set(got), as_set(want)
    assert set(a) == set(b) and all(same(a[k], b[k]) for k in a)


def test_large_kernel(spark):
    rng = random.Random(4)
    n = 40
    grid = [[rng.randrange(50) for _ in range(n)] for _ in range(n)]
    cells = spark.createDataFrame([(0, 0, r, c, grid[r][c]) for r in range(n) for c in range(n)], "img int, ch int, row int, col int, value int")
    got = {(r.row, r.col): r.value for r in S.median_pool(cells, kernel=(31, 25), tile=6).collect()}
    assert got == {(r, c): lower([grid[r + i][c + j] for i in range(31) for j in range(25)]) for r in range(10) for c in range(16)}


def test_holes_and_illegal_paddings_fail(spark):
    cells = spark.createDataFrame([(0, 0, r, c, 1.0) for r in range(3) for c in range(3) if r + c != 2], "img int, ch int, row int, col int, value double")
    with pytest.raises(Exception, match="misses cells"):
        S.median_pool(cells, kernel=(2, 2)).collect()
    assert S.median_pool(cells.limit(0), kernel=(2, 2)).count() == 0
