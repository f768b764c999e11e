import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.operators import telemetry as T
from gleaner.plans.registered import telemetry as registered

UTC = dt.timezone.utc
BASE = 1704067200  # 2024-01-01


def extract(spark, lines, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    out = T.extract_readings(df, **kw).select("i", "gpu", F.unix_micros("ts").alias("us"), "util")
    return sorted(tuple(r) for r in out.collect())


def readings(spark, *objects, **kw):
    """(line, gpu, util) of objects that get a time."""
    lines = [o.replace("{", '{"ts":%d,' % BASE, 1).replace(",}", "}") for o in objects]
    return [(i, g, u) for i, g, _, u in extract(spark, lines, **kw)]


def instants(spark, *times):
    lines = ['{%s,"gpu0_util":1}' % t for t in times]
    found = {i: us for i, _, us, _ in extract(spark, lines)}
    return [found.get(i) for i in range(len(times))]


def us(*parts):
    return int(dt.datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000


def test_times(spark):
    base = BASE * 1_000_000
    got = instants(
        spark,
        '"ts":1704067200.25',
        '"ts":"2024-01-01T00:00:00Z"',
        '"ts":"1704067200"',
        '"ts":"2024"',
        '"ts":1704067200000',
        '"ts":true',
        '"ts":null,"time":1704067200',
        '"m":{"ts":1704067200}',
        '"a":{"x":1},"m":{"ts":null,"t":1704067200}',
        '"ts":"2024-01-01 02:00:00.5+02:00"',
        '"ts":"2024-01-01"',
        '"ts":"2024-01-01T01"',
        '"ts":"2024-01-01_01:30"',
        '"ts":"2024-02-30","timestamp":"nope","time":[1],"t":7',
        '"ts":NaN,"t":7',
        '"t":1,"ts":2',
        '"ts":"2024-13-01"',
        '"m":[{"ts":5}]',
        '"ts":-1.5',
        '"ts":" 7 "',
        '"ts":"2024-01-01T01+0100"',
        '"ts":"2024-01-01T01:30:00,5-01:00"',
        '"ts":Infinity,"t":7',
    )
    assert got == [
        base + 250_000, base, base, 2024 * 1_000_000, None, 1_000_000, base, base, base,
        base + 500_000, base, us(2024, 1, 1, 1), us(2024, 1, 1, 1, 30), 7_000_000, 7_000_000, 2_000_000, None, None,
        -1_500_000, 7_000_000, base, us(2024, 1, 1, 2, 30) + 500_000, 7_000_000,
    ]


def test_rounding_to_microseconds(spark):
    values = ["1704067200.1234565", "0.0000005", "1704067200.9999999"]
    want = [
        int(round(dt.datetime.fromtimestamp(float(v), UTC).timestamp() * 1_000_000)) for v in values
    ]
    assert instants(spark, *[f'"ts":{v}' for v in values]) == want


def test_utilization(spark):
    got = readings(
        spark,
        '{"gpus":[{"usage":"7","util":3}]}',
        '{"gpus":[{"gpu_util":{"gpu":10}}]}',
        '{"gpus":[{"util":true}],"x":200}',
        '{"gpus":[{"z_util":1,"a_util":2}]}',
        '{"gpus":[{"util":{"z":"n","y":8,"a":9}}]}',
        '{"gpus":[{"UTILIZATION":4.5}]}',
        '{"gpus":[{"util":{"a":"x"},"mem_usage":6}]}',
    )
    assert got == [(0, 0, 3.0), (1, 0, 10.0), (3, 0, 1.0), (4, 0, 8.0), (5, 0, 4.5), (6, 0, 6.0)]


def test_index(spark):
    got = readings(
        spark,
        '{"gpus":[{"gpu":0,"id":7,"util":1}]}',
        '{"gpus":[{"index":0,"id":7,"util":1}]}',
        '{"gpus":[{"util":1}]}',
        '{"gpus":[{"index":null,"gpu":2.9,"util":1}]}',
        '{"gpus":[{"index":"3","util":1}]}',
        '{"gpus":[{"gpu":"","id":5,"util":1}]}',
        '{"gpus":[{"index":true,"util":1}]}',
    )
    assert [g for _, g, _ in got] == [7, 0, 0, 2, 3, 5, 1]


def test_list_hides_its_siblings_only_if_it_hits(spark):
    got = readings(
        spark,
        '{"gpus":[{"index":1,"util":5}],"gpu9_util":9,"n":{"gpu8_util":8}}',
        '{"gpus":[{"index":1}],"gpu9_util":9}',
        '{"gpus":{"gpu2_util":2}}',
        '{"gpus":[5,"{\\"util\\":3}",{"index":4,"util":6},null]}',
        '{"gpus":[],"gpu1_util":1}',
    )
    assert got == [(0, 1, 5.0), (1, 9, 9.0), (2, 2, 2.0), (3, 4, 6.0), (4, 1, 1.0)]


def test_keys_and_nesting(spark):
    got = readings(
        spark,
        '{"gpu0_util":1,"GPU-4-utilization":2,"my_gpu0_util":300,"gpu_util":400}',
        '{"a":{"b":{"gpu_3_util":3}}}',
        '{"a":[{"gpu1_util":4}],"k":500}',
        '{"gpu0_util":"7","gpu1_util":true,"gpu2_util":NaN,"gpu3_util":8}',
        '{"a":{"gpus":[{"id":2,"z_util":5,"a_util":6}],"gpu9_util":9},"b":{"gpu1_util":1}}',
        '{"x y":{"it\'s":{"gpus":[{"id":6,"util":{"z":1,"a":2}}]}}}',
    )
    assert got == [(0, 0, 1.0), (0, 4, 2.0), (1, 3, 3.0), (3, 3, 8.0), (4, 1, 1.0), (4, 2, 5.0), (5, 6, 1.0)]


def test_no_depth_is_cut_off(spark):
    deep = '{"k":' * 40 + '{"gpu5_util":55}' + "}" * 40
    assert readings(spark, deep) == [(0, 5, 55.0)]


def test_lists_of_known_length(spark):
    objects = ['{"u":[1,2,3]}', '{"u":[1,2]}', '{"u":[1,"2",3]}', '{"n":{"u":[4,5,6]},"gpu7_util":7}']
    assert readings(spark, *objects, gpu_count=3) == [
        (0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (3, 0, 4.0), (3, 1, 5.0), (3, 2, 6.0), (3, 7, 7.0),
    ]
    assert readings(spark, objects[0]) == []


def test_plain_numbers(spark):
    got = readings(spark, '{"load":55,"temp":120,"on":true,"s":"9","neg":-1,"low":0,"top":100}')
    assert got == [(0, 0, 0.0), (0, 0, 55.0), (0, 0, 100.0)]


def test_lines_that_are_skipped_or_rejected(spark):
    lines = ["", "   ", "bad{", "5", "[1]", '{"ts":1,"x":1}', '{"ts":1,"x":1} y', " {\"ts\":1,\"x\":2}\t",
             '{"ts":1,"gpus":[{"index":"one","util":1}]}', '{"x":1}', "null"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.util for r in T.extract_readings(df).collect()) == [1.0, 1.0, 1.0, 2.0]
    bad = {r.text: r.reason for r in T.rejects(df).collect()}
    assert set(bad) == {"5", "[1]", "null", lines[8]}
    assert bad["5"] == "not an object" and "index" in bad[lines[8]]


@pytest.mark.parametrize("n,want", [(20, 20), (21, 21), (39, 39), (40, 20), (61, 21)])
@pytest.mark.parametrize("width", [None, 6])
def test_downsample(spark, n, want, width):
    df = spark.range(n).select(F.lit("s").alias("s"), F.col("id"))
    got = sorted(r.id for r in T.downsample(df, ["s"], ["id"], 20, width and F.floor(F.col("id") / width)).collect())
    step = max(1, n // 20) if n > 20 else 1
    assert got == list(range(0, n, step)) and len(got) == want


@pytest.mark.parametrize("width", [None, 2])
def test_downsample_of_repeated_readings(spark, width):
    rows = [(0, t % 4, float(t % 3)) for t in range(101)] + [(0, 9, 1.0)] * 60 + [(1, 1, 1.0)] * 3
    df = spark.createDataFrame(rows, "gpu bigint, ts int, util double")
    got = sorted(tuple(r) for r in T.downsample_readings(df, 20, width and F.floor(F.col("ts") / width)).collect())
    first = sorted(r for r in rows if r[0] == 0)
    assert got == sorted(first[:: len(first) // 20] + [(1, 1, 1.0)] * 3)


def test_events_of_one_row_group_are_parsed_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, None if i % 9 == 0 else dt.datetime(2024, 1, 1), i % 5, "click", float(i % 90), '{"k":%d}' % (i % 50)) for i in range(100)]
    fields = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(str, registered.telemetry_extract(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(registered, "PARSED_ROWS", 30)
    assert registered.telemetry_lines(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    assert sorted(map(str, registered.telemetry_extract(spark, str(tmp_path)).collect())) == want
