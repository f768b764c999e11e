import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators.lines import last_n
from gleaner.operators.telemetry import extract_readings, rejects
from gleaner.sources.readers import read_jsonl, stream_jsonl
from gleaner.streaming.extract import run_readings, run_with_rejects, sorted_out
from gleaner.streaming.last_lines import batches_in, compact, current_views, merged_views, run_keep_last, run_merged_last


def test_stream_of_lines_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(n):
        lines = [json.dumps({"ts": 1704067200 + i, "gpus": [{"index": n, "util": i}]}) for i in range(20)]
        (folder / f"{n}.jsonl").write_text("\n".join([*lines, "", "bad{", "5"]))

    args = (str(folder), str(tmp_path / "out"), str(tmp_path / "check"), 1)
    add(0)
    add(1)
    run_readings(spark, *args).awaitTermination()
    add(2)  # arrives after a restart
    run_readings(spark, *args).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = extract_readings(read_jsonl(spark, str(folder)))
    assert streamed.count() == 60
    assert streamed.exceptAll(batch.select(*streamed.columns)).isEmpty()


@pytest.mark.parametrize("start,views", [(run_keep_last, current_views), (run_merged_last, merged_views)])
def test_last_lines_over_batches_and_a_restart(spark, tmp_path, start, views):
    folder = str(tmp_path / "in")
    schema = "feed string, seq bigint, line string"

    def add(first, n):
        rows = spark.range(first, first + n).select(
            F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("feed"),
            F.col("id").alias("seq"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"),
        )
        rows.coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = start(spark, stream, str(tmp_path / "out"), str(tmp_path / "check"), 5)
        query.awaitTermination()

    add(0, 9)
    add(9, 40)
    run()
    add(49, 2)
    run()
    written = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    got = sorted(tuple(r) for r in views(written).collect())
    want = last_n(spark.read.schema(schema).parquet(folder), ["feed"], ["seq"], 5)
    assert got == sorted(tuple(r) for r in want.select("feed", "seq", "line").collect())
    batches = written.select("batch").distinct().count()
    assert batches == 2 if start is run_merged_last else batches >= 3


def test_rejects_of_a_stream_over_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(n):
        lines = [json.dumps({"ts": 1704067200 + i, "gpus": [{"index": n if i % 4 else "x", "util": i}]}) for i in range(20)]
        (folder / f"{n}.jsonl").write_text("\n".join([*lines, "", "bad{", "5", f"[{n}]"]))

    def run():
        run_with_rejects(stream_jsonl(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    add(0)
    add(1)
    run()
    # The last batch is repeated: its end is forgotten.
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    add(2)
    run()
    lines = read_jsonl(spark, str(folder))
    for got, want in zip(sorted_out(spark, str(tmp_path / "out")), (extract_readings(lines), rejects(lines)), strict=True):
        rows = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()))
        assert rows(got) == rows(want) and rows(got)


def test_views_start_from_a_batch_and_old_folders_go(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "feed string, seq bigint, line string"
    rows = [(f"f{i % 4}" if i % 5 else None, i, f"line {i}") for i in range(130)]
    before = spark.createDataFrame([r for r in rows if r[1] < 30] + [("old", 1, "never touched")], schema)

    def add(first, files):
        for k in range(files):
            spark.createDataFrame([r for r in rows if r[1] in (first + 2 * k, first + 2 * k + 1)], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run_keep_last(spark, stream, out, check, 5, before, every=6).awaitTermination()

    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        add(30, 20)
        run()
        assert len(batches_in(spark, out)) <= 8
        add(70, 30)
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(batches_in(spark, out)) <= 8
    got = current_views(spark.read.option("basePath", out).parquet(out))
    whole = before.unionByName(spark.read.schema(schema).parquet(folder))
    want = last_n(whole, ["feed"], ["seq"], 5)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.select("feed", "seq", "line").collect()), key=key)


def test_compaction_that_broke_off_shows_every_view_once(spark, tmp_path):
    out = str(tmp_path / "out")
    view = lambda *r: spark.createDataFrame(r, "feed string, version bigint, seq bigint, line string")
    view(("a", 1, 1, "x"), ("b", 1, 1, "y")).write.parquet(f"{out}/batch=0")
    view(("a", 2, 1, "x"), ("a", 2, 2, "z")).write.parquet(f"{out}/batch=1")
    view(("b", 1, 1, "y")).write.parquet(f"{out}/batch=-3")  # half of the merge
    (tmp_path / "out" / "batch=-3" / "_SUCCESS").unlink()
    read = lambda: sorted(map(tuple, current_views(spark.read.option("basePath", out).parquet(out)).collect()))
    want = [("a", 1, "x"), ("a", 2, "z"), ("b", 1, "y")]
    assert read() == want
    for _ in range(2):
        compact(spark, out, 2)
        assert read() == want and batches_in(spark, out) == [-3]
