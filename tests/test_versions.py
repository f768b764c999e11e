import pytest
from pyspark.sql import functions as F

from gleaner.sources import versions as V

SCHEMA = "repo string, file string, content binary"


def files(spark, *rows):
    return spark.createDataFrame([(r, f, c.encode()) for r, f, c in rows], SCHEMA)


def seen(spark, path, number=None):
    return sorted((r.repo, r.file, r.content.decode()) for r in V.read_version(spark, path, SCHEMA, number).collect())


def test_a_write_that_fails_halfway_leaves_the_old_set(spark, tmp_path):
    path = str(tmp_path / "corpus")
    assert seen(spark, path) == [] and V.current(spark, path) is None
    first = [("a", "x", "1"), ("a", "y", "2"), ("b", "z", "3")]
    assert V.publish_corpus(files(spark, *first), path) == 1
    broken = files(spark, ("a", "x", "new"), ("b", "z", "new"), ("c", "w", "new")).repartition(3).withColumn(
        "content", F.when(F.col("repo") == "c", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    )
    with pytest.raises(Exception, match="lost"):
        # Not through the check of names, which would fail before anything is written.
        V.publish(spark, path, lambda folder: broken.write.partitionBy("repo").parquet(folder))
    assert seen(spark, path) == sorted(first) and V.numbers(spark, path) == [1]
    assert V.drop_unpublished(spark, path) == 1
    assert V.publish_corpus(files(spark, ("b", "z", "4")), path) == 2
    assert seen(spark, path) == [("b", "z", "4")]


def test_readers_of_the_version_before_are_not_disturbed(spark, tmp_path):
    path = str(tmp_path / "corpus")
    V.publish_corpus(files(spark, ("a", "x", "1")), path)
    old = V.read_version(spark, path, SCHEMA)
    V.publish_corpus(files(spark, ("a", "x", "2")), path)
    assert [r.content for r in old.collect()] == [b"1"]
    assert seen(spark, path) == [("a", "x", "2")] and seen(spark, path, 1) == [("a", "x", "1")]
    V.publish_corpus(files(spark, ("a", "x", "3")), path)
    assert V.numbers(spark, path) == [2, 3]
    assert len(list((tmp_path / "corpus" / "versions").iterdir())) == 2


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "corpus")

    def write_and_be_overtaken(folder):
        V.publish(spark, path, lambda other: files(spark, ("b", "x", "2")).write.parquet(other))
        files(spark, ("a", "x", "1")).write.parquet(folder)

    with pytest.raises(RuntimeError, match="another writer"):
        V.publish(spark, path, write_and_be_overtaken)
    assert seen(spark, path) == [("b", "x", "2")]


def test_publish_if_changed(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "repo string, path string, bytes long")
    keys = ["repo", "path"]
    assert V.publish_if_changed(rows(("r", "a", 1), ("r", "b", 2)), path, keys)
    assert not V.publish_if_changed(rows(("r", "b", 2), ("r", "a", 1)), path, keys)
    assert V.publish_if_changed(rows(("r", "a", 1), ("r", "b", 3)), path, keys)
    # The new rows may come from the version that they replace.
    again = V.read_version(spark, path, "repo string, path string, bytes long").withColumn("bytes", F.col("bytes") + 1)
    assert V.publish_if_changed(again, path, keys)
    assert sorted(r.bytes for r in V.read_version(spark, path, "repo string, path string, bytes long").collect()) == [2, 4]


def test_names_used_twice_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        V.publish_corpus(files(spark, ("a", "x", "1"), ("b", "x", "2")), str(tmp_path / "c"))
    assert V.numbers(spark, str(tmp_path / "c")) == []
