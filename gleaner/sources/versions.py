"""Published versions: a set of files that readers see as a whole or not at all.

A set is written to a folder of its own below ``versions``, whatever number of tables it has. Then a small file that
names the folder is renamed to the next number below ``published``: one rename to a name that must not exist, so it
happens or not, and of two writers one fails. Readers take the highest number. A write that breaks off leaves a folder
that nothing names; the set before stays readable, also for those that are reading it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import remove
from gleaner.sources.sinks import duplicate_names, manifest_changes

DIGITS = 12
KEEP = 2


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    system, path = _files(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Published numbers, ascending."""
    return [int(n) for n in _names(spark, f"{path}/published") if n.isdigit()]


def folder_of(spark: SparkSession, path: str, number: int) -> str:
    system, pointer = _files(spark, f"{path}/published/{number:0{DIGITS}d}")
    stream = system.open(pointer)
    try:
        return f"{path}/versions/{stream.readUTF()}"
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that readers are to use; None before the first."""
    published = numbers(spark, path)
    return folder_of(spark, path, published[-1]) if published else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = KEEP) -> int:
    """Let ``write`` fill a fresh folder, then publish it; its number. Versions but the last ``keep`` go."""
    published = numbers(spark, path)
    number = published[-1] + 1 if published else 1
    name = uuid.uuid4().hex
    write(f"{path}/versions/{name}")
    system, pending = _files(spark, f"{path}/pending/{name}")
    stream = system.create(pending, False)
    try:
        stream.writeUTF(name)
    finally:
        stream.close()
    pointer = _files(spark, f"{path}/published/{number:0{DIGITS}d}")[1]
    system.mkdirs(pointer.getParent())
    # A rename that finds its target fails; some local systems would replace it, so it is looked for too.
    if system.exists(pointer) or not system.rename(pending, pointer):
        remove(spark, f"{path}/versions/{name}")
        raise RuntimeError(f"another writer has published version {number} of {path}")
    drop_old(spark, path, keep)
    return number


def drop_old(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Remove all published versions but the last ``keep``. What no pointer names may still be in writing and stays."""
    for number in numbers(spark, path)[:-keep]:
        folder = folder_of(spark, path, number)
        remove(spark, f"{path}/published/{number:0{DIGITS}d}")
        remove(spark, folder)


def drop_unpublished(spark: SparkSession, path: str) -> int:
    """Remove what broken writes have left; only while nobody writes. How many folders went."""
    named = {folder_of(spark, path, n) for n in numbers(spark, path)}
    left = [f"{path}/versions/{n}" for n in _names(spark, f"{path}/versions")]
    gone = [f for f in left if f not in named]
    for folder in gone:
        remove(spark, folder)
    remove(spark, f"{path}/pending")
    return len(gone)


def publish_corpus(files: DataFrame, path: str) -> int:
    """``sinks.write_corpus`` as a version; files of one repository lie together, in as many files as its bytes need."""
    clash = duplicate_names(files).first()
    if clash is not None:
        raise ValueError(f"output name used {clash['n']} times: {clash['file']}")

    def write(folder: str) -> None:
        # Ranges of repository and file: a large repository covers several tasks, a small one shares its task.
        rows = files.select("repo", "file", "content").repartitionByRange("repo", "file")
        rows.sortWithinPartitions("repo").write.partitionBy("repo").parquet(folder)

    return publish(files.sparkSession, path, write)


def publish_if_changed(new: DataFrame, path: str, keys: list[str]) -> bool:
    """Publish a file table if its rows differ from those of the current version."""
    spark = new.sparkSession
    before = current(spark, path)
    if before is not None:
        old = spark.read.schema(new.schema).parquet(before)
        compare = [c for c in new.columns if c not in keys]
        if manifest_changes(old, new, keys, compare).filter("state <> 'same'").isEmpty():
            return False
    publish(spark, path, lambda folder: new.write.parquet(folder))
    return True


def read_version(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame:
    """The current version, or one of the kept ones."""
    folder = current(spark, path) if number is None else folder_of(spark, path, number)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)
