"""Session settings and the shared folder that holds written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Tables written by this process and not dropped yet.
WRITTEN: list[str] = []


def build_session(app: str, cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="gleaner-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A fresh path for an intermediate table; ``drop_written`` removes it."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def write_through(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove intermediate tables, those from place ``since`` of ``WRITTEN`` on but ``keep``.

    Only once nothing that reads them is still needed.
    """
    for name in WRITTEN[since:]:
        if name not in keep:
            remove(spark, name)
            WRITTEN.remove(name)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, for functions that run in Python there. Once per session."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gleaner-")) / "gleaner-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._gleaner_shipped = True
