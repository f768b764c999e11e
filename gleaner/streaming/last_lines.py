"""The last lines of every feed, kept in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gleaner.operators.lines import VISIBLE_LINES, last_n
from gleaner.session import remove, ship_package
from gleaner.sources.readers import exists

# Batches after which the written views are merged, and the number of the folder of views to start from.
COMPACT_EVERY = 16
STARTED = -1

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepLast(StatefulProcessor):
    """Holds the ``n`` rows of a feed with the highest ``seq`` and shows them after every change."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "seq bigint, line string")
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.lines.get()), columns=["seq", "line"])
        # Chunk by chunk, so that a large feed is never held whole.
        for chunk in rows:
            kept = pd.concat([kept, chunk[["seq", "line"]]]).sort_values("seq", kind="stable").tail(self.n)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        self.lines.put([(int(s), l) for s, l in zip(kept["seq"], kept["line"])])
        yield kept.assign(feed=key[0], version=version)[["feed", "version", "seq", "line"]].astype(
            {"seq": "int64", "version": "int64"}
        )

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        kept = initialState.sort_values("seq", kind="stable").tail(self.n)
        self.lines.put([(int(s), l) for s, l in zip(kept["seq"], kept["line"])])
        self.version.update((0,))

    def close(self) -> None:
        pass


def cut_chunks(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The last ``n`` rows per feed of every chunk."""

    def cut(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            yield chunk.sort_values("seq", kind="stable").groupby("feed", dropna=False, sort=False).tail(n)

    return cut


def keep_last(stream: DataFrame, n: int = VISIBLE_LINES, start: DataFrame | None = None) -> DataFrame:
    """``(feed, seq, line)`` to ``(feed, version, seq, line)``: the whole view after every change.

    Chunks are cut to their last rows per feed before the shuffle, so a hot feed sends few of its rows.
    ``start`` holds views (``feed, seq, line``) that were there before, such as those of a batch job.
    """
    ship_package(stream.sparkSession)
    feed = stream.schema["feed"].dataType.simpleString()
    rows = stream.select("feed", F.col("seq").cast("bigint").alias("seq"), "line")
    return rows.mapInPandas(cut_chunks(n), rows.schema).groupBy("feed").transformWithStateInPandas(
        statefulProcessor=KeepLast(n),
        outputStructType=f"feed {feed}, version bigint, seq bigint, line string",
        outputMode="update",
        timeMode="none",
        initialState=None if start is None else views_of(start, stream, n).groupBy("feed"),
    )


def views_of(start: DataFrame, stream: DataFrame, n: int) -> DataFrame:
    feed = stream.schema["feed"].dataType
    return last_n(start.select(F.col("feed").cast(feed).alias("feed"), F.col("seq").cast("bigint").alias("seq"), "line"), ["feed"], ["seq"], n)


def run_keep_last(
    spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, n: int = VISIBLE_LINES,
    start: DataFrame | None = None, every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Write every batch of views into its own folder, so a repeated batch replaces itself.

    Every ``every`` batches the newest views of all folders before are written to one, and those folders go: there are
    never more than ``every`` + 2. Views of ``start`` are there from the beginning.
    """
    if start is not None and not exists(spark, f"{out}/batch={STARTED}/_SUCCESS") and not exists(spark, checkpoint):
        first = views_of(start, stream, n).select("feed", F.lit(0).cast("bigint").alias("version"), "seq", "line")
        first.write.mode("overwrite").parquet(f"{out}/batch={STARTED}")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number and number % every == 0:
            compact(spark, out, number)

    writer = (
        keep_last(stream, n, start)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
    )
    # A query keeps the settings it was started with; the session gets its own back.
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def compact(spark: SparkSession, out: str, number: int) -> None:
    """Merge the folders of batches before ``number`` into one, ``batch=-number - 1``, and remove them.

    They are removed only when it is complete. Until then some views are there twice, with one version;
    ``current_views`` takes one. A repeated batch finds the merged folder complete and only goes on removing.
    """
    merged = -number - 1
    old = [b for b in batches_in(spark, out) if b < number and b != merged]
    if not exists(spark, f"{out}/batch={merged}/_SUCCESS"):
        written = spark.read.option("basePath", out).parquet(*[f"{out}/batch={b}" for b in old])
        newest_views(written).drop("batch").write.mode("overwrite").parquet(f"{out}/batch={merged}")
    for b in old:
        remove(spark, f"{out}/batch={b}")


def batches_in(spark: SparkSession, out: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def newest_views(written: DataFrame) -> DataFrame:
    newest = written.groupBy("feed").agg(F.max(F.struct("version", "batch")).alias("newest"))
    place = newest.select("feed", "newest.version", "newest.batch")
    own = [written[c].eqNullSafe(place[c]) for c in ("feed", "version", "batch")]
    return written.join(place, own[0] & own[1] & own[2], "left_semi")


def current_views(written: DataFrame) -> DataFrame:
    """The newest view of each feed."""
    return newest_views(written).select("feed", "seq", "line")


def run_merged_last(
    spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, n: int = VISIBLE_LINES
) -> StreamingQuery:
    """The same views for feeds of very uneven weight, without keyed state.

    Every batch is cut to its last ``n`` rows per feed before its shuffle and merged with the views
    of the batch before. A repeated batch starts from the same views and writes the same ones.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = last_n(batch.select("feed", "seq", "line"), ["feed"], ["seq"], n)
        if number > 0:
            before = spark.read.schema(rows.schema).parquet(f"{out}/batch={number - 1}")
            rows = last_n(rows.unionByName(before), ["feed"], ["seq"], n)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number > 1:  # the one before is what a repeated batch starts from; older ones are not needed
            remove(spark, f"{out}/batch={number - 2}")

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged_views(written: DataFrame) -> DataFrame:
    """The views of the last batch."""
    newest = written.agg(F.max("batch").alias("batch"))  # one row
    return written.join(F.broadcast(newest), "batch").select("feed", "seq", "line")
