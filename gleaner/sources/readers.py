"""Stored documents, files and lines as DataFrames.

What is stored as many small files may be a path or pattern, or a pack: a table with a row per file, ``file`` (its path)
and ``value`` (its text). Opening a file costs far more than parsing a small document, so many share one in a pack.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.sources import schemas


def exists(spark: SparkSession, path: str | DataFrame) -> bool:
    """Whether a path or pattern matches anything on whatever file system it names; a pack is there."""
    if isinstance(path, DataFrame):
        return True
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """The pack that ``sinks.pack_files`` has written."""
    return spark.read.schema("file string, value string").parquet(path)


def whole_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``file`` and ``value``, the whole text, of each file that is not empty."""
    if isinstance(path, DataFrame):
        return path.select("file", "value").filter("value <> ''")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def opened_documents(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """Files of one JSON object each: ``file``, the ``document``, and the text ``broken`` where that cannot be read."""
    marked = StructType.fromDDL(schema).add("_broken", "string")
    whole = whole_files(spark, path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    document = F.when(F.ltrim(F.col("value")).startswith("{"), F.from_json("value", marked, options))
    read = whole.select("file", "value", document.alias("document"))
    is_broken = F.col("document").isNull() | F.col("document._broken").isNotNull()
    return read.select("file", "document", F.when(is_broken, F.col("value")).alias("broken"))


def read_documents(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """One JSON document per file. A missing path gives no rows; a broken document is dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    opened = opened_documents(spark, path, schema).filter(F.col("broken").isNull())
    return opened.select(*[F.col(f"document.`{c}`").alias(c) for c in StructType.fromDDL(schema).names])


def opened_payloads(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """Stored payloads with their ``path``, and the ``rows`` of those that are arrays of objects.

    The files are read whole, because a payload that is no list is empty. Elements are opened one by one,
    so that a bad one takes no other with it; it is NULL in ``rows``.
    """
    whole = whole_files(spark, path).withColumnRenamed("file", "path")
    is_list = F.ltrim(F.col("value")).startswith("[")
    texts = F.when(is_list, F.from_json("value", "array<string>"))
    fields = f"struct<{schema_fields(schema)}>"

    def opened(t: Column) -> Column:
        return F.when(F.ltrim(t).startswith("{"), F.from_json(t, fields))

    return whole.select("path", "value", F.transform(texts, opened).alias("rows"))


def read_payloads(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """One row per object of the stored payloads that are lists; other payloads are empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    opened = opened_payloads(spark, path, schema).select(F.explode("rows").alias("r"))
    return opened.filter(F.col("r").isNotNull()).select("r.*")


def dropped_payloads(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """``path`` and ``reason`` of payloads that give no rows, or not all of theirs."""
    opened = opened_payloads(spark, path, schema)
    reason = F.when(F.col("rows").isNull(), "no list").when(F.exists("rows", lambda r: r.isNull()), "broken element")
    return opened.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def schema_fields(schema: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def read_repositories(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_payloads(spark, path, schemas.REPOSITORIES)


def read_trees(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One stored listing per file, ``{repo, tree: [..]}``; a payload that is no object is empty."""
    return read_documents(spark, path, schemas.TREES).filter(F.col("repo").isNotNull())


def read_contents(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One stored content payload per file: ``owner, repo, path, encoding, content, download`` (bytes).

    A payload that is a list, which is what a folder gives, has no content and is dropped.
    """
    payloads = read_documents(spark, path, schemas.CONTENTS).filter(F.col("path").isNotNull())
    return payloads.withColumn("download", F.try_to_binary("download", F.lit("base64")))


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """File contents as bytes: ``path``, ``content``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .load(path)
        .select("path", "content")
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """File contents as text: ``path``, ``text``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def without_broken_bytes(line):
    """Drop byte sequences that are no UTF-8."""
    # Genuine replacement characters are set aside while the broken bytes become such.
    mark, spare = F.lit("\ufffd"), F.lit("\x00\ufdd0\x00")
    kept = F.replace(F.make_valid_utf8(F.replace(line, mark, spare)), mark, F.lit(""))
    return F.when(F.is_valid_utf8(line), line).otherwise(F.replace(kept, spare, mark))


def non_blank(lines: DataFrame) -> DataFrame:
    valid = lines.withColumn("value", without_broken_bytes(F.col("value")))
    return valid.filter(F.col("value").rlike(r"[^\s\x1C-\x1F\x{85}\p{Z}]"))


def read_jsonl(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Non-blank lines of JSON-lines files. ``max_lines`` keeps the first ones, counting malformed ones too."""
    return first_lines(spark, path, max_lines).select("value") if max_lines else non_blank(spark.read.text(path))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``place`` (from 1) and ``value`` of the first ``n`` non-blank lines, files in the order of their paths.

    Files are opened in growing runs until they hold enough. Lines are counted per split; the running sum over the
    splits tells which of them are needed and where each begins, and only their lines are numbered.
    """
    files = sorted(spark.read.text(path).inputFiles())

    def opened(upto: int) -> DataFrame:
        at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
        # The number of a row grows along its split, so it is taken before any row is left out.
        return non_blank(spark.read.text(files[:upto]).select("value", at.alias("split"), F.monotonically_increasing_id().alias("row")))

    upto, held = 0, 0
    while held < n and upto < len(files):
        upto = min(max(2 * upto, 1), len(files))
        held = opened(upto).limit(n).count()
    lines = opened(upto) if files else non_blank(spark.createDataFrame([], "value string, split struct<file: string, begin: long>, row long"))
    before = W.orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("split").agg(F.count("*").alias("lines"))
    needed = splits.select("split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before")).filter(F.col("before") < n)
    own = F.row_number().over(W.partitionBy("split").orderBy("row"))
    placed = lines.join(needed, "split").select((F.col("before") + own).alias("place"), "value")
    return placed.filter(F.col("place") <= n)


def stream_jsonl(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The same lines as a stream over a growing folder."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return non_blank(reader.text(folder))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """File records of a manifest, one row each."""
    manifest = read_documents(spark, path, schemas.MANIFEST)
    return manifest.select(F.explode("files").alias("f")).select("f.*")


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """A bare JSON array of strings, one row each."""
    if not exists(spark, path):
        return spark.createDataFrame([], "pos int, line string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "line"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, schemas.LINKS).select(F.explode("links").alias("l")).select("l.*")


def job_of(file: Column) -> Column:
    """Job id: the folder a result file lies in."""
    return F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)


def in_job_folders(root: str | DataFrame, name: str) -> str | DataFrame:
    """Files of a name, which may hold ``*`` and ``?``, in the folders right below ``root``; paths in a pack begin there."""
    if not isinstance(root, DataFrame):
        return f"{root}/*/{name}"
    wanted = "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c) for c in name)
    return root.filter(F.col("file").rlike(rf"^[^/]+/{wanted}\z"))


def read_job_documents(spark: SparkSession, pattern: str | DataFrame, schema: str) -> DataFrame:
    """One document per job folder, with ``job_id`` from the path; broken ones count as missing."""
    fields = StructType.fromDDL(schema)
    if not exists(spark, pattern):
        return spark.createDataFrame([], StructType([StructField("job_id", StringType()), *fields.fields]))
    opened = opened_documents(spark, pattern, schema).filter(F.col("broken").isNull())
    return opened.select(
        job_of(F.col("file")).alias("job_id"), *[F.col(f"document.`{c}`").alias(c) for c in fields.names]
    )


def broken_job_documents(spark: SparkSession, pattern: str | DataFrame, schema: str) -> DataFrame:
    """``job_id`` and text of the documents that cannot be read."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "job_id string, text string")
    opened = opened_documents(spark, pattern, schema).filter(F.col("broken").isNotNull())
    return opened.select(job_of(F.col("file")).alias("job_id"), F.col("broken").alias("text"))


def read_results(spark: SparkSession, root: str | DataFrame, name: str = "results.json") -> DataFrame:
    return read_job_documents(spark, in_job_folders(root, name), schemas.JOB_RESULT)


def broken_results(spark: SparkSession, root: str | DataFrame, name: str = "results.json") -> DataFrame:
    return broken_job_documents(spark, in_job_folders(root, name), schemas.JOB_RESULT)


def read_run_summaries(spark: SparkSession, root: str | DataFrame, name: str = "run_summary.json") -> DataFrame:
    return read_job_documents(spark, in_job_folders(root, name), schemas.RUN_SUMMARY)


def read_completed_jobs(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return read_payloads(spark, path, schemas.COMPLETED_JOBS)


def lines_of(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``file`` and ``value`` of each line. A long file may lie in a pack as several rows, each of whole lines."""
    if not isinstance(path, DataFrame):
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    # The end of the last line begins no other.
    ended = F.regexp_replace("value", r"(\r\n|\r|\n)\z", "")
    return path.filter("value <> ''").select("file", F.explode(F.split(ended, r"\r\n|\r|\n")).alias("value"))


def read_log_markers(spark: SparkSession, pattern: str | DataFrame, marker: str) -> DataFrame:
    """Jobs whose worker log holds a marker, with the number of its lines."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "job_id string, marker_lines bigint")
    lines = lines_of(spark, pattern).select("value", job_of(F.col("file")).alias("job_id"))
    return (
        lines.filter(F.contains(F.col("value"), F.lit(marker)))
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("marker_lines"))
    )
