"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.telemetry import in_time_order
from gleaner.session import write_through
from gleaner.sources.readers import exists

FILE_FIELDS = ["file", "repo", "owner", "path", "branch", "bytes"]


def duplicate_names(files: DataFrame, name: str = "file") -> DataFrame:
    return files.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def write_corpus(files: DataFrame, path: str) -> None:
    """Cleaned files as ``(repo, file, content)``, the whole set at once.

    Two files of one name would overwrite each other elsewhere; here they are an error.
    """
    clash = duplicate_names(files).first()
    if clash is not None:
        raise ValueError(f"output name used {clash['n']} times: {clash['file']}")
    files.select("repo", "file", "content").write.mode("overwrite").partitionBy("repo").parquet(path)


def pack_files(files: DataFrame, path: str) -> None:
    """Small files as a pack: rows of ``file`` and ``value``, in as many files as there are tasks (see ``readers``)."""
    files.select("file", "value").write.parquet(path)


def manifest_document(files: DataFrame, generated_at: Column, source: Column, by: list[str] = ()) -> DataFrame:
    """Header and file list, ordered by name, as one row with one JSON text; one for each value of ``by``.

    One document lists the files of one sample, so its size is the sample size the caller asked for. File tables of any
    size keep the long form or go by repository and a run of files of bounded size.
    """
    records = F.sort_array(F.collect_list(F.struct(*FILE_FIELDS)))
    return files.groupBy(*by).agg(records.alias("files"), F.count(F.lit(1)).alias("n_files")).select(
        *by,
        F.to_json(
            F.struct(generated_at.alias("generated_at"), source.alias("source"), F.col("files"))
        ).alias("value"),
        "n_files",
    )


def document_changed(spark: SparkSession, document: DataFrame, path: str, ignore: str = "generated_at") -> bool:
    """Whether the one JSON text ``value`` says something else than the one stored there; the field ``ignore`` does not count."""
    if not exists(spark, path):
        return True
    told = F.to_json(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: k != ignore))
    old = spark.read.text(path, wholetext=True).select(told.alias("told"))
    return bool(document.select(told.alias("told")).exceptAll(old).head(1))


def write_document_if_changed(spark: SparkSession, document: DataFrame, path: str, ignore: str = "generated_at") -> bool:
    """Write the one JSON text ``value`` unless the one there says the same."""
    if not document_changed(spark, document, path, ignore):
        return False
    document.select("value").coalesce(1).write.mode("overwrite").text(path)
    return True


def manifest_changes(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """``added``, ``removed``, ``changed`` or ``same`` per file. The time of writing does not count."""
    before = old.select(*keys, F.struct(*compare).alias("_old"))
    after = new.select(*keys, F.struct(*compare).alias("_new"))
    both = before.join(after, keys, "full_outer")
    state = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed")
    )
    return both.select(
        *keys, state.alias("state"),
        *[F.col(f"_old.{c}").alias(f"old_{c}") for c in compare],
        *[F.col(f"_new.{c}").alias(f"new_{c}") for c in compare],
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``is_same``: whether both hold the same rows equally often."""
    columns = a.columns
    counted = a.select(*columns, F.lit(1).alias("_d")).unionByName(b.select(*columns, F.lit(-1).alias("_d")))
    differing = counted.groupBy(*columns).agg(F.sum("_d").alias("_d")).filter(F.col("_d") != 0)
    return differing.agg((F.count(F.lit(1)) == 0).alias("is_same"))


def write_if_changed(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> bool:
    """Overwrite a file table only if its rows differ from those already there."""
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        compare = [c for c in new.columns if c not in keys]
        if manifest_changes(old, new, keys, compare).filter(F.col("state") != "same").isEmpty():
            return False
    new.write.mode("overwrite").parquet(path)
    return True


def write_readings_csv(readings: DataFrame, path: str) -> None:
    """``gpu,ts,util`` in global order, over as many files as there are ranges."""
    in_time_order(readings.select("gpu", "ts", "util")).write.mode("overwrite").option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).csv(path)


def markdown_rows(report: DataFrame, order: list[str]) -> DataFrame:
    """A report as the lines of a Markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    body = report.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"),
        F.lit(2).alias("_part"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    spark = report.sparkSession
    head = spark.createDataFrame(
        [("| " + " | ".join(report.columns) + " |", 0), ("|" + " --- |" * len(report.columns), 1)],
        "value string, _part int",
    )
    rows = head.unionByName(body, allowMissingColumns=True)
    return rows.orderBy("_part", *[f"_o{i}" for i in range(len(order))]).select("value")


def write_report(report: DataFrame, path: str, order: list[str]) -> None:
    """One report in three formats. It is made once, not for each format and for each of their sorts."""
    report = write_through(report)
    report.orderBy(*order).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    report.orderBy(*order).write.mode("overwrite").json(f"{path}/json")
    markdown_rows(report, order).write.mode("overwrite").text(f"{path}/md")
