"""From raw documents to token ids: quality rules, line dedup, near dedup, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes each one as Parquet below
the shared folder and reads it again for the next. All but the last return the columns of ``documents``.

* Quality rules: documents that fail are dropped.
* Line dedup: lines that are boilerplate of their source are cut out of the texts; documents stay.
* Near dedup: of every group of near copies (five words, 0.8) the document of smallest id stays.
* Mixing: all documents, written in the order of the schedule.
* Encoding: per document its ids (little-endian unsigned 32-bit), a digest of what they decode to, and
  its place in the mix (``part``, the written file, and ``row`` in it; null if the input is no file).

Null texts count as empty and fail the quality rules; an empty table gives an empty result; rows that
repeat a ``doc_id`` become one in near dedup; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, minhash, mixing, quality, site_lines
from gleaner.session import WRITTEN, drop_written, new_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return site_lines.without_boilerplate(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_copies(docs)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``part`` and ``row``, their place in the files that they are read from."""
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("part"), F.lit(None).cast("long").alias("row"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode(placed(docs), *bpe.vocabulary(), decoded=True, keep=("part", "row"))
    return found.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality rules", good),
    ("line dedup", without_boilerplate),
    ("near dedup", without_copies),
    ("mixing", in_mixed_order),
    ("encoding", encoded),
]

# SQL has neither the merges of the encoding nor the schedule; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        begin = len(WRITTEN)
        done = stage(spark, docs, sf_dir)
        path = new_path(spark)
        done.write.parquet(path)
        drop_written(spark, begin, keep=(path,))
        docs = spark.read.schema(done.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
