"""From repository listings to a cleaned sample of files and its manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.content import (
    MAX_BYTES_PER_FILE,
    TEXT_TEST_WINDOW,
    cut_bytes,
    is_text,
    payload_bytes,
    text_of,
    utc_stamp,
)
from gleaner.functions.text import safe_file_name
from gleaner.operators import repos as R
from gleaner.operators.rowwise import computed
from gleaner.operators.sampling import NUM_FILES, sample_rows
from gleaner.session import write_through
from gleaner.sources.readers import packed_files, read_contents, read_manifest, read_repositories, read_trees
from gleaner.sources.sinks import document_changed, manifest_document, write_corpus
from gleaner.sources.versions import current, publish


@dataclass(frozen=True)
class HarvestOptions:
    user: str
    seed: int | str = 0
    extensions: list[str] = field(default_factory=lambda: list(R.EXTENSIONS))
    exclude: list[str] = field(default_factory=lambda: list(R.EXCLUDE_DIRS))
    max_repos: int = R.MAX_REPOS
    num_files: int = NUM_FILES
    include_forks: bool = False
    max_bytes: int = MAX_BYTES_PER_FILE
    text_window: int = TEXT_TEST_WINDOW
    allow: list[str] = field(default_factory=list)
    block: list[str] = field(default_factory=list)


def select_repositories(repos: DataFrame, o: HarvestOptions) -> DataFrame:
    """``owner, repo, branch`` of the repositories looked into."""
    listed = R.filter_names(R.drop_forks(repos, o.include_forks), o.allow, o.block)
    recent = R.drop_missing(R.most_recent(listed, o.max_repos), "name")
    plain = recent.select(
        F.col("owner.login").alias("owner"), F.col("name").alias("repo"), F.col("default_branch").alias("branch")
    )
    return R.fill_defaults(plain, o.user, ref="branch")


def candidates(repos: DataFrame, entries: DataFrame, o: HarvestOptions) -> DataFrame:
    """Allowed files ``(owner, repo, branch, path)``. At most ``max_repos`` rows are broadcast."""
    files = R.only_files(entries).filter(R.is_allowed_path(F.col("path"), o.extensions, o.exclude))
    chosen = F.broadcast(select_repositories(repos, o))
    return of_owner(files.select(*named_owner(files), "repo", "path"), chosen, ["repo"])


def named_owner(df: DataFrame) -> list[Column]:
    owner = F.col("owner") if "owner" in df.columns else F.lit(None).cast("string")
    return [owner.alias("_owner")]


def of_owner(stored: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Join on the keys and the owner; what names no owner goes with any of them."""
    joined = stored.join(chosen, keys)
    return joined.filter(F.col("_owner").isNull() | (F.col("_owner") == F.col("owner"))).drop("_owner")


def clean_contents(picked: DataFrame, contents: DataFrame, o: HarvestOptions) -> DataFrame:
    """Join contents to the sample, then decode, cut and screen them. Nothing is refilled.

    ``contents`` is read last and only here; Spark broadcasts a sample that is small.
    """
    download = F.col("download") if "download" in contents.columns else None
    fields = [c for c in ("repo", "path", "encoding", "content", "download") if c in contents.columns]
    joined = of_owner(contents.select(*named_owner(contents), *fields), picked, ["repo", "path"])
    payload = payload_bytes(F.col("encoding"), F.col("content"), download)
    decoded = computed(joined, ["owner", "repo", "branch", "path"], {"content": payload})
    kept = decoded.filter(F.octet_length("content") > 0).withColumn(
        "content", cut_bytes(F.col("content"), o.max_bytes)
    )
    return kept.filter(is_text(F.col("content"), o.text_window)).withColumns(
        {
            "file": safe_file_name(F.col("repo"), F.col("path")),
            "bytes": F.octet_length("content").cast("bigint"),
        }
    )


def harvest(repos: DataFrame, entries: DataFrame, contents: DataFrame, o: HarvestOptions) -> DataFrame:
    """Metadata is filtered and sampled before any content is touched."""
    picked = sample_rows(candidates(repos, entries, o), o.num_files, o.seed, "owner", "repo", "branch", "path")
    return clean_contents(picked, contents, o)


def manifest_header(o: HarvestOptions) -> Column:
    """The options that a manifest records."""
    return F.struct(
        F.lit(o.user).alias("user"),
        F.lit(o.max_repos).alias("max_repos"),
        F.lit(o.num_files).alias("num_files"),
        F.lit(o.include_forks).alias("include_forks"),
        F.array(*map(F.lit, o.extensions)).cast("array<string>").alias("extensions"),
        F.array(*map(F.lit, o.exclude)).cast("array<string>").alias("exclude_dirs"),
    )


def harvest_job(
    spark: SparkSession, stored: str, out: str, o: HarvestOptions, folder: str = "samples", packed: bool = False
) -> bool:
    """From stored payloads to a corpus and its manifest; whether the manifest has changed.

    ``stored`` holds ``repositories``, ``trees`` and ``contents``, as files or ``packed``. ``folder`` and ``manifest`` are published below ``out``
    as one version, so a reader never sees one without the other; a manifest that says the same stays as it was.
    """

    def held(kind: str) -> str | DataFrame:
        return packed_files(spark, f"{stored}/{kind}") if packed else f"{stored}/{kind}"

    repos = read_repositories(spark, held("repositories"))
    entries = R.tree_entries(read_trees(spark, held("trees")))
    files = write_through(harvest(repos, entries, read_contents(spark, held("contents")), o))
    listed = files.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))
    document = manifest_document(listed, utc_stamp(F.current_timestamp()), manifest_header(o))
    before = current(spark, out)
    changed = before is None or document_changed(spark, document, f"{before}/manifest")

    def write(version: str) -> None:
        write_corpus(files, f"{version}/{folder}")
        if changed:
            document.select("value").coalesce(1).write.text(f"{version}/manifest")
        else:
            old = spark.read.text(f"{before}/manifest", wholetext=True)
            old.select(F.rtrim("value", F.lit("\n"))).write.text(f"{version}/manifest")

    publish(spark, out, write)
    return changed


def feed_files(spark: SparkSession, out: str, folder: str = "samples") -> DataFrame:
    """``file`` and ``text`` of what the published manifest below ``out`` lists, for a line feed."""
    version = current(spark, out)
    listed = read_manifest(spark, f"{version}/manifest").select("file", F.col("repo").alias("_repo"))
    corpus = spark.read.schema("repo string, file string, content binary").parquet(f"{version}/{folder}")
    texts = corpus.select(F.concat(F.lit(f"{folder}/"), "file").alias("file"), text_of(F.col("content")).alias("text"))
    return listed.join(texts, "file").select("file", "text")
