"""Repository listings: which repositories and paths are candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import contains_any, file_extension

# Default extensions, excluded substrings and limits.
EXTENSIONS = ["py", "js", "ts", "tsx", "jsx", "c", "cpp", "h", "hpp", "sh", "rs", "go", "java", "kt"]
EXCLUDE_DIRS = [
    ".git", "node_modules", "dist", "build", "venv", ".venv", "site-packages", "__pycache__",
    ".next", "out", "coverage", ".cache",
]
MAX_REPOS = 8


def drop_forks(repos: DataFrame, include_forks: bool = False) -> DataFrame:
    return repos if include_forks else repos.filter(~F.coalesce("fork", F.lit(False)))


def filter_names(
    df: DataFrame, allow: list[str] = (), block: list[str] = (), name: str = "name"
) -> DataFrame:
    """Block list first, then allow list; both match substrings and an empty list sets no limit."""
    kept = df.filter(~contains_any(F.col(name), list(block)))
    return kept.filter(contains_any(F.col(name), list(allow))) if allow else kept


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where any of the columns is NULL or '' go."""
    for c in columns:
        df = df.filter(F.coalesce(F.col(c), F.lit("")) != "")
    return df


def fill_defaults(repos: DataFrame, user: str, owner: str = "owner", ref: str = "ref") -> DataFrame:
    """Owner falls back to the user; a missing or empty branch to ``main``."""
    return repos.withColumns(
        {
            owner: F.coalesce(F.col(owner), F.lit(user)),
            ref: F.coalesce(F.nullif(F.col(ref), F.lit("")), F.lit("main")),
        }
    )


def recent_key(pushed: Column, updated: Column) -> Column:
    """Sort key as text: the push time, else the update time, else ''."""
    return F.coalesce(F.nullif(pushed, F.lit("")), F.nullif(updated, F.lit("")), F.lit(""))


def most_recent(
    repos: DataFrame, k: int = MAX_REPOS, pushed: str = "pushed_at", updated: str = "updated_at",
    tie: str = "name",
) -> DataFrame:
    """The ``k`` repositories touched last; equal times are settled by name."""
    return repos.orderBy(recent_key(F.col(pushed), F.col(updated)).desc(), F.col(tie)).limit(k)


def tree_entries(repos: DataFrame) -> DataFrame:
    """One row per entry of the nested tree."""
    entry = repos.withColumn("entry", F.explode("tree")).drop("tree")
    return entry.withColumns(
        {"type": F.col("entry.type"), "path": F.coalesce("entry.path", F.lit(""))}
    ).drop("entry")


def only_files(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("type") == "blob")


def is_excluded(path: Column, exclude: list[str] = EXCLUDE_DIRS) -> Column:
    """Substring anywhere in the path, not a path segment: ``out`` also hits ``layout/``."""
    return contains_any(path, list(exclude))


def is_allowed_path(
    path: Column, extensions: list[str] = EXTENSIONS, exclude: list[str] = EXCLUDE_DIRS
) -> Column:
    """Neither empty nor excluded, and of a listed extension."""
    listed = file_extension(path).isin([e.lower() for e in extensions])
    return F.coalesce((path != "") & ~is_excluded(path, exclude) & listed, F.lit(False))
