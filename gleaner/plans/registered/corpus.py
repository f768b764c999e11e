"""Pages and documents as a file corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.content import MAX_BYTES_PER_FILE, TEXT_TEST_WINDOW, cut_bytes, is_text, payload_bytes
from gleaner.functions.text import (
    comma_list,
    file_extension,
    is_foreign_origin,
    is_http_link,
    link_host,
    safe_file_name,
)
from gleaner.operators import repos as R
from gleaner.operators.rowwise import computed
from gleaner.operators.sampling import sample_rows
from gleaner.plans.harvest import HarvestOptions, candidates, harvest
from gleaner.plans.registered import table
from gleaner.sources.sinks import manifest_changes, manifest_document, same_rows

PAGE_EXTENSIONS = ["html", "htm"]
# Document ids that one manifest document covers.
MANIFEST_RUN = 4096
HOST = r"^[a-z]+://([^/?#]+)"
PATH = r"^[a-z]+://[^/?#]+/([^?#]*)"


def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return sample_rows(docs, 100, 42, "doc_id")


def path_filter(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        file_extension(url).alias("extension"),
        R.is_excluded(url).alias("is_excluded"),
        R.is_allowed_path(url, PAGE_EXTENSIONS).alias("is_allowed"),
    )


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", safe_file_name(F.regexp_extract(url, HOST, 1), url).alias("file")
    )


def comma_items(spark: SparkSession, folder: str) -> DataFrame:
    items = comma_list(F.col("text"), lower=True)
    return table(spark, folder, "documents").select("doc_id", "text").select(
        "doc_id", F.size(items).cast("bigint").alias("n_items"), F.md5(F.concat_ws("|", items)).alias("items_md5")
    )


def text_bytes(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b64"))
    content = payload_bytes(F.lit("base64"), F.col("b64"))
    return (
        computed(stored, ["doc_id"], {"content": content})
        .filter(F.octet_length("content") > 0)
        .select("doc_id", F.octet_length("content").alias("whole"), cut_bytes(F.col("content"), MAX_BYTES_PER_FILE).alias("kept"))
        .select(
            "doc_id",
            F.col("whole").cast("bigint").alias("whole_bytes"),
            F.octet_length("kept").cast("bigint").alias("kept_bytes"),
            is_text(F.col("kept"), TEXT_TEST_WINDOW).alias("is_text"),
        )
    )


def recent_topk(spark: SparkSession, folder: str) -> DataFrame:
    last = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("pushed_at"))
    )
    listed = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), "c_mktsegment", (F.col("c_acctbal") < 0).alias("fork")
    )
    kept = R.filter_names(
        R.drop_forks(listed), allow=["build", "MACHINE", "furn"], block=["furniture"], name="c_mktsegment"
    )
    dated = kept.join(last, "c_custkey", "left").withColumns(
        {"updated_at": F.lit(""), "owner": F.lit(None).cast("string"), "ref": F.nullif("c_mktsegment", F.lit("MACHINERY"))}
    )
    top = R.drop_missing(R.most_recent(dated), "name")
    return R.fill_defaults(top, "someone").select("name", "pushed_at", "owner", "ref")


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, folder, "pages").select(
        "page_id", F.col("url").alias("page"), F.posexplode(links).alias("pos", "url")
    )


def external_links(spark: SparkSession, folder: str) -> DataFrame:
    links = R.drop_missing(page_links(spark, folder), "url")
    return links.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "url",
        is_http_link(F.col("url")).alias("is_http"),
        is_foreign_origin(F.col("url"), F.col("page")).alias("is_foreign"),
        F.coalesce(link_host(F.col("url")), F.lit("")).alias("host"),
    )


def page_trees(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    tree = F.transform(
        links,
        lambda u: F.struct(F.when(F.endswith(u, F.lit("/")), "tree").otherwise("blob").alias("type"), u.alias("path")),
    )
    nested = computed(table(spark, folder, "pages"), ["page_id"], {"tree": tree})
    files = R.only_files(R.tree_entries(nested))
    return (
        files.filter((F.col("path") != "") & ~R.is_excluded(F.col("path")))
        .groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("n_files"), F.max("path").alias("last_path"))
    )


def manifest_of(docs: DataFrame) -> DataFrame:
    """Long manifest of all documents."""
    path = F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".txt")))
    kept = cut_bytes(F.encode("text", "UTF-8"), MAX_BYTES_PER_FILE)
    return docs.select(
        safe_file_name(F.col("source"), path).alias("file"),
        F.col("source").alias("repo"),
        F.lit("someone").alias("owner"),
        path.alias("path"),
        F.lit("main").alias("branch"),
        F.octet_length(kept).cast("bigint").alias("bytes"),
        F.floor(F.col("doc_id") / MANIFEST_RUN).alias("run"),
    )


def corpus_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_of(table(spark, folder, "documents")).drop("run")


def manifest_json(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one repository and a run of ids each, so none grows without bound."""
    source = F.struct(F.lit("someone").alias("user"), F.lit(MANIFEST_RUN).alias("num_files"))
    return manifest_document(manifest_of(table(spark, folder, "documents")), F.lit("2024-01-01T00:00:00Z"), source, ["repo", "run"])


def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = F.octet_length(F.encode("text", "UTF-8")).cast("bigint").alias("size")
    old = docs.filter(F.col("lang") != "es").select("doc_id", size)
    new = docs.filter(F.col("lang") != "fr").select("doc_id", F.col("n_chars").alias("size"))
    return manifest_changes(old, new, ["doc_id"], ["size"])


def manifest_equal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "lang", F.length("text").alias("n"))
    counted = table(spark, folder, "documents").select("source", "lang", F.col("n_chars").cast("int").alias("n"))
    shifted = counted.withColumn("n", F.col("n") + (F.col("lang") == "es").cast("int"))
    return (
        same_rows(docs, counted)
        .withColumn("pair", F.lit("counted"))
        .unionByName(same_rows(docs, shifted).withColumn("pair", F.lit("shifted")))
    )


def pages_as_repositories(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hosts as repositories, pages as their files."""
    pages = table(spark, folder, "pages").select(
        F.regexp_extract("url", HOST, 1).alias("repo"),
        F.concat_ws("/", "page_id", F.regexp_extract("url", PATH, 1)).alias("path"),
        "page_id",
        "html",
    )
    repos = pages.groupBy(F.col("repo").alias("name")).agg(
        F.startswith(F.first("repo"), F.lit("m.")).alias("fork"),
        F.struct(F.lit(None).cast("string").alias("login")).alias("owner"),
        F.lit("").alias("default_branch"),
        F.lpad(F.max("page_id").cast("string"), 12, "0").alias("pushed_at"),
        F.lit(None).cast("string").alias("updated_at"),
    )
    entries = pages.select(
        "repo",
        "path",
        F.when(F.endswith(F.col("path"), F.lit("/")), "tree").otherwise("blob").alias("type"),
    )
    contents = pages.select(
        "repo", "path", F.lit("base64").alias("encoding"), F.base64(F.encode("html", "UTF-8")).alias("content")
    )
    return repos, entries, contents


PAGE_OPTIONS = HarvestOptions(
    user="someone", seed=3, extensions=PAGE_EXTENSIONS, max_repos=40, num_files=16, block=["spam"]
)


def harvest_candidates(spark: SparkSession, folder: str) -> DataFrame:
    repos, entries, _ = pages_as_repositories(spark, folder)
    return candidates(repos, entries, PAGE_OPTIONS)


def harvest_pages(spark: SparkSession, folder: str) -> DataFrame:
    return harvest(*pages_as_repositories(spark, folder), PAGE_OPTIONS).select(
        "owner", "repo", "branch", "path", "file", "bytes", F.md5("content").alias("content_md5")
    )


QUERIES = {
    f.__name__: f
    for f in (
        seeded_sample, path_filter, safe_names, comma_items, text_bytes, recent_topk, external_links, page_trees,
        corpus_manifest, manifest_json, manifest_diff, manifest_equal, harvest_candidates, harvest_pages,
    )
}

EXCLUDED = " OR ".join(f"contains(lower({{0}}), '{e}')" for e in R.EXCLUDE_DIRS)
BLANK = r"[\s\x0B\x{FEFF}\p{Z}]"

SAFE = (
    r"regexp_replace({0}, '[^A-Za-z0-9._-]+', '-', 'g') || '__' || "
    r"replace(regexp_replace({1}, '[^A-Za-z0-9._/-]+', '-', 'g'), '/', '__')"
)

MANIFEST_SQL = f"""
    SELECT {SAFE.format("source", "lang || '/' || doc_id || '.txt'")} AS file, source AS repo,
           'someone' AS owner, lang || '/' || doc_id || '.txt' AS path, 'main' AS branch,
           CAST(least(octet_length(encode(text)), 65536) AS BIGINT) AS bytes
    FROM documents
"""

PAGES_SQL = rf"""
    p AS (
        SELECT regexp_extract(url, '{HOST}', 1) AS repo,
               page_id || '/' || regexp_extract(url, '{PATH}', 1) AS path, page_id, html FROM pages
    ),
    r AS (
        SELECT repo, lpad(CAST(max(page_id) AS VARCHAR), 12, '0') AS pushed FROM p
        WHERE NOT starts_with(repo, 'm.') AND NOT contains(repo, 'spam')
        GROUP BY repo ORDER BY pushed DESC, repo LIMIT 40
    ),
    c AS (
        SELECT 'someone' AS owner, p.repo, 'main' AS branch, p.path, p.html FROM p JOIN r USING (repo)
        WHERE NOT ends_with(p.path, '/') AND NOT ({EXCLUDED.format("p.path")})
          AND lower(regexp_extract(p.path, '\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm')
    )
"""

HREFS_SQL = """
    SELECT page_id, url AS page, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url,
           unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages
"""

SQL = {
    "seeded_sample": """
        SELECT doc_id, source, n_chars FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100
    """,
    "path_filter": rf"""
        WITH e AS (
            SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS extension,
                   ({EXCLUDED.format("url")}) AS is_excluded FROM pages
        )
        SELECT page_id, extension, is_excluded,
               NOT is_excluded AND extension IN ('html', 'htm') AS is_allowed FROM e
    """,
    "safe_names": f"""
        SELECT page_id, {SAFE.format(f"regexp_extract(url, '{HOST}', 1)", "url")} AS file FROM pages
    """,
    "comma_items": rf"""
        WITH i AS (
            SELECT doc_id, list_filter(
                list_transform(string_split(text, ','),
                    lambda x: lower(regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g'))),
                lambda x: x <> '') AS items FROM documents
        )
        SELECT doc_id, CAST(len(items) AS BIGINT) AS n_items,
               md5(coalesce(array_to_string(items, '|'), '')) AS items_md5 FROM i
    """,
    "text_bytes": """
        WITH h AS (
            SELECT doc_id, octet_length(encode(text)) AS n, substr(hex(encode(text)), 1, 2 * 65536) AS h
            FROM documents WHERE octet_length(encode(text)) > 0
        ), b AS (
            SELECT doc_id, n, regexp_extract_all(h, '..') AS bytes FROM h
        )
        SELECT doc_id, CAST(n AS BIGINT) AS whole_bytes, CAST(len(bytes) AS BIGINT) AS kept_bytes,
               NOT list_contains(bytes, '00')
               AND len(list_filter(bytes[1:4096], lambda x: x < '09' OR (x > '0D' AND x < '20')))
                   / greatest(1, least(4096, len(bytes))) < 0.02 AS is_text FROM b
    """,
    "recent_topk": """
        WITH last AS (
            SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS pushed_at FROM orders GROUP BY 1
        )
        SELECT c_name AS name, pushed_at, 'someone' AS owner,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'main' ELSE c_mktsegment END AS ref
        FROM customer LEFT JOIN last ON c_custkey = o_custkey
        WHERE c_acctbal >= 0 AND NOT contains(lower(c_mktsegment), 'furniture')
          AND (contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'machine')
               OR contains(lower(c_mktsegment), 'furn'))
        ORDER BY coalesce(pushed_at, '') DESC, c_name LIMIT 8
    """,
    "external_links": rf"""
        WITH l AS ({HREFS_SQL}), s AS (
            SELECT page_id, pos, url,
                   lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch,
                   lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS auth,
                   lower(regexp_extract(page, '^([a-z]+)://', 1)) AS own_sch,
                   lower(regexp_extract(page, '{HOST}', 1)) AS own_auth
            FROM l WHERE url <> ''
        )
        SELECT page_id, CAST(pos AS BIGINT) AS pos, url,
               starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_http,
               CASE WHEN sch = '' AND auth = '' THEN false
                    ELSE (CASE WHEN sch = '' THEN own_sch ELSE sch END) <> own_sch OR auth <> own_auth
               END AS is_foreign,
               auth AS host FROM s
    """,
    "page_trees": f"""
        WITH l AS ({HREFS_SQL})
        SELECT page_id, count(*) AS n_files, max(url) AS last_path FROM l
        WHERE NOT ends_with(url, '/') AND url <> '' AND NOT ({EXCLUDED.format("url")}) GROUP BY page_id
    """,
    "corpus_manifest": MANIFEST_SQL,
    "manifest_json": f"""
        WITH m AS (SELECT *, CAST(split_part(split_part(path, '/', 2), '.', 1) AS BIGINT) // {MANIFEST_RUN} AS run FROM ({MANIFEST_SQL}))
        SELECT repo, run, CAST(to_json({{'generated_at': '2024-01-01T00:00:00Z',
                              'source': {{'user': 'someone', 'num_files': {MANIFEST_RUN}}},
                              'files': list({{'file': file, 'repo': repo, 'owner': owner, 'path': path,
                                              'branch': branch, 'bytes': bytes}} ORDER BY file)}}) AS VARCHAR) AS value,
               count(*) AS n_files FROM m GROUP BY repo, run
    """,
    "manifest_diff": """
        WITH old AS (
            SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE lang <> 'es'
        ), new AS (
            SELECT doc_id, n_chars AS size FROM documents WHERE lang <> 'fr'
        )
        SELECT coalesce(old.doc_id, new.doc_id) AS doc_id,
               CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed'
                    WHEN old.size IS NOT DISTINCT FROM new.size THEN 'same' ELSE 'changed' END AS state,
               old.size AS old_size, new.size AS new_size
        FROM old FULL OUTER JOIN new ON old.doc_id = new.doc_id
    """,
    "manifest_equal": """
        WITH a AS (SELECT source, lang, length(text) AS n FROM documents),
             b AS (SELECT source, lang, n_chars AS n FROM documents),
             s AS (SELECT source, lang, n_chars + CAST(lang = 'es' AS INT) AS n FROM documents)
        SELECT 'counted' AS pair,
               (SELECT count(*) FROM ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a))) = 0 AS is_same
        UNION ALL
        SELECT 'shifted',
               (SELECT count(*) FROM ((FROM a EXCEPT ALL FROM s) UNION ALL (FROM s EXCEPT ALL FROM a))) = 0
    """,
    "harvest_candidates": f"WITH {PAGES_SQL} SELECT owner, repo, branch, path FROM c",
    "harvest_pages": f"""
        WITH {PAGES_SQL}, k AS (
            SELECT * FROM c ORDER BY md5('3|someone|' || repo || '|main|' || path), owner, repo, branch, path LIMIT 16
        )
        SELECT owner, repo, branch, path, {SAFE.format("repo", "path")} AS file,
               CAST(least(octet_length(encode(html)), 65536) AS BIGINT) AS bytes,
               CASE WHEN octet_length(encode(html)) <= 65536 THEN md5(html)
                    ELSE md5(unhex(substr(hex(encode(html)), 1, 131072))) END AS content_md5
        FROM k WHERE octet_length(encode(html)) > 0
    """,
}
