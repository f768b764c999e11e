"""Embeddings as class scores, point clouds and small images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import sliding
from gleaner.operators.matching import name_classes, top_classes
from gleaner.operators.raster import median_pool
from gleaner.operators.spread import check_collapse
from gleaner.plans.registered import table


def vector_topk_labels(spark: SparkSession, folder: str) -> DataFrame:
    classes = table(spark, folder, "part").select(F.col("p_partkey").alias("cat_id"), F.col("p_name").alias("class"))
    best = top_classes(table(spark, folder, "embeddings"), "embedding", ["vec_id"])
    named = name_classes(best.withColumn("cat_id", F.col("cat_id").cast("bigint")), classes)
    return named.select(
        "vec_id", F.col("rank").cast("bigint").alias("rank"), "cat_id", "class",
        F.round("probability", 9).alias("probability"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("coord"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("std", "min_dist")})


def spread_check(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(check_collapse(points(spark, folder), ["label"], "vec_id", min_std=0.12, seed=5))


def spread_check_batch(spark: SparkSession, folder: str) -> DataFrame:
    batched = points(spark, folder).withColumn("batch", F.col("label") % 3)
    return rounded(
        check_collapse(batched, ["batch", "label"], "vec_id", min_std=0.12, seed=5, batch=["batch"])
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as an image of 8 x 8 cells."""
    cells = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "value"))
    return cells.select(
        F.col("vec_id").alias("img"), F.col("label").alias("ch"),
        F.floor(F.col("at") / 8).cast("int").alias("row"), (F.col("at") % 8).alias("col"),
        F.col("value").cast("double").alias("value"),
    )


def grid_median(spark: SparkSession, folder: str) -> DataFrame:
    return median_pool(images(spark, folder), kernel=(3, 3), same=True)


def grid_median_strided(spark: SparkSession, folder: str) -> DataFrame:
    sized = images(spark, folder).withColumns({"height": F.lit(8), "width": F.lit(8)})
    return median_pool(sized, kernel=(2, 4), stride=(2, 3), padding=(1, 2, 0, 1))


def grid_median_padded(spark: SparkSession, folder: str) -> DataFrame:
    """Inferred size, explicit padding."""
    return median_pool(images(spark, folder), kernel=(3, 3), padding=(1, 1, 2, 2))


def grid_median_wide(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as the rows of one image, in kernels of 31 x 31 cells."""
    cells = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "value"))
    image = cells.select(
        F.lit(0).alias("img"), F.lit(0).alias("ch"), F.col("vec_id").cast("int").alias("row"), "col", F.col("value").cast("double").alias("value")
    )
    return sliding.median_pool(image, kernel=(31, 31), same=True).select("row", "col", "value")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_labels, spread_check, spread_check_batch, grid_median, grid_median_strided, grid_median_padded,
        grid_median_wide,
    )
}

SPREAD_SQL = """
    p AS (
        SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CAST(embedding[3] AS DOUBLE) AS z FROM embeddings
    ),
    s AS (
        SELECT label, count(*) AS n_points, (stddev_samp(x) + stddev_samp(y) + stddev_samp(z)) / 3 AS std
        FROM p GROUP BY label
    ),
    k AS (
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('5|' || vec_id), vec_id) <= 100
    ),
    n AS (
        SELECT a.label, a.vec_id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d
        FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL
    ),
    g AS (SELECT label, n_points, std, (SELECT avg(d) FROM n WHERE n.label = s.label) AS min_dist FROM s)
"""
VERDICT = "coalesce(std < 0.12 OR min_dist < 0.01, true) AS is_collapsed"


def pool_sql(kernel: tuple[int, int], stride: tuple[int, int], pads: tuple[int, int, int, int], out: tuple[int, int]) -> str:
    """Pull form: every output cell looks up the source cells of its window."""
    left, _, top, _ = pads

    def source(at: str) -> str:
        return f"(CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > 7 THEN 14 - ({at}) ELSE {at} END)"

    row, col = source(f"o.r * {stride[0]} + dr.i - {top}"), source(f"o.c * {stride[1]} + dc.i - {left}")
    n = kernel[0] * kernel[1]
    return f"""
        WITH cells AS (
            SELECT vec_id AS img, label AS ch, unnest(embedding) AS v, unnest(range(64)) AS at FROM embeddings
        ), o AS (
            SELECT vec_id AS img, label AS ch, rr.i AS r, cc.i AS c
            FROM embeddings, range({out[0]}) rr(i), range({out[1]}) cc(i)
        ), w AS (
            SELECT o.img, o.ch, o.r, o.c, list(cells.v) AS vs
            FROM o, range({kernel[0]}) dr(i), range({kernel[1]}) dc(i), cells
            WHERE cells.img = o.img AND cells.at = {row} * 8 + {col}
            GROUP BY ALL
        )
        SELECT img, ch, CAST(r AS INT) AS row, CAST(c AS INT) AS col,
               CAST(list_sort(vs)[({n} - 1) // 2 + 1] AS DOUBLE) AS value FROM w
    """


SQL = {
    "vector_topk_labels": """
        WITH x AS (
            SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS cat_id FROM embeddings
        ), s AS (
            SELECT vec_id, cat_id, CAST(v AS DOUBLE) AS v, max(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id) AS m FROM x
        ), q AS (
            SELECT vec_id, cat_id, v, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id) AS p FROM s
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, cat_id) AS rank FROM q
        )
        SELECT vec_id, rank, cat_id, p_name AS class, round(p, 9) AS probability
        FROM r LEFT JOIN part ON p_partkey = cat_id WHERE rank <= 5
    """,
    "spread_check": f"""
        WITH {SPREAD_SQL}
        SELECT label, n_points, round(std, 6) AS std, round(min_dist, 6) AS min_dist, {VERDICT} FROM g
    """,
    "spread_check_batch": f"""
        WITH {SPREAD_SQL}, b AS (
            SELECT label % 3 AS batch, CAST(sum(n_points) AS BIGINT) AS n_points,
                   CASE WHEN count(std) = count(*) THEN avg(std) END AS std,
                   CASE WHEN count(min_dist) = count(*) THEN avg(min_dist) END AS min_dist FROM g GROUP BY 1
        )
        SELECT batch, n_points, round(std, 6) AS std, round(min_dist, 6) AS min_dist, {VERDICT} FROM b
    """,
    "grid_median_wide": """
        WITH cells AS (
            SELECT vec_id AS r, unnest(range(len(embedding))) AS c, unnest(embedding) AS v FROM embeddings
        ), size AS (SELECT max(r) AS r, max(c) AS c FROM cells
        ), down AS (  -- rows and columns of the image under every place of a kernel
            SELECT o.r, i, CASE WHEN o.r + i < 0 THEN -(o.r + i) WHEN o.r + i > size.r THEN 2 * size.r - o.r - i ELSE o.r + i END AS of
            FROM (SELECT DISTINCT r FROM cells) o, range(-15, 16) k(i), size
        ), along AS (
            SELECT o.c, i, CASE WHEN o.c + i < 0 THEN -(o.c + i) WHEN o.c + i > size.c THEN 2 * size.c - o.c - i ELSE o.c + i END AS of
            FROM (SELECT DISTINCT c FROM cells) o, range(-15, 16) k(i), size
        ), lines AS (SELECT r, along.c, list(v) AS vs FROM cells JOIN along ON along.of = cells.c GROUP BY ALL
        ), windows AS (SELECT down.r, c, flatten(list(vs)) AS vs FROM lines JOIN down ON down.of = lines.r GROUP BY ALL)
        SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(list_sort(vs)[481] AS DOUBLE) AS value FROM windows
    """,
    "grid_median": pool_sql((3, 3), (1, 1), (1, 1, 1, 1), (8, 8)),
    "grid_median_padded": pool_sql((3, 3), (1, 1), (1, 1, 2, 2), (10, 8)),
    "grid_median_strided": pool_sql((2, 4), (2, 3), (1, 2, 0, 1), (4, 3)),
}
