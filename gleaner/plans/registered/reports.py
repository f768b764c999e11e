"""Orders as evaluation jobs, their line items as routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import outcomes as O
from gleaner.operators.matching import read_before_write as unread
from gleaner.operators.ordered import attach
from gleaner.plans.registered import table
from gleaner.plans.registered.telemetry import cents


def orders_as_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumnRenamed("o_orderkey", "job_id")


def evidence(spark: SparkSession, folder: str, jobs: DataFrame) -> DataFrame:
    """All that is known of every job. Orders without line items have no results."""
    orders = table(spark, folder, "orders")
    items = table(spark, folder, "lineitem")
    state = (
        F.when(F.col("l_returnflag") == "A", "Failed - Agent timed out")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "Failed")
        .otherwise("Completed")
    )
    # One pass over the line items tells routes and steps.
    steps = F.sum(F.col("l_quantity").cast("bigint")).alias("global_steps")
    infractions = F.count_if(F.col("l_returnflag") == "A").alias("infractions")
    known = O.routes_per_job(
        items.select(F.col("l_orderkey").alias("job_id"), state.alias("status"), "l_quantity", "l_returnflag"),
        ["job_id"], others=(steps, infractions),
    ).withColumn("has_results", F.lit(True))
    marked = F.when(F.col("o_totalprice") > 400_000, 1)
    price = "o_totalprice" in jobs.columns
    with_price = jobs if price else jobs.join(orders.select(F.col("o_orderkey").alias("job_id"), "o_totalprice"), "job_id")
    return (
        with_price.join(known, "job_id", "left")
        .withColumn("has_results", F.coalesce("has_results", F.lit(False)))
        .withColumn("marker_lines", marked)
    )


def judged(spark: SparkSession, folder: str, jobs: DataFrame | None = None) -> DataFrame:
    known = evidence(spark, folder, orders_as_jobs(spark, folder) if jobs is None else jobs)
    entry = F.when(F.col("o_orderpriority") == "5-LOW", "Rejected").when(
        (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P"), "Started"
    ).otherwise("Finished")
    crash = F.when((F.col("marker_lines") == 1) & (F.col("o_orderstatus") == "O"), "Simulation crashed").when(
        (F.col("marker_lines") == 1) & (F.col("o_orderstatus") == "F"), "Agent crashed"
    )
    progress = F.array(F.when(F.col("global_steps") < 10, 1).otherwise(2), F.lit(2))
    outcome = O.outcome(
        F.col("has_results"), entry, crash, progress, F.col("all_passed"), F.col("any_failed")
    )
    return known.withColumn("outcome", outcome)


def job_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).select("job_id", "o_custkey", "outcome")


def missing_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results are there for orders with a finished line item, steps for all line items."""
    items = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    finished = items.filter(F.col("l_linestatus") == "F")
    results = finished.groupBy("job_id").agg(F.bool_and(F.col("l_returnflag") == "A").alias("is_broken"))
    summaries = items.groupBy("job_id").agg(F.sum(F.col("l_quantity").cast("bigint") - 20).alias("global_steps"))
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "job_id")
    markers = orders.filter(F.col("o_totalprice") > 300_000).select("job_id", F.lit(2).alias("marker_lines"))
    known = O.join_evidence(orders.select("job_id"), results, summaries, markers)
    readable = F.col("has_results") & ~F.coalesce("is_broken", F.lit(False))
    why = O.missing_reason(readable, F.col("is_broken"), F.col("global_steps"), F.col("marker_lines"))
    return known.select("job_id", why.alias("reason")).filter(F.col("reason").isNotNull())


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Judged jobs with the dimensions of their customers.

    A customer may own any share of the orders, so that join is made first, on the bare orders.
    """
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("agent"), "c_nationkey"
    )
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("town"), "n_regionkey"
    )
    regions = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("scenario"))
    jobs = (
        attach(orders_as_jobs(spark, folder), customers, ["o_custkey"])
        .join(nations, "c_nationkey")
        .join(regions, "n_regionkey")
    )
    return judged(spark, folder, jobs).select(
        "agent", "town", "scenario", "outcome", "global_steps", "infractions",
        F.col("o_orderpriority").alias("weather"),
        F.col("o_orderstatus").alias("route_type"),
        cents(F.col("o_totalprice")).alias("score"),
    )


def scores() -> dict:
    return {"score": F.col("score"), "steps": F.col("global_steps")}


def outcome_summary(spark: SparkSession, folder: str) -> DataFrame:
    return O.summarise_by(runs(spark, folder), ["agent"], scores())


def outcome_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["agent", "town", "weather", "route_type", "scenario"]
    return O.summarise_by(runs(spark, folder), keys, scores())


def outcome_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Infractions per step beside the summary of every agent and route type."""
    rates = {"infraction_rate": (F.col("infractions"), F.col("global_steps"))}
    return O.summarise_by(runs(spark, folder), ["agent", "route_type"], scores(), rates=rates)


def outcome_levels(spark: SparkSession, folder: str) -> DataFrame:
    return O.breakdowns(runs(spark, folder), "agent", ["weather", "route_type", "scenario"], scores())


def outcome_rank(spark: SparkSession, folder: str) -> DataFrame:
    judged_jobs = judged(spark, folder).select("o_custkey", "outcome", cents(F.col("o_totalprice")).alias("score"))
    per_customer = O.summarise_by(judged_jobs, ["o_custkey"], {"score": F.col("score")})
    return O.rank_by(per_customer, ["pass_rate", "mean_score"]).select(
        "o_custkey", "n_valid", "pass_rate", "mean_score", "rank"
    )


def rate_per_unit(spark: SparkSession, folder: str) -> DataFrame:
    infractions = F.when(F.col("l_returnflag") == "A", cents(F.col("l_discount"))).otherwise(0)
    return O.rate_per_unit(
        table(spark, folder, "lineitem"), ["l_suppkey", "l_linestatus"], infractions,
        F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("bigint")).otherwise(0), "per_unit",
    )


def read_before_write(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("pos"), "event_type",
        (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("key"),
    )
    reads = used.filter(F.col("event_type").isin("view", "purchase"))
    writes = used.filter(F.col("event_type").isin("click", "signup"))
    return unread(reads, writes, ["user_id"], bucket=F.floor(F.col("pos") / 100_000))


def config_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    mark = O.fingerprint(
        {"town": F.col("c_nationkey"), "agent": F.col("c_mktsegment"), "seed": F.col("c_custkey") % 4}
    )
    return table(spark, folder, "customer").select("c_custkey", mark.alias("fingerprint"))


def reproduced_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that repeat the configuration of an earlier one."""
    marked = config_fingerprint(spark, folder)
    first = marked.groupBy("fingerprint").agg(F.min("c_custkey").alias("first_key"))
    return O.reproductions(first, marked).select("fingerprint", "first_key", "c_custkey").filter(F.col("c_custkey") > F.col("first_key"))


QUERIES = {
    f.__name__: f
    for f in (
        job_outcomes, missing_results, outcome_summary, outcome_breakdown, outcome_rates, outcome_levels, outcome_rank, rate_per_unit,
        read_before_write, config_fingerprint, reproduced_configs,
    )
}

JUDGED_SQL = """
    r AS (
        SELECT l_orderkey, bool_and(o = 'valid_pass') AS all_passed, bool_or(o = 'valid_fail') AS any_failed,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS global_steps,
               count(*) FILTER (WHERE l_returnflag = 'A') AS infractions
        FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'valid_fail'
                             WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN ''
                             ELSE 'valid_pass' END AS o FROM lineitem)
        GROUP BY 1
    ),
    j AS (
        SELECT o_orderkey AS job_id, o_custkey, o_orderpriority AS weather, o_orderstatus AS route_type,
               CAST(round(o_totalprice * 100) AS BIGINT) AS score, global_steps, infractions,
               CASE WHEN l_orderkey IS NULL
                      OR (o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P')
                      OR (o_totalprice > 400000 AND o_orderstatus = 'O')
                      OR global_steps < 10 THEN 'infra_fail'
                    WHEN o_orderpriority = '5-LOW' OR (o_totalprice > 400000 AND o_orderstatus = 'F')
                      THEN 'agent_error'
                    WHEN all_passed THEN 'valid_pass'
                    WHEN any_failed THEN 'valid_fail' END AS outcome
        FROM orders LEFT JOIN r ON o_orderkey = l_orderkey
    ),
    runs AS (
        SELECT j.*, c_mktsegment AS agent, n_name AS town, r_name AS scenario
        FROM j JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
    )
"""
VALID = "outcome IN ('valid_pass', 'valid_fail')"


def measures_sql(names: dict[str, str]) -> str:
    means = ", ".join(f"avg({c}) FILTER (WHERE {VALID}) AS mean_{n}" for n, c in names.items())
    return f"""count(*) AS n_runs, count(*) FILTER (WHERE {VALID}) AS n_valid,
        count(*) FILTER (WHERE outcome = 'valid_pass') / nullif(count(*) FILTER (WHERE {VALID}), 0) AS pass_rate,
        {means},
        count(*) FILTER (WHERE outcome = 'agent_error') / count(*) AS agent_error_rate,
        count(*) FILTER (WHERE outcome = 'infra_fail') / count(*) AS infra_fail_rate"""


MEASURES = measures_sql({"score": "score", "steps": "global_steps"})

SQL = {
    "job_outcomes": f"WITH {JUDGED_SQL} SELECT job_id, o_custkey, outcome FROM j",
    "missing_results": """
        WITH r AS (
            SELECT l_orderkey, bool_and(l_returnflag = 'A') AS is_broken FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1
        ), s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT) - 20) AS steps FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS job_id, CASE WHEN is_broken THEN 'broken result' WHEN steps > 0 THEN 'wrote elsewhere'
               WHEN o_totalprice > 300000 THEN 'no connection' ELSE 'never came up' END AS reason
        FROM orders LEFT JOIN r ON r.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey
        WHERE is_broken IS NULL OR is_broken
    """,
    "outcome_summary": f"WITH {JUDGED_SQL} SELECT agent, {MEASURES} FROM runs GROUP BY agent",
    "outcome_breakdown": f"""
        WITH {JUDGED_SQL}
        SELECT agent, town, weather, route_type, scenario, {MEASURES} FROM runs
        GROUP BY agent, town, weather, route_type, scenario
    """,
    "outcome_rates": f"""
        WITH {JUDGED_SQL}
        SELECT agent, route_type, {MEASURES},
               sum(infractions) FILTER (WHERE {VALID}) / nullif(sum(global_steps) FILTER (WHERE {VALID}), 0) AS infraction_rate
        FROM runs GROUP BY agent, route_type
    """,
    "outcome_levels": f"""
        WITH {JUDGED_SQL}
        SELECT agent, weather, route_type, scenario, grouping_id(agent, weather, route_type, scenario) AS level, {MEASURES}
        FROM runs
        GROUP BY GROUPING SETS ((agent), (agent, weather), (agent, route_type), (agent, scenario))
    """,
    "outcome_rank": f"""
        WITH {JUDGED_SQL}, a AS (SELECT o_custkey, {measures_sql({"score": "score"})} FROM j GROUP BY o_custkey)
        SELECT o_custkey, n_valid, pass_rate, mean_score,
               rank() OVER (ORDER BY pass_rate DESC NULLS LAST, mean_score DESC NULLS LAST) AS rank FROM a
    """,
    "rate_per_unit": """
        SELECT l_suppkey, l_linestatus,
               sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END)
               / nullif(sum(CASE WHEN l_quantity > 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 0) AS per_unit
        FROM lineitem GROUP BY ALL
    """,
    "read_before_write": """
        WITH u AS (
            SELECT user_id, event_id AS pos, event_type,
                   CAST(CAST(json_extract(props, '$.k') AS INT) % 10 AS VARCHAR) AS key FROM events
        )
        SELECT user_id, key, pos FROM u r WHERE event_type IN ('view', 'purchase') AND NOT EXISTS (
            SELECT 1 FROM u w WHERE w.event_type IN ('click', 'signup') AND w.user_id = r.user_id
            AND w.key = r.key AND w.pos < r.pos)
    """,
    "config_fingerprint": """
        SELECT c_custkey, sha256('{"agent":"' || c_mktsegment || '","seed":' || (c_custkey % 4)
                                 || ',"town":' || c_nationkey || '}') AS fingerprint FROM customer
    """,
    "reproduced_configs": """
        WITH m AS (
            SELECT c_custkey, sha256('{"agent":"' || c_mktsegment || '","seed":' || (c_custkey % 4)
                                     || ',"town":' || c_nationkey || '}') AS fingerprint FROM customer
        )
        SELECT fingerprint, first_key, c_custkey
        FROM (SELECT *, min(c_custkey) OVER (PARTITION BY fingerprint) AS first_key FROM m)
        WHERE c_custkey > first_key
    """,
}
