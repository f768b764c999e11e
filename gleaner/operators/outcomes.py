"""Outcome reports of evaluation runs: who passed, and what only broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import Measure, attach, scan_groups

# Outcome names and the signals they are read from.
VALID_PASS, VALID_FAIL, AGENT_ERROR, INFRA_FAIL = "valid_pass", "valid_fail", "agent_error", "infra_fail"
PASSED = "Completed"
AGENT_FAILED = "Failed - Agent"
AGENT_ERROR_ENTRIES = ["Rejected", "Finished with agent errors"]
AGENT_ERROR_CRASHES = ["Agent's sensors were invalid", "Agent couldn't be set up", "Agent crashed"]
INFRA_ENTRIES = ["Started", "Crashed"]
INFRA_CRASHES = ["Simulation crashed"]


def route_outcome(status: Column) -> Column:
    """Outcome of one route; NULL for a status that tells nothing."""
    return F.when(status == PASSED, VALID_PASS).when(F.startswith(status, F.lit(AGENT_FAILED)), VALID_FAIL)


def routes_per_job(
    routes: DataFrame, job: list[str], status: str = "status", others: tuple[Column, ...] = ()
) -> DataFrame:
    """What the routes of a job say together: ``all_passed`` and ``any_failed``, and other aggregates with them."""
    o = F.coalesce(route_outcome(F.col(status)), F.lit(""))
    return routes.groupBy(*job).agg(
        F.bool_and(o == VALID_PASS).alias("all_passed"), F.bool_or(o == VALID_FAIL).alias("any_failed"), *others
    )


def routes_in_row(states: Column) -> tuple[Column, Column]:
    """The same two flags for states that are nested in the result of the job."""
    outcomes = F.transform(states, lambda s: F.coalesce(route_outcome(s), F.lit("")))
    all_passed = (F.size(outcomes) > 0) & F.forall(outcomes, lambda o: o == VALID_PASS)
    return all_passed, F.exists(outcomes, lambda o: o == VALID_FAIL)


def outcome(
    has_results: Column, entry_status: Column, crash_message: Column, progress: Column,
    all_passed: Column, any_failed: Column,
) -> Column:
    """Outcome of a job; NULL if nothing is known to apply.

    Broken infrastructure outranks agent errors, those outrank the routes. A job passes if all of
    its routes passed.
    """

    def said(words: list[str]) -> Column:
        return F.coalesce(crash_message.isin(words), F.lit(False))

    short = F.coalesce(F.get(progress, F.lit(0)) < F.get(progress, F.lit(1)), F.lit(False))
    entry = F.coalesce(entry_status, F.lit(""))
    return (
        F.when(~has_results | entry.isin(INFRA_ENTRIES) | said(INFRA_CRASHES) | short, INFRA_FAIL)
        .when(entry.isin(AGENT_ERROR_ENTRIES) | said(AGENT_ERROR_CRASHES), AGENT_ERROR)
        .when(all_passed, VALID_PASS)
        .when(any_failed, VALID_FAIL)
    )


def missing_reason(has_results: Column, is_broken: Column, global_steps: Column, marker_lines: Column) -> Column:
    """Why a job has no result, from its run summary and its log; NULL if it has one.

    A job that made steps ran and wrote elsewhere, or wrote a document that cannot be read. One without
    steps never came up; a marker in its log names the cause.
    """
    ran = F.coalesce(global_steps > 0, F.lit(False))
    marked = F.coalesce(marker_lines > 0, F.lit(False))
    return F.when(
        ~has_results,
        F.when(F.coalesce(is_broken, F.lit(False)), "broken result")
        .when(ran, "wrote elsewhere")
        .when(marked, "no connection")
        .otherwise("never came up"),
    )


def join_evidence(
    jobs: DataFrame, results: DataFrame, summaries: DataFrame, markers: DataFrame, job: str = "job_id"
) -> DataFrame:
    """Jobs with whatever is known of them; a missing result is a finding, not a lost row.

    All sides have one row per job.
    """
    marked = results.withColumn("has_results", F.lit(True))
    return (
        jobs.join(marked, job, "left")
        .join(summaries, job, "left")
        .join(markers, job, "left")
        .withColumn("has_results", F.coalesce("has_results", F.lit(False)))
    )


def annotate(jobs: DataFrame, outcomes: DataFrame, job: str = "job_id") -> DataFrame:
    """Job list with its ``outcome`` column."""
    return jobs.join(outcomes.select(job, "outcome"), job, "left")


def is_valid(o: Column) -> Column:
    return o.isin(VALID_PASS, VALID_FAIL)


def summary_columns(o: Column, scores: dict[str, Column]) -> list[Column]:
    """Pass rate and mean scores over valid runs; error rates over all runs."""
    valid = F.count_if(is_valid(o))
    rows = F.count(F.lit(1))
    return [
        rows.alias("n_runs"),
        valid.alias("n_valid"),
        (F.count_if(o == VALID_PASS) / F.nullif(valid, F.lit(0))).alias("pass_rate"),
        *[F.avg(F.when(is_valid(o), s)).alias(f"mean_{n}") for n, s in scores.items()],
        (F.count_if(o == AGENT_ERROR) / rows).alias("agent_error_rate"),
        (F.count_if(o == INFRA_FAIL) / rows).alias("infra_fail_rate"),
    ]


def valid_rate(o: Column, events: Column, units: Column) -> Column:
    """Events per unit over valid runs, NULL where those covered nothing."""
    of = [F.sum(F.when(is_valid(o), x)) for x in (events, units)]
    return of[0] / F.nullif(of[1], F.lit(0))


def summarise_by(
    df: DataFrame, keys: list[str], scores: dict[str, Column], o: str = "outcome",
    rates: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Summary per agent, or per any combination of dimensions; ``rates`` holds events and units by name."""
    more = [valid_rate(F.col(o), *of).alias(name) for name, of in (rates or {}).items()]
    return df.groupBy(*keys).agg(*summary_columns(F.col(o), scores), *more)


def breakdowns(
    df: DataFrame, agent: str, dimensions: list[str], scores: dict[str, Column], o: str = "outcome"
) -> DataFrame:
    """Headline per agent and one breakdown per dimension in a single pass; ``level`` tells them apart."""
    sets = [[df[agent]]] + [[df[agent], df[d]] for d in dimensions]
    return df.groupingSets(sets, agent, *dimensions).agg(
        F.grouping_id().cast("bigint").alias("level"), *summary_columns(F.col(o), scores)
    )


def rate_per_unit(df: DataFrame, keys: list[str], events: Column, units: Column, name: str) -> DataFrame:
    """Events per unit, NULL where nothing was covered."""
    return df.groupBy(*keys).agg((F.sum(events) / F.nullif(F.sum(units), F.lit(0))).alias(name))


def rank_by(
    df: DataFrame, columns: list[str], name: str = "rank"
) -> DataFrame:
    """Standard competition rank by the columns, highest first, NULL last.

    Only the distinct values are ordered, in buckets of the first column, and each brings along how many
    rows share it.
    """
    keyed = df.withColumns({f"_k{i}": F.coalesce(-F.col(c), F.lit(float("inf"))) for i, c in enumerate(columns)})
    keys = [f"_k{i}" for i in range(len(columns))]
    values = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranks = scan_groups(
        values, [], keys, {"_ahead": Measure("sum", F.col("_n"), inclusive=False)}, F.col("_k0")
    ).select(*keys, (1 + F.coalesce("_ahead", F.lit(0))).cast("bigint").alias(name))
    return attach(keyed, ranks, keys).drop(*keys)


def fingerprint(columns: dict[str, Column]) -> Column:
    """Hash of a configuration; fields are taken in name order and NULL fields left out."""
    fields = [columns[n].alias(n) for n in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def reproductions(
    firsts: DataFrame, runs: DataFrame, mark: str = "fingerprint"
) -> DataFrame:
    """Runs next to the first one of their configuration; ``firsts`` has one row per configuration."""
    return attach(runs, firsts, [mark])
