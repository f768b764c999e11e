import pytest
from pyspark.sql import functions as F

from gleaner.operators import outcomes as O


def test_precedence(spark):
    rows = [
        # results, entry, crash, progress, states, want
        (True, "Finished", None, [3, 3], ["Completed", "Completed"], "valid_pass"),
        (True, "Finished", None, [3, 3], ["Completed", "Failed - Agent got blocked"], "valid_fail"),
        (True, "Rejected", None, [3, 3], ["Completed"], "agent_error"),
        (True, "Finished", "Agent crashed", [3, 3], ["Completed"], "agent_error"),
        (True, "Crashed", "Agent crashed", [3, 3], ["Completed"], "infra_fail"),
        (True, "Rejected", None, [2, 3], ["Completed"], "infra_fail"),
        (True, "Finished", "Simulation crashed", None, ["Completed"], "infra_fail"),
        (False, None, None, None, None, "infra_fail"),
        (True, "Finished", None, [3, 3], [], None),
        (True, "Finished", None, [3, 3], ["Failed - Other"], None),
    ]
    df = spark.createDataFrame(
        rows, "res boolean, entry string, crash string, progress array<int>, states array<string>, want string"
    )
    passed, failed = O.routes_in_row(F.col("states"))
    got = df.select(
        "want", O.outcome(F.col("res"), F.col("entry"), F.col("crash"), F.col("progress"), passed, failed).alias("got")
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_routes_per_job(spark):
    rows = [(1, "Completed"), (1, "Completed"), (2, "Completed"), (2, "Failed - Agent timed out"), (3, "Failed")]
    got = O.routes_per_job(spark.createDataFrame(rows, "job int, status string"), ["job"]).orderBy("job").collect()
    assert [(r.all_passed, r.any_failed) for r in got] == [(True, False), (False, True), (False, False)]


def test_summary_counts_valid_runs_only(spark):
    rows = [("a", "infra_fail", 9.0), ("b", "valid_pass", 1.0), ("b", "valid_fail", 3.0), ("b", "agent_error", 9.0), ("b", "infra_fail", 9.0)]
    df = spark.createDataFrame(rows, "agent string, outcome string, s double")
    got = {r.agent: r for r in O.summarise_by(df, ["agent"], {"s": F.col("s")}).collect()}
    assert (got["a"].n_valid, got["a"].pass_rate, got["a"].mean_s, got["a"].infra_fail_rate) == (0, None, None, 1.0)
    assert (got["b"].n_valid, got["b"].pass_rate, got["b"].mean_s) == (2, 0.5, 2.0)
    assert (got["b"].agent_error_rate, got["b"].infra_fail_rate) == (0.25, 0.25)


def test_rank(spark):
    rows = [(i, [0.5, None, 0.9, 0.5, 0.5, None][i % 6], float(i % 2)) for i in range(18)]
    df = spark.createDataFrame(rows, "id int, pass_rate double, score double")
    got = O.rank_by(df, ["pass_rate", "score"]).collect()
    key = lambda r: (-(r[1] if r[1] is not None else float("-inf")), -r[2])
    want = {r[0]: 1 + sum(key(o) < key(r) for o in rows) for r in rows}
    assert {r.id: r["rank"] for r in got} == want
    assert set(got[0].asDict()) == {"id", "pass_rate", "score", "rank"}


def test_missing_evidence_is_kept(spark):
    jobs = spark.createDataFrame([("j1",), ("j2",)], "job_id string")
    results = spark.createDataFrame([("j1", True)], "job_id string, all_passed boolean")
    steps = spark.createDataFrame([("j2", 5)], "job_id string, global_steps int")
    marks = spark.createDataFrame([("j2", 1)], "job_id string, marker_lines int")
    got = {r.job_id: r for r in O.join_evidence(jobs, results, steps, marks).collect()}
    assert got["j1"].has_results and not got["j2"].has_results and got["j2"].global_steps == 5


def test_rate_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 2, 4), ("a", 1, 2), ("b", 3, 0)], "k string, e int, km int")
    got = {r.k: r["rate"] for r in O.rate_per_unit(df, ["k"], F.col("e"), F.col("km"), "rate").collect()}
    assert got == {"a": 0.5, "b": None}


def test_fingerprint_ignores_the_order_of_fields(spark):
    one = spark.range(1).select(O.fingerprint({"b": F.lit(1), "a": F.lit("x")})).first()[0]
    two = spark.range(1).select(O.fingerprint({"a": F.lit("x"), "b": F.lit(1)})).first()[0]
    other = spark.range(1).select(O.fingerprint({"a": F.lit("x"), "b": F.lit(2)})).first()[0]
    assert one == two != other


def test_breakdowns(spark):
    rows = [("a", "t1", "w1", "valid_pass"), ("a", "t2", "w1", "valid_fail"), ("b", "t1", "w2", "infra_fail")]
    df = spark.createDataFrame(rows, "agent string, town string, weather string, outcome string")
    got = O.breakdowns(df, "agent", ["town", "weather"], {})
    assert got.filter("town is null and weather is null").count() == 2
    assert got.filter("town is not null").count() == 3 and got.filter("weather is not null").count() == 2
