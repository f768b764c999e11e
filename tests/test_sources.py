import base64
import json
import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from check import normal
from gleaner.plans.harvest import HarvestOptions, candidates, harvest, select_repositories
from gleaner.plans.registered import stored
from gleaner.plans.telemetry import telemetry_report
from gleaner.session import WRITTEN
from gleaner.sources import readers as R
from gleaner.sources import schemas
from gleaner.sources import sinks as W


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_documents(spark, tmp_path):
    good = put(tmp_path, "m.json", json.dumps({"links": [{"label": "a", "url": "u"}, {"label": "b"}]}, indent=2))
    assert [tuple(r) for r in R.read_links(spark, good).collect()] == [("a", "u"), ("b", None)]
    assert R.read_links(spark, str(tmp_path / "none.json")).collect() == []
    assert R.read_links(spark, put(tmp_path, "bad.json", "{nope")).collect() == []
    snippets = put(tmp_path, "s.json", '["x", "  y"]')
    assert [tuple(r) for r in R.read_snippets(spark, snippets).collect()] == [(0, "x"), (1, "  y")]
    assert R.read_snippets(spark, str(tmp_path / "none")).count() == 0


def test_payloads(spark, tmp_path):
    repos = [{"name": "r", "fork": False, "owner": {"login": "o"}, "pushed_at": "2024"}, {"name": "s"}]
    put(tmp_path, "repos/1.json", json.dumps(repos))
    put(tmp_path, "repos/2.json", json.dumps({"message": "not a list"}))
    got = R.read_repositories(spark, str(tmp_path / "repos")).orderBy("name").collect()
    assert [(r.name, r.owner.login if r.owner else None) for r in got] == [("r", "o"), ("s", None)]
    put(tmp_path, "trees/1.json", json.dumps({"repo": "r", "tree": [{"type": "blob", "path": "a.py"}]}))
    put(tmp_path, "trees/2.json", json.dumps([1, 2]))
    assert [r.repo for r in R.read_trees(spark, str(tmp_path / "trees")).collect()] == ["r"]


def test_files(spark, tmp_path):
    put(tmp_path, "d/a.txt", b"x\xff")
    put(tmp_path, "d/e/b.txt", "l1\nl2")
    files = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in R.read_files(spark, str(tmp_path / "d")).collect()}
    assert files == {"a.txt": b"x\xff", "b.txt": b"l1\nl2"}
    assert R.read_texts(spark, str(tmp_path / "d/e/b.txt")).first().text == "l1\nl2"


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "t.jsonl", b'\n  \nbad\n{"ts":1,"gpu0_util":5}\n{"ts":2,"gpu0\xff_util":6}\n')
    assert [r.value for r in R.read_jsonl(spark, path).collect()] == [
        "bad", '{"ts":1,"gpu0_util":5}', '{"ts":2,"gpu0_util":6}',
    ]
    assert R.read_jsonl(spark, path, max_lines=2).count() == 2


def test_telemetry_report(spark, tmp_path):
    lines = [json.dumps({"ts": 1704067200 + i // 2, "gpus": [{"index": i % 2, "util": i}]}) for i in reversed(range(50))]
    path = put(tmp_path, "t.jsonl", "\n".join(lines))
    summary, thin = telemetry_report(spark, path, str(tmp_path / "csv"), downsample=10)
    assert sorted((r.gpu, r.n, r.low, r.high) for r in summary.collect()) == [(0, 25, 0.0, 48.0), (1, 25, 1.0, 49.0)]
    assert thin.filter("gpu = 0").count() == 13
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    rows = [tuple(r) for r in back.collect()]
    assert back.columns == ["gpu", "ts", "util"] and rows == sorted(rows, key=lambda r: (int(r[0]), r[1]))
    assert rows[0] == ("0", "2024-01-01T00:00:00.000000Z", "0.0")


def test_corpus_and_manifest(spark, tmp_path):
    files = spark.createDataFrame(
        [("r", "r__b.py", "me", "b.py", "main", 2, b"bb"), ("r", "r__a.py", "me", "a.py", "main", 1, b"a")],
        "repo string, file string, owner string, path string, branch string, bytes bigint, content binary",
    )
    W.write_corpus(files, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 2
    with pytest.raises(ValueError):
        W.write_corpus(files.unionByName(files), str(tmp_path / "corpus"))
    doc = W.manifest_document(files, F.lit("2024-01-01T00:00:00Z"), F.struct(F.lit("me").alias("user"))).first()
    parsed = json.loads(doc.value)
    assert [f["file"] for f in parsed["files"]] == ["r__a.py", "r__b.py"] and doc.n_files == 2
    path = put(tmp_path, "manifest.json", doc.value)
    assert sorted(r.bytes for r in R.read_manifest(spark, path).collect()) == [1, 2]


def test_write_if_changed(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "repo string, path string, bytes bigint")
    path, keys = str(tmp_path / "t"), ["repo", "path"]
    first = rows(("r", "a", 1), ("r", "b", 2))
    assert W.write_if_changed(spark, first, path, keys)
    assert not W.write_if_changed(spark, rows(("r", "b", 2), ("r", "a", 1)), path, keys)
    assert W.write_if_changed(spark, rows(("r", "a", 1), ("r", "b", 3)), path, keys)
    new = rows(("r", "b", 9), ("r", "c", 4))
    got = W.manifest_changes(first, new, keys, ["bytes"]).collect()
    assert {r.path: r.state for r in got} == {"a": "removed", "b": "changed", "c": "added"}


def test_same_rows_counts_copies(spark):
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    same = lambda a, b: W.same_rows(a, b).first().is_same
    assert same(t(1, 1, None), t(None, 1, 1)) and not same(t(1, 1), t(1)) and same(t(), t())


def test_report_formats(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "agent string, n int")
    W.write_report(df, str(tmp_path / "r"), ["agent"])
    assert [r.value for r in W.markdown_rows(df, ["agent"]).collect()] == [
        "| agent | n |", "| --- | --- |", "| a |  |", "| b | 2 |",
    ]
    for kind in ("csv", "json", "md"):
        assert (tmp_path / "r" / kind).is_dir()


def test_job_results(spark, tmp_path):
    result = {"entry_status": "Finished", "progress": [1, 1], "_checkpoint": {"records": [{"status": "Completed"}]}}
    put(tmp_path, "jobs/j1/results.json", json.dumps(result))
    put(tmp_path, "jobs/j1/run_summary.json", json.dumps({"global_steps": 7}))
    put(tmp_path, "jobs/j2/worker.log", "start\nconnect timeout after 600s\nconnect timeout after 600s\n")
    got = R.read_results(spark, str(tmp_path / "jobs")).first()
    assert got.job_id == "j1" and got._checkpoint.records[0].status == "Completed"
    assert tuple(R.read_run_summaries(spark, str(tmp_path / "jobs")).first()) == ("j1", 7)
    marks = R.read_log_markers(spark, str(tmp_path / "jobs/*/worker.log"), "timeout after")
    assert [tuple(r) for r in marks.collect()] == [("j2", 2)]
    assert R.read_results(spark, str(tmp_path / "nothing")).count() == 0
    put(tmp_path, "done.json", json.dumps([{"job_id": "j1", "agent": "x", "rc": 0, "duration": 1.5}]))
    assert R.read_completed_jobs(spark, str(tmp_path / "done.json")).first().agent == "x"


def encoded(data):
    return base64.b64encode(data).decode()


def test_harvest(spark):
    repos = spark.createDataFrame(
        [
            ("one", False, ("o",), "dev", "2024-03", None),
            ("two", None, None, "", None, "2024-02"),
            ("forked", True, None, None, "2025", None),
            ("old", False, None, None, "2020", None),
        ],
        schemas.REPOSITORIES,
    )
    entries = spark.createDataFrame(
        [
            ("one", "blob", "a.py"), ("one", "blob", "empty.py"), ("one", "blob", "nul.py"), ("one", "tree", "x.py"),
            ("one", "blob", "dist/b.py"), ("two", "blob", "src/big.js"), ("two", "blob", "gone.js"),
            ("forked", "blob", "f.py"), ("old", "blob", "o.py"),
        ],
        "repo string, type string, path string",
    )
    contents = spark.createDataFrame(
        [
            ("one", "a.py", "base64", encoded(b"print()")), ("one", "empty.py", "base64", ""),
            ("one", "nul.py", "base64", encoded(b"a\0")), ("two", "src/big.js", "base64", encoded(b"x" * 70_000)),
        ],
        "repo string, path string, encoding string, content string",
    )
    o = HarvestOptions(user="me", max_repos=2)
    assert sorted(map(tuple, select_repositories(repos, o).collect())) == [("me", "two", "main"), ("o", "one", "dev")]
    assert sorted(r.path for r in candidates(repos, entries, o).collect()) == [
        "a.py", "empty.py", "gone.js", "nul.py", "src/big.js",
    ]
    got = harvest(repos, entries, contents, o).collect()
    assert sorted((r.file, r.owner, r.branch, r.bytes) for r in got) == [
        ("one__a.py", "o", "dev", 7), ("two__src__big.js", "me", "main", 65536),
    ]
    # The sample is drawn first and not refilled.
    assert harvest(repos, entries, contents, HarvestOptions(user="me", max_repos=2, num_files=2)).count() <= 2


def test_broken_documents_and_payloads_are_reported(spark, tmp_path):
    put(tmp_path, "jobs/j1/results.json", '{"entry_status":"Finished"}')
    put(tmp_path, "jobs/j2/results.json", '{"entry_status":"Fini')
    assert [r.job_id for r in R.read_results(spark, str(tmp_path / "jobs")).collect()] == ["j1"]
    assert R.read_results(spark, str(tmp_path / "jobs")).count() == 1
    assert [r.job_id for r in R.broken_results(spark, str(tmp_path / "jobs")).collect()] == ["j2"]
    put(tmp_path, "repos/1.json", '[{"name":"a"}, 5, {"name":"b"}]')
    put(tmp_path, "repos/2.json", '{"message":"x"}')
    put(tmp_path, "repos/3.json", '[{"name":"c"}]')
    assert sorted(r.name for r in R.read_repositories(spark, str(tmp_path / "repos")).collect()) == ["a", "b", "c"]
    bad = R.dropped_payloads(spark, str(tmp_path / "repos"), schemas.REPOSITORIES).collect()
    assert {(r.path[-6:], r.reason) for r in bad} == {("1.json", "broken element"), ("2.json", "no list")}


def test_content_payloads(spark, tmp_path):
    put(tmp_path, "c/1.json", json.dumps({"repo": "r", "path": "a", "encoding": "base64", "content": encoded(b"x")}))
    put(tmp_path, "c/2.json", json.dumps({"repo": "r", "path": "b", "encoding": "none", "download": encoded(b"y")}))
    put(tmp_path, "c/3.json", "[]")
    got = R.read_contents(spark, str(tmp_path / "c")).orderBy("path").collect()
    assert [(r.path, r.content, r.download) for r in got] == [("a", encoded(b"x"), None), ("b", None, b"y")]


def test_replacement_characters_survive_broken_bytes(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a�b".encode() + b"\xff" + b"c\n")
    assert [r.value for r in R.read_jsonl(spark, path).collect()] == ["a�bc"]


def test_two_owners_of_one_name_stay_apart(spark):
    repos = spark.createDataFrame(
        [("one", False, ("a",), "m", "2", None), ("one", False, ("b",), "m", "1", None)], schemas.REPOSITORIES
    )
    entries = spark.createDataFrame(
        [("a", "one", "blob", "x.py"), ("b", "one", "blob", "y.py")], "owner string, repo string, type string, path string"
    )
    got = candidates(repos, entries, HarvestOptions(user="me"))
    assert sorted((r.owner, r.path) for r in got.collect()) == [("a", "x.py"), ("b", "y.py")]


def test_document_is_written_only_if_changed(spark, tmp_path):
    doc = lambda t, n: spark.createDataFrame([(json.dumps({"generated_at": t, "files": [n]}),)], "value string")
    path = str(tmp_path / "m")
    made = [W.write_document_if_changed(spark, doc(*x), path) for x in (("1", 1), ("2", 1), ("3", 2))]
    assert made == [True, False, True]


def test_safe_names(spark):
    cases = {
        ("Repo", "a.py"): "Repo__a.py", ("my repo", "src/a b.py"): "my-repo__src__a-b.py", ("r/x", "a//b"): "r-x__a____b",
        ("r", "é/ü.md"): "r__-__-.md", ("r", "__init__.py"): "r____init__.py", ("", ""): "__", ("r", "a+b(c).js"): "r__a-b-c-.js",
        ("a.b-c_d", "e.f-g_h"): "a.b-c_d__e.f-g_h", ("r", "/lead"): "r____lead", ("r", "tail/"): "r__tail__",
        ("r", "a\\b"): "r__a-b", ("r", "a\tb\nc"): "r__a-b-c", ("r r r", "x"): "r-r-r__x", ("--", "--"): "--____--"[:2] + "__--",
        ("日本", "x.py"): "-__x.py", ("r", "a@b#c$d"): "r__a-b-c-d",
    }
    from gleaner.functions.text import safe_file_name

    df = spark.createDataFrame(list(cases), "repo string, path string")
    got = {(r.repo, r.path): r.f for r in df.select("*", safe_file_name(F.col("repo"), F.col("path")).alias("f")).collect()}
    assert got == cases


@pytest.mark.parametrize("split", [None, 64])
def test_first_lines_over_files_and_splits(spark, tmp_path, split):
    want = []
    for k in range(7):
        rows = [f"{k}-{i}" + "x" * (i % 5) for i in range(k * 13)]
        text = "".join(f"{r}\n" + ["", " \t\n", "\n\n"][i % 3] for i, r in enumerate(rows))
        (tmp_path / f"log-{k}.jsonl").write_text(text)
        want += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for n in (1, 13, 14, 100, len(want), len(want) + 5):
            got = R.first_lines(spark, str(tmp_path), n).orderBy("place").collect()
            assert [(r.place, r.value) for r in got] == list(enumerate(want[:n], 1))
            assert sorted(r.value for r in R.read_jsonl(spark, str(tmp_path), n).collect()) == sorted(want[:n])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_lines_of_empty_files(spark, tmp_path):
    (tmp_path / "a").write_text("\n \n")
    (tmp_path / "b").write_text("")
    assert R.first_lines(spark, str(tmp_path), 3).count() == 0


def test_harvest_job_cuts_a_page_over_the_size_cap(spark, tmp_path):
    long, wide = "<p>" + "x" * 70_000 + "</p>", "<p>" + "y" * 65_533
    rows = [(i, f"https://a{i % 3}.example.com/p{i}.html", html) for i, html in enumerate([long, wide, "<a href='z'>short</a>", ""])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in stored.harvest_job(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(con.execute(stored.SQL["harvest_job"]).fetchall())
    assert sorted(r[5] for r in got) == [21, 65_536, 65_536]


def test_a_pack_gives_what_the_files_give(spark, tmp_path):
    texts = {
        "results/job=1/results.json": '{"entry_status":"Finished","progress":[1,2]}', "results/job=2/results.json": '{"entry_st',
        "results/job=3/other.json": '{"entry_status":"x"}', "results/results.json": '{"entry_status":"no job"}',
        "results/job=4/deep/results.json": '{"entry_status":"too deep"}', "results/job=5/results.json": "",
        "logs/job=1/w.txt": "a timeout after\r\nb\nc timeout after, timeout after", "logs/job=2/w.txt": "a\n\n", "logs/job=3/w.txt": "timeout after\r",
        "done/1.json": '[{"job_id":"job=1","rc":2},"bad"]', "done/2.json": '{"message":"none"}',
    }
    for name, text in texts.items():
        put(tmp_path / "files", name, text)
        if name.startswith("logs"):  # a log may be cut between lines
            texts[name] = text.replace("\nc", "\n|c").split("|")
    for kind in ("results", "logs", "done"):
        rows = [(n.removeprefix(f"{kind}/"), v) for n, t in texts.items() if n.startswith(kind) for v in ([t] if isinstance(t, str) else t)]
        W.pack_files(spark.createDataFrame(rows, "file string, value string"), str(tmp_path / "packs" / kind))
    files, packed = str(tmp_path / "files"), lambda kind: R.packed_files(spark, str(tmp_path / "packs" / kind))
    rows = lambda df: sorted(map(str, df.collect()))
    for read in (R.read_results, R.broken_results):
        assert rows(read(spark, packed("results"))) == rows(read(spark, f"{files}/results"))
        assert rows(read(spark, packed("results"), "*.j?on")) == rows(read(spark, f"{files}/results", "*.j?on"))
    assert [r.job_id for r in R.read_results(spark, packed("results")).collect()] == ["job=1"]
    marked = R.read_log_markers(spark, packed("logs"), "timeout after")
    assert rows(marked) == rows(R.read_log_markers(spark, f"{files}/logs/*/*.txt", "timeout after"))
    assert {(r.job_id, r.marker_lines) for r in marked.collect()} == {("job=1", 2), ("job=3", 1)}
    every = [rows(R.read_log_markers(spark, logs, "")) for logs in (packed("logs"), f"{files}/logs/*/*.txt")]
    assert every[0] == every[1]
    assert rows(R.read_completed_jobs(spark, packed("done"))) == rows(R.read_completed_jobs(spark, f"{files}/done"))
    assert len(rows(R.read_completed_jobs(spark, packed("done")))) == 1


def files_written(since):
    return sum(not f.startswith((".", "_")) for w in WRITTEN[since:] for _, _, names in os.walk(w) for f in names)


@pytest.mark.parametrize("name", ["job_evidence", "judged_folders", "job_report"])
def test_jobs_do_not_take_a_file_each(spark, tmp_path, name):
    rows = [(o, o % 300, 1 + o % 7, float(o % 50), "ANR"[o % 3]) for o in range(1200)]
    fields = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/lineitem.parquet")
    begin = len(WRITTEN)
    got = normal([tuple(r) for r in stored.QUERIES[name](spark, str(tmp_path)).collect()])
    assert files_written(begin) < 150
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == normal(con.execute(stored.SQL[name]).fetchall())


def test_states_of_jobs_are_not_collected_from_single_items(spark, tmp_path, monkeypatch):
    rows = [(1, 2, "N"), (1, 2, "N"), (1, None, "A"), (2, None, "N"), (2, None, "R"), (3, 5, None), (3, 2**31 - 1, "A"), (3, 2**31 - 1, "A"), (11, 4, "N")]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    grouped, write = [], stored.write_through
    monkeypatch.setattr(stored, "write_through", lambda df: (grouped.append(df), write(df))[1])
    got = {tuple(r) for r in stored.judged_folders(spark, str(tmp_path)).collect()}
    assert got == {
        ("job=1", "valid_fail", None, 4), ("job=2", "valid_pass", None, None), ("job=3", "valid_fail", None, 2**32 + 3),
        ("job=11", "infra_fail", "wrote elsewhere", 4),
    }
    plan = grouped[0]._jdf.queryExecution().sparkPlan().toString().splitlines()
    steps = [line for line in plan if "Aggregate(" in line]
    assert "collect_set" in steps[0] and "collect_set" not in steps[-1]  # what reads the items adds them up


@pytest.mark.parametrize("name", ["stored_contents", "stored_listings", "harvest_job"])
def test_payloads_do_not_take_a_file_each(spark, tmp_path, name):
    rows = [(i, f"https://a{i % 9}.example.com/p{i}.html", f"<p>{i}é\r\n</p>") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    begin = len(WRITTEN)
    got = normal([tuple(r) for r in stored.QUERIES[name](spark, str(tmp_path)).collect()])
    assert files_written(begin) < 200
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == normal(con.execute(stored.SQL[name]).fetchall())


def test_a_report_is_made_once(spark, tmp_path):
    drawn = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    W.write_report(spark.range(3).select("id", drawn().alias("drawn")), str(tmp_path), ["id"])
    csv = {r.drawn for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()}
    assert csv == {r.drawn for r in spark.read.json(f"{tmp_path}/json").collect()}
    assert all(any(d in r.value for r in spark.read.text(f"{tmp_path}/md").collect()) for d in csv)
