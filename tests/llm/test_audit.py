import re
from itertools import permutations

import duckdb
import pytest
from fixtures import AWKWARD, saved

from gleaner.llm import audit

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    *AWKWARD,
    LONG,
    LONG,
    LONG.upper(),
    LONG + " 5$",
    "a b " * 80,
    "A B# " * 80,
    "one two three four five six seven eight " * 3,
    "tabs\tand\x0blines " * 60,
    " ".join(f"w{i}" for i in range(99)),
    " ".join(f"w{i}" for i in range(100)),
    " ".join(f"w{i}" for i in range(80)) + " w1" * 20,
    " ".join(f"w{i}" for i in range(80)) + " w1" * 21,
    "A" + "b" * 9,
    "AA" + "b" * 9,
]


def rows(spark):
    langs = ["en", "de", None, ""]
    docs = [(i, t, langs[i % 4], "s", "mine") for i, t in enumerate(TEXTS)]
    docs += [(3, "twice the same id", "en", "s", "x"), (3, "twice the same id", "en", "s", "x"), (None, LONG, "de", "s", "x")]
    labels = [(i, i % 2, None if i % 5 == 0 else i % 3 // 2) for i in range(0, 24, 2)] + [(1, 1, 1), (1, 0, 0), (3, 1, 0), (None, 1, 1)]
    schema = "doc_id long, text string, lang string, source string, id string"
    return docs, labels, spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute(docs, labels):
    failing = {x: set() for x in "ABCDE"}
    for k, (doc, text, *_) in enumerate(docs):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        if len(words) < 100:
            failing["A"].add(k)
        if 100 * len(set(words)) < 80 * len(words):
            failing["B"].add(k)
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            failing["C"].add(k)
        if re.search(r"[#$%&*|]", t):
            failing["D"].add(k)
        if doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, *_ in docs):
            failing["E"].add(k)
    good = {k for k, d in enumerate(docs) if d[0] is not None and any(x[0] == d[0] and x[1] == 1 for x in labels)}
    toxic = {k for k, d in enumerate(docs) if d[0] is not None and any(x[0] == d[0] and x[2] == 1 for x in labels)}
    out = set()
    for part in {d[2] or "" for d in docs}:
        here = {k for k, d in enumerate(docs) if (d[2] or "") == part}
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(here)
            for step, x in enumerate(order, 1):
                fails = failing[x] & here
                removed = fails & left
                alone = fails - set().union(*[failing[y] for y in "ABCDE" if y != x])
                steps.append((order, step, x, len(left - removed), len(removed), len(fails - left), len(alone), len(removed & good), len(removed & toxic)))
                shapley[x] += len(removed)
                left -= removed
        out |= {(part, "".join(o), s, *rest, shapley[x]) for o, s, x, *rest in steps}
    return out


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_equals_brute_force_and_sql(spark, tmp_path):
    docs, labels, table, marks = rows(spark)
    folder = saved(spark, tmp_path, table)
    saved(spark, tmp_path, marks, "labels")
    got = audit.query(spark, folder)
    assert got.columns == COLUMNS
    found = {tuple(r) for r in got.collect()}
    assert got.count() == len(found) == 3 * 600
    assert found == brute(docs, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert set(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({audit.ORACLE})").fetchall()) == found


def test_partitioning_does_not_matter(spark):
    _, _, table, marks = rows(spark)
    assert {tuple(r) for r in audit.audit(table.repartition(7), marks).collect()} == {tuple(r) for r in audit.audit(table.coalesce(1), marks).collect()}


def test_empty_table_and_filters_that_nothing_fails(spark):
    _, _, table, marks = rows(spark)
    assert audit.audit(table.limit(0), marks).count() == 0
    two = audit.audit(table.filter("doc_id = 9"), marks.limit(0), {"A": "n_words < 0"})
    assert [(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in two.orderBy("filter_order", "step").collect()] == [
        ("AE", 1, 1, 0, 0), ("AE", 2, 1, 0, 0), ("EA", 1, 1, 0, 0), ("EA", 2, 1, 0, 0),
    ]


@pytest.mark.parametrize("n", [5, 40])
def test_a_large_group_of_copies(spark, n):
    docs = spark.createDataFrame([(i, LONG, "en", "s", None) for i in range(n)], "doc_id long, text string, lang string, source string, id string")
    got = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'ABCDE' AND step = 5").first()
    assert (got.kept, got.removed, got.unique_fails, got.shapley) == (1, n - 1, n - 1, 120 * (n - 1))
