import re

import duckdb
import pytest
from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = AWKWARD + [
    " ".join(f"w{i % 17}" for i in range(60)),
    " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(12, 25)),
    "a " * 100,
]


def test_signals_equal_brute_force(spark, tmp_path):
    folder = saved(spark, tmp_path, documents(spark, TEXTS))
    got = {r.doc_id: r for r in quality.query(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_equals_sql(spark, tmp_path):
    folder = saved(spark, tmp_path, documents(spark, TEXTS))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = quality.query(spark, folder)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({quality.SQL['op10_quality_rules']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_clashing_columns_survive_and_empty_table(spark):
    docs = documents(spark, ["the of and " * 10, "short"]).withColumn("n_words", F.lit("mine")).withColumn("row", F.lit(1))
    kept = quality.keep_good(docs, rules=())
    assert kept.columns == docs.columns
    assert [r.n_words for r in quality.keep_good(documents(spark, ["a b c " + "the cat of a dog " * 2 + " ".join(f"w{i}" for i in range(30))]).withColumn("n_words", F.lit("mine"))).collect()] == ["mine"]
    assert quality.keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "rule"),
    [("| a " * 40, "symbols"), ("zz! " * 40, "exclamations"), ("qqq www " * 60, "stop_words")],
)
def test_rules_name_what_fails(spark, text, rule):
    r = quality.judged(documents(spark, [text]), "text", ["doc_id"]).first()
    assert rule in r.failed and not r.kept
