import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import AWKWARD, saved
from pyspark.sql import functions as F

from gleaner.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, best, percent=co.HELD_BY_LONGER):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            if len(p) == 2 and any(f[lang, q] * 100 >= percent * a for (la, q), b in f.items() if la == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:best], 1)
    )


def texts(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ünï", "😀", "x" * 100, "É", "é", "a\x0bb", "nul\0", "1.5"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(n):
        own = rng.choices(words, weights, k=rng.randrange(0, 60))
        if rng.random() < 0.5:
            own += rng.choice(["New York City", "of the", "per se", "vice versa ", "a b c d"]).split() * rng.randrange(1, 4)
        out.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "; "]) for w in own))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate(rows)], SCHEMA)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(map(tuple, df.collect()))


ROWS = [(t, lang) for k, lang in enumerate(("en", "fr", None, "und", "")) for t in texts(k, 60)] + [(t, "en") for t in AWKWARD]


def test_equals_brute_force_and_sql(spark, tmp_path):
    docs = table(spark, ROWS).withColumns({"phrase": F.lit(1), "n": F.lit("mine"), "code": F.lit(0)})
    folder = saved(spark, tmp_path, docs.repartition(3))
    got = rows_of(co.query(spark, folder))
    assert got == brute(ROWS, co.LEAST, co.BEST)
    assert {r[0] for r in got} == {"en", "fr", "und", ""} and any(r[2].count(" ") == 2 for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.ORACLE})").fetchall()) == got


@pytest.mark.parametrize(
    "settings",
    [
        {"HEAD": 5},  # nearly all words by their text
        {"HEAD": 1, "UNITS": 1},
        {"UNITS": 3},
        {"BYTES": 2},  # long words have no ids
        {"TILE": 4, "DENSE": 6},  # more tiles than dense ones
        {"TILE": 1, "DENSE": 1000},
        {"CHUNK": 50, "HELD": 20},  # counts are handed on early
        {"BITS": 32768},  # a full bitmap holds nothing back
    ],
    ids=str,
)
def test_bounds_change_nothing(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(co, name, value)
    rows = ROWS[:130]
    assert rows_of(co.collocations(table(spark, rows), least=4, best=25)) == brute(rows, 4, 25)


def test_dense_tiles_are_used(spark, monkeypatch):
    monkeypatch.setattr(co, "TILE", 4)
    right, rank = co.sides(["a"] * 9, np.arange(9), np.arange(90, 0, -10))
    level = co.Level(2, {}, rank, right, right, np.zeros(4096, np.uint8)).choose()
    assert (level.slots["a"] >= 0).any() and (level.slots["a"] < 0).any()
    counter = co.Counter(level)
    left, after = np.array([0, 0, 1, 8, 8, 0]), np.array([1, 1, 0, 8, 8, 8])
    list(counter.add("a", left, rank[left], after))
    assert counter.dense["a"].sum() > 0
    found = {c: n for batch in counter.all() for c, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)}
    assert found == {(0 << co.SHIFT) + 1: 2, 1 << co.SHIFT: 1, (8 << co.SHIFT) + 8: 2, 8: 1}


def test_large_counts_are_exact(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big + 1)], "a long, l long")
    score = row.selectExpr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(19,0)) * cast(l as decimal(19,0))) AS s").first().s
    assert score == 1_000_000 * big * big // ((big + 1) * (big + 1))


def test_ties_and_empty_table(spark):
    rows = [("b a. a b. d c. c d", "x")] * 10
    got = rows_of(co.collocations(table(spark, rows), best=3))
    assert [(r[2], r[7]) for r in got] == [("a b", 250000), ("b a", 250000), ("c d", 250000)] and got == brute(rows, 10, 3)
    assert co.collocations(table(spark, rows).limit(0)).count() == 0
    assert co.collocations(table(spark, [("", "x"), (None, None)])).count() == 0
