import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import name_lists as N
from gleaner.operators.repos import filter_names

NAMES = [None, "", "a", "Ab", "abc", "ABCD", "xabcdx", "layout/a.py", "src/Layout", "out", "o.u.t", "éléphant", "ÉLÉPHANTS", "x" * 300, "😀😀ab", "abab" * 20]


def table(spark, values, name="name"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} string")


def listed(spark, entries):
    return spark.createDataFrame([(e,) for e in entries], "entry string")


def brute(names, allow, block):
    clean = lambda xs: [x.strip(" ").lower() for x in xs if x and x.strip(" ")]
    allow, block = clean(allow), clean(block)
    out = []
    for i, n in enumerate(names):
        n = (n or "").lower()
        if any(b in n for b in block) or (allow and not any(a in n for a in allow)):
            continue
        out.append(i)
    return out


@pytest.mark.parametrize(
    ("allow", "block"),
    [([], ["out"]), (["ab", "É"], ["abcd", None, " ", ""]), (["LAYOUT"], []), (["zzz"], ["yyy"]), (["x" * 40, "😀"], []), ([""], [" "]), (["abababab"], ["a"])],
)
def test_equals_the_short_lists_and_brute_force(spark, allow, block):
    df = table(spark, NAMES)
    got = [r.id for r in N.filter_names_by_table(df, listed(spark, allow), listed(spark, block)).orderBy("id").collect()]
    assert got == brute(NAMES, allow, block)
    short = filter_names(df, [a for a in allow if a and a.strip()], [b for b in block if b and b.strip()])
    assert got == [r.id for r in short.orderBy("id").collect()]


@pytest.mark.parametrize(("gram", "share", "bits"), [(4, 100_000, N.BITS), (1, 3, 64), (3, 5, 128), (6, 1, N.BITS)])
def test_random_lists_hot_grams_and_full_bitmaps(spark, monkeypatch, gram, share, bits):
    monkeypatch.setattr(N, "BITS", bits)
    rng = random.Random(gram)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    names = [word(rng.randrange(0, 15)) for _ in range(300)] + ["hot-" + word(2) for _ in range(100)] + ["hot-aa"] * 50
    block = [word(rng.randrange(4, 9)) for _ in range(120)] + ["hot-a"]
    allow = [word(rng.randrange(2, 5)) for _ in range(30)] + ["hot-", "t-b"]
    df = table(spark, names).withColumns({"gram": F.lit(1), "entry": F.lit("mine"), "copy": F.lit(0)})
    got = N.filter_names_by_table(df, listed(spark, allow), listed(spark, block), gram=gram, share=share)
    assert got.columns == df.columns
    assert [r.id for r in got.orderBy("id").collect()] == brute(names, allow, block)


def test_no_cross_join_and_no_broadcast(spark, capsys):
    df, entries = table(spark, NAMES), listed(spark, ["abcd", "out"])
    N.drop_listed(df, entries).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan


def test_empty_tables(spark):
    df = table(spark, NAMES)
    assert N.filter_names_by_table(df, listed(spark, []), listed(spark, [])).count() == len(NAMES)
    assert N.filter_names_by_table(df.limit(0), listed(spark, ["a"]), listed(spark, ["b"])).count() == 0
