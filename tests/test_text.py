from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.lines import clean_lines, explode_lines


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_trim_end_takes_every_blank(spark):
    got = column(spark, ["a ﻿", " b\t\x0b", "c ", "d\u0085", "", "\t "], T.trim_end)
    assert got == ["a", " b", "c", "d\u0085", "", ""]


def test_utf16_length_counts_astral_twice(spark):
    assert column(spark, ["a", "é", "😀" * 3, ""], T.utf16_length) == [1, 1, 6, 0]


def test_line_screen(spark):
    lines = ["});", "  {} ", "a" * 120, "a" * 121, "x", "", "a ﻿", "😀" * 60, "😀" * 61, " ;", "{x}"]
    got = column(spark, lines, lambda c: T.is_clean_line(T.trim_end(c)))
    assert got == [False, False, True, False, True, False, True, True, False, False, True]


def test_lines_split_on_both_endings(spark):
    df = spark.createDataFrame([("f", "a\r\nb \n\n;\rc")], "file string, text string")
    assert [tuple(r) for r in explode_lines(df).orderBy("pos").collect()] == [
        ("f", 0, "a"), ("f", 1, "b"), ("f", 2, ""), ("f", 3, ";\rc"),
    ]
    assert [r.line for r in clean_lines(df).orderBy("pos").collect()] == ["a", "b", ";\rc"]


def test_long_run_of_blanks_is_fast(spark):
    got = column(spark, ["a" + " " * 200_000 + "b"], lambda c: F.length(T.trim_end(c)))
    assert got == [200_002]


def test_comma_list(spark):
    assert column(spark, [" Py, js ,,\tTS ", "", "a"], lambda c: T.comma_list(c, lower=True)) == [
        ["py", "js", "ts"], [], ["a"],
    ]


def test_file_names(spark):
    rows = [
        ("alpha-kit", "src/app/main.py", "alpha-kit__src__app__main.py"),
        ("a b", "x y/é.md", "a-b__x-y__-.md"),
        ("r.s_t", "one//two", "r.s_t__one____two"),
    ]
    df = spark.createDataFrame(rows, "repo string, path string, want string")
    assert df.filter(T.safe_file_name(F.col("repo"), F.col("path")) != F.col("want")).count() == 0


def test_links(spark):
    page = "https://me.example.org/a"
    rows = [
        ("cv.html", False, False, None),
        ("https://other.example/x", True, True, "other.example"),
        ("http://me.example.org/x", True, True, "me.example.org"),
        ("https://me.example.org:443/x", True, False, "me.example.org"),
        ("HTTPS://ME.example.org/x", False, False, "me.example.org"),
        ("//cdn.example/x", False, True, "cdn.example"),
        ("mailto:a@b.c", False, True, None),
        ("#top", False, False, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    got = df.select(
        "url", T.is_http_link(F.col("url")), T.is_foreign_origin(F.col("url"), F.lit(page)), T.link_host(F.col("url"))
    ).collect()
    assert [tuple(r) for r in got] == rows
