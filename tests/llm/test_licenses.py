import random
import re

from fixtures import AWKWARD, documents, saved
from pyspark.sql import functions as F

from gleaner.llm import licenses
from gleaner.llm.licenses import GRANT, NAME, RULES, VERSION, Rule


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, rules=RULES):
    words = words_of(text)
    form = " " + " ".join(words) + " "
    base = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    found = []
    for r in rules:
        if r.keyword in form:
            for m in re.finditer(r.regex, form):
                start = form[: m.start()].count(" ")
                found.append((start, start + m[0].count(" "), r))
    left = [
        (s, e, r)
        for s, e, r in found
        if not any(
            a <= s
            and b >= e
            and q is not r
            and (q.priority > r.priority or (q.priority == r.priority and (b - a > e - s or q.rank < r.rank)))
            for a, b, q in found
        )
    ]
    left.sort(key=lambda x: (x[0], -x[1], -x[2].priority, x[2].rank))
    starts = [i for i, _ in base]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted({x for _, x in base} | {r.label for _, _, r in left})),
        "score": max((licenses.SCORES[r.priority] for _, _, r in left), default=0.0),
        "n_found": len(found),
        "detections": ",".join(f"{r.label}:{s}:{e}" for s, e, r in left),
    }


def texts():
    rng = random.Random(7)
    bits = [
        "Released UNDER the MIT license.", "licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0",
        "GNU General Public License, version 3 or (at your option) any later version", "all rights reserved",
        "BSD 3-Clause License", "Creative Commons Attribution-ShareAlike 4.0", "the mit licence", "cc by nc",
        "copyright (c) 2021", "GNU Lesser General Public License version 2.1", "gpl v2 or later", "MPL 2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "public domain dedication",
        "alle Rechte vorbehalten", "SPDX-License-Identifier: GPL-3.0", "under the mit license under the mit license",
    ]
    fill = ["the", "license", "é", "mit", "cc", "by", "nc", "K", "x1", "—", "\n", "apache", "gnu"]
    out = list(AWKWARD)
    for _ in range(60):
        out.append(" ".join(rng.choice(bits) if rng.random() < 0.3 else rng.choice(fill) for _ in range(rng.randrange(1, 40))))
    return out + ["released under the mit license. " * 400, bits[0], bits[0]]


def test_query_equals_brute_force(spark, tmp_path):
    given = texts()
    got = {r.doc_id: r.asDict() for r in licenses.query(spark, saved(spark, tmp_path, documents(spark, given))).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, text


def test_every_regex_needs_its_keyword():
    """The prefilter must not hide a match: what a rule matches always holds the rule's keyword."""
    samples = [" " + " ".join(words_of(t)) + " " for t in texts()]
    for r in RULES:
        for s in samples:
            for m in re.finditer(r.regex, s):
                assert r.keyword in s, (r, m[0])


def test_there_are_hundreds_of_rules_of_distinct_rank():
    assert len(RULES) > 200 and [r.rank for r in RULES] == list(range(len(RULES)))


def test_suppression_of_equal_and_crossing_intervals(spark):
    rules = [
        Rule(0, "wide", "a", " a b c(?= )", NAME),
        Rule(1, "inner", "a", " b(?= )", GRANT),
        Rule(2, "same", "a", " a b c(?= )", NAME),
        Rule(3, "cross", "a", " c d(?= )", VERSION),
        Rule(4, "low", "a", " d(?= )", NAME),
    ]
    row = licenses.scanned(documents(spark, ["a b c d"]), rules).first()
    assert [d.label for d in row.detections] == ["wide", "inner", "cross"]
    assert brute("a b c d", rules)["detections"] == "wide:0:3,inner:1:2,cross:2:4"


def test_empty_table_and_clashing_columns(spark):
    docs = documents(spark, ["under the mit license"])
    assert licenses.scanned(docs.limit(0)).count() == 0
    assert licenses.scanned(docs.withColumn("words", F.lit(1)).withColumn("held", F.lit(2))).first().n_words == 4
