"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its lower-case words, each after one space. Rules are regexes over that form; they are
generated from the short tables below, a few hundred in all. A rule runs only on texts that hold its
keyword. Every match is an interval of words. A detection is suppressed if its interval lies within that
of a detection of higher priority, or of equal priority that is wider or comes earlier in the table.

Everything happens in one row: one projection of built-in functions, no shuffle.

Defined cases: a null text counts as empty and has no detections; repeated rows are scanned each on their
own; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import documents, id_and_text

# The phrases that always count, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Priorities: a grant in full words, a named license with its version, a bare name, a notice.
GRANT, VERSION, NAME, NOTICE = 4, 3, 2, 1
SCORES = {GRANT: 1.0, VERSION: 0.9, NAME: 0.7, NOTICE: 0.3}

V = r"(?: version| v| ver)?"
LICENSE = r"(?: public)? licen[sc]e"

# Families with versions: label, keyword, name, versions (words apart).
VERSIONED = (
    ("gpl", "general public", r"(?: gnu)? general public licen[sc]e", ("1 0", "1", "2 0", "2", "3 0", "3")),
    ("gpl", "gpl", r"(?: gnu)? gpl", ("1 0", "1", "2 0", "2", "3 0", "3")),
    ("lgpl", "lesser general", r"(?: gnu)? lesser general public licen[sc]e", ("2 1", "3 0", "3")),
    ("lgpl", "library general", r"(?: gnu)? library general public licen[sc]e", ("2 0", "2")),
    ("lgpl", "lgpl", r"(?: gnu)? lgpl", ("2 0", "2 1", "2", "3 0", "3")),
    ("agpl", "affero", r"(?: gnu)? affero general public licen[sc]e", ("1 0", "3 0", "3")),
    ("agpl", "agpl", r"(?: gnu)? agpl", ("1 0", "3 0", "3")),
    ("gfdl", "free documentation", r"(?: gnu)? free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r" apache(?: software)? licen[sc]e", ("1 0", "1 1", "2 0", "2")),
    ("apache", "apache", r" apache", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla", r" mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", r" mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", r" eclipse public licen[sc]e", ("1 0", "2 0")),
    ("epl", "epl", r" epl", ("1 0", "2 0")),
    ("cddl", "common development", r" common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cddl", "cddl", r" cddl", ("1 0", "1 1")),
    ("cpl", "common public", r" common public licen[sc]e", ("1 0",)),
    ("cpal", "common public attribution", r" common public attribution licen[sc]e", ("1 0",)),
    ("eupl", "european union", r" european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", r" eupl", ("1 0", "1 1", "1 2")),
    ("osl", "open software", r" open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r" academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", r" artistic licen[sc]e", ("1 0", "2 0")),
    ("lppl", "latex project", r" latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3")),
    ("zpl", "zope", r" zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("php", "php", r" php licen[sc]e", ("2 0", "3 0", "3 01")),
    ("python", "python", r" python(?: software foundation)? licen[sc]e", ("2 0", "2")),
    ("ofl", "open font", r"(?: sil)? open font licen[sc]e", ("1 0", "1 1")),
    ("boost", "boost", r" boost software licen[sc]e", ("1 0",)),
    ("ecl", "educational community", r" educational community licen[sc]e", ("1 0", "2 0")),
    ("qpl", "q public", r" q public licen[sc]e", ("1 0",)),
    ("odbl", "open database", r" open database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons attribution", r" open data commons attribution licen[sc]e", ("1 0",)),
    ("upl", "universal permissive", r" universal permissive licen[sc]e", ("1 0",)),
    ("bsl", "business source", r" business source licen[sc]e", ("1 0", "1 1")),
    ("sspl", "server side", r" server side public licen[sc]e", ("1 0", "1")),
    ("cecill", "cecill", r" cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("mulan", "mulan", r" mulan permissive software licen[sc]e", ("1", "2")),
)

# Elements and versions of the attribution licenses.
CC_ELEMENTS = (("by", "attribution"), ("sa", "share ?alike"), ("nd", "no ?deriv(?:ative)?s"), ("nc", "non ?commercial"))
CC_KINDS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Names and notices without a version: label, keyword, regex, priority.
PLAIN = (
    ("mit", "permission is hereby granted", r" permission is hereby granted free of charge to any person obtaining a copy", GRANT),
    ("mit", "mit", r" (?:under|with|by) (?:the )?(?:terms of the )?mit licen[sc]e", GRANT),
    ("mit", "mit", r" mit licensed", NAME),
    ("mit", "mit", r" mit licen[sc]e", NAME),
    ("mit", "expat", r" expat licen[sc]e", NAME),
    ("isc", "permission to use copy modify", r" permission to use copy modify and or distribute this software", GRANT),
    ("isc", "isc", r" isc licen[sc]e", NAME),
    ("bsd", "redistribution and use", r" redistribution and use in source and binary forms with or without modification", GRANT),
    ("bsd-0", "bsd", r" (?:0|zero) clause bsd(?: licen[sc]e)?", VERSION),
    ("bsd-2", "bsd", r" (?:2|two) clause bsd(?: licen[sc]e)?", VERSION),
    ("bsd-3", "bsd", r" (?:3|three) clause bsd(?: licen[sc]e)?", VERSION),
    ("bsd-4", "bsd", r" (?:4|four) clause bsd(?: licen[sc]e)?", VERSION),
    ("bsd-2", "bsd", r" bsd 2 clause", VERSION),
    ("bsd-3", "bsd", r" bsd 3 clause", VERSION),
    ("bsd-4", "bsd", r" bsd 4 clause", VERSION),
    ("bsd-2", "simplified bsd", r" simplified bsd licen[sc]e", VERSION),
    ("bsd-3", "new bsd", r" new bsd licen[sc]e", VERSION),
    ("bsd", "bsd", r" bsd(?: style)? licen[sc]e", NAME),
    ("apache-2", "apache org licenses", r" www apache org licenses license 2 0", GRANT),
    ("gpl", "redistribute it and or modify", r" redistribute it and or modify it under the terms of the gnu", GRANT),
    ("unlicense", "released into the public domain", r" free and unencumbered software released into the public domain", GRANT),
    ("unlicense", "unlicense", r" unlicense", NAME),
    ("wtfpl", "wtfpl", r" wtfpl", NAME),
    ("zlib", "zlib", r" zlib(?: libpng)? licen[sc]e", NAME),
    ("ms-pl", "microsoft public", r" microsoft public licen[sc]e", NAME),
    ("ms-rl", "microsoft reciprocal", r" microsoft reciprocal licen[sc]e", NAME),
    ("ncsa", "ncsa", r" university of illinois ncsa open source licen[sc]e", NAME),
    ("postgresql", "postgresql", r" postgresql licen[sc]e", NAME),
    ("cc0", "cc0", r" cc0(?: 1 0)?(?: universal)?", NAME),
    ("cc0", "cc zero", r" cc zero", NAME),
    ("public-domain", "public domain", r" (?:in|into) the public domain", NAME),
    ("public-domain", "public domain dedication", r" public domain dedication", NAME),
    ("proprietary", "proprietary", r" proprietary and confidential", NAME),
    ("reserved", "all rights reserved", r" all rights reserved", NOTICE),
    ("reserved", "tous droits", r" tous droits réservés", NOTICE),
    ("reserved", "alle rechte", r" alle rechte vorbehalten", NOTICE),
    ("reserved", "todos los derechos", r" todos los derechos reservados", NOTICE),
    ("copyright", "copyright", r" copyright(?: c)? [12][0-9]{3}", NOTICE),
    ("identifier", "spdx", r" spdx license identifier", NOTICE),
)


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    keyword: str
    regex: str
    priority: int


def build_rules() -> list[Rule]:
    """The ordered table: fixed phrases, versions, attribution kinds, names and notices."""
    found: list[tuple[str, str, str, int]] = [(label, phrase, f" {phrase}", GRANT) for phrase, label in PHRASES]
    for label, keyword, name, versions in VERSIONED:
        for version in versions:
            short = version.removesuffix(" 0").replace(" ", ".")
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                later = rf"{name}{V} {version}(?: of the licen[sc]e)? or(?: at your option)?(?: any)? later(?: version)?"
                found.append((f"{label}-{short}-or-later", keyword, later, GRANT))
            found.append((f"{label}-{short}", keyword, rf"{name}{V} {version}", VERSION))
        found.append((label, keyword, name, NAME))
    for kind in CC_KINDS:
        label = "cc-" + kind.replace(" ", "-")
        names = r" ".join(dict(CC_ELEMENTS)[e] for e in kind.split())
        for name, keyword in ((f" cc {kind}", f"cc {kind}"), (f" creative commons {names}", "creative commons")):
            for version in CC_VERSIONS:
                found.append((f"{label}-{version.replace(' ', '.')}", keyword, f"{name}(?: licen[sc]e)? {version}", VERSION))
            found.append((label, keyword, name, NAME))
    found.append(("cc", "creative commons", r" creative commons(?: licen[sc]e)?", NOTICE))
    found += PLAIN
    return [Rule(i, label, keyword, f"{regex}(?= )", p) for i, (label, keyword, regex, p) in enumerate(found)]


RULES = build_rules()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_array(rules: list[Rule]) -> str:
    rows = (
        f"named_struct('rank', {r.rank}, 'label', {_quoted(r.label)}, 'keyword', {_quoted(r.keyword)}, "
        f"'regex', {_quoted(r.regex)}, 'priority', {r.priority})"
        for r in rules
    )
    return f"array({', '.join(rows)})"


def n_spaces(text: str) -> str:
    """SQL: words in a piece of the normal form."""
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def intervals(form: str, regex: str, fields: str) -> str:
    """SQL: intervals of words of all matches; the text between matches tells how many words came before."""
    return f"""aggregate(
        zip_with(regexp_extract_all({form}, {regex}, 0), split({form}, {regex}), (m, p) -> struct(m, p)),
        named_struct('at', 0, 'out', slice(array(named_struct('start', 0, 'end', 0, {fields})), 1, 0)),
        (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct(
            'at', a.at + {n_spaces('x.p')} + {n_spaces('x.m')},
            'out', concat(a.out, array(named_struct(
                'start', a.at + {n_spaces('x.p')}, 'end', a.at + {n_spaces('x.p')} + {n_spaces('x.m')}, {fields})))) END,
        a -> a.out)"""


def suppressed(found: str) -> str:
    """SQL: detections left of a sorted array.

    Sorted by start, wider first, then priority and rank, whatever contains a detection comes before it;
    so the furthest end so far at its priority or above decides.
    """
    ends = ", ".join(f"'e{p}', greatest(a.e{p}, CASE WHEN x.priority >= {p} THEN x.end ELSE 0 END)" for p in SCORES)
    reach = " ".join(f"WHEN {p} THEN a.e{p}" for p in SCORES)
    zeros = ", ".join(f"'e{p}', 0" for p in SCORES)
    return f"""aggregate({found}, named_struct({zeros}, 'out', slice({found}, 1, 0)),
        (a, x) -> named_struct({ends},
            'out', CASE WHEN (CASE x.priority {reach} END) >= x.end THEN a.out ELSE concat(a.out, array(x)) END),
        a -> a.out)"""


def scanned(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``base`` intervals, the ``detections`` left and the number ``n_found`` before."""
    rules = RULES if rules is None else rules
    upper = "".join(map(chr, range(65, 91)))
    words = docs.transform(id_and_text).select(
        "doc_id",
        F.regexp_extract_all(
            F.translate("text", upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)
        ).alias("words"),
    )
    forms = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("form"),
    )
    keywords = ", ".join(_quoted(k) for k in dict.fromkeys(r.keyword for r in rules))
    gated = forms.withColumn("held", F.expr(f"filter(array({keywords}), k -> contains(form, k))"))
    base = ", ".join(
        f"CASE WHEN contains(form, ' {phrase} ') THEN {intervals('form', _quoted(f' {phrase}(?= )'), _quoted('label') + ', ' + _quoted(label))} END"
        for phrase, label in PHRASES
    )
    fields = "'rank', r.rank, 'priority', r.priority, 'label', r.label"
    found = f"""CASE WHEN size(held) > 0 THEN flatten(transform(
        filter({_rule_array(rules)}, r -> array_contains(held, r.keyword)),
        r -> {intervals('form', 'r.regex', fields)})) END"""
    order = "(x, y) -> CASE " + " ".join(
        f"WHEN x.{c} {o} y.{c} THEN -1 WHEN y.{c} {o} x.{c} THEN 1"
        for c, o in (("start", "<"), ("end", ">"), ("priority", ">"), ("rank", "<"))
    ) + " ELSE 0 END"
    return (
        gated.select(
            "doc_id",
            "n_words",
            F.expr(f"flatten(filter(array({base}), b -> b IS NOT NULL))").alias("base"),
            F.expr(found).alias("found"),
        )
        .withColumn("found", F.expr(f"array_sort(coalesce(found, slice(found, 1, 0)), {order})"))
        .withColumn("detections", F.when(F.col("found").isNotNull(), F.expr(suppressed("found"))))
        .select(
            "doc_id", "n_words", "base", "detections", F.coalesce(F.size("found"), F.lit(0)).alias("n_found")
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = " ".join(f"WHEN {p} THEN {s}D" for p, s in SCORES.items())
    return scanned(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, b -> CAST(b.start AS BIGINT)))").alias("first_word"),
        F.expr("array_max(transform(base, b -> CAST(b.start AS BIGINT)))").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',')").alias("base_labels"),
        F.expr(
            "array_join(array_sort(array_distinct(concat(transform(base, b -> b.label), "
            "coalesce(transform(detections, d -> d.label), array())))), ',')"
        ).alias("labels"),
        F.expr(f"coalesce(array_max(transform(detections, d -> CASE d.priority {cases} END)), 0D)").alias("score"),
        F.col("n_found").cast("long").alias("n_found"),
        F.expr(
            "array_join(transform(coalesce(detections, array()), "
            "d -> concat_ws(':', d.label, CAST(d.start AS STRING), CAST(d.end AS STRING))), ',')"
        ).alias("detections"),
    )


QUERIES = {"op4_license_scan": query}
SQL: dict[str, str] = {}
