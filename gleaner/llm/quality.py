"""Quality rules: a threshold table compiled into one projection of built-in functions.

``measured`` adds the signals of a text, ``verdict`` compiles a table of thresholds over them into one
array of the names of failed rules. No user function runs; every document is decided in its own row,
without a shuffle.

Defined cases: a null text counts as empty; an empty text has all signals 0 and fails the length rule;
repeated rows are decided each on their own; extra columns of any name are kept apart from the signals;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import BLANK_CLASS, BLANKS, documents
from gleaner.operators.rowwise import computed

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is was that for on as with be by at from or are this it "
    "le la les de des et un une est pour dans que qui par sur "
    "der die das und den von zu mit ist im ein eine nicht auf sich "
    "el los las del y en se por con una su para como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``value`` (SQL over the signals) is below ``least`` or above ``most``."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0  # texts of fewer words are too short for the ratio

    def failed(self) -> str:
        tests = [f"{self.value} < {self.least}"] * (self.least is not None)
        tests += [f"{self.value} > {self.most}"] * (self.most is not None)
        return f"(n_words >= {self.from_words} AND ({' OR '.join(tests)}))"


# Lengths, symbol, stop-word and line ratios.
RULES = (
    Rule("few_words", "n_words", least=MIN_WORDS),
    Rule("word_length", "word_chars / greatest(n_words, 1)", least=2, most=20, from_words=MIN_WORDS),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", most=0.3, from_words=MIN_WORDS),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", least=0.005, from_words=100),
    Rule("exclamations", "n_exclamations / greatest(n_words, 1)", most=0.5, from_words=MIN_WORDS),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", most=0.5, from_words=MIN_WORDS),
)


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression: names of the failed rules, in the table's order."""
    tests = ", ".join(f"CASE WHEN {r.failed()} THEN '{r.name}' END" for r in rules)
    return F.expr(f"array_compact(array({tests}))")


def doubled(hashes: str, step: int) -> str:
    """SQL: hashes of runs twice as long, from each run and the one ``step`` places on."""
    return f"""zip_with(
        slice({hashes}, 1, greatest(size({hashes}) - {step}, 0)), slice({hashes}, {step + 1}, size({hashes})),
        (a, b) -> xxhash64(a, b))"""


def repeated_words(windows: str, window: int = WINDOW) -> str:
    """SQL: words in windows that occur at least twice; ``windows`` is an array of window hashes.

    Windows are sorted with their places; those equal to a neighbour are repeated. The places are then
    walked in order, each adding the words that the one before does not cover.
    """
    return f"""aggregate(
        sort_array(transform(filter(
            flatten(transform(
                array(sort_array(transform({windows}, (h, i) -> struct(h, i)))),
                s -> transform(s, (x, k) -> struct(x.i AS i,
                    (k > 0 AND s[greatest(k - 1, 0)].h = x.h)
                    OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h) AS twice))
            )), y -> y.twice), y -> y.i)),
        named_struct('n', 0L, 'last', {-window}),
        (a, i) -> named_struct('n', a.n + least({window}, i - a.last), 'last', i),
        a -> a.n)"""


def measured(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the signals of the column ``text``; each step feeds the next one, nothing is split twice."""
    split = df.select(
        *keep, F.coalesce(F.col(text), F.lit("")).alias("raw"),
    ).withColumn("trimmed", F.btrim("raw", F.lit(BLANKS))).select(
        *keep,
        "raw",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
        .otherwise(F.split("trimmed", f"{BLANK_CLASS}+")).alias("words"),
        F.filter(F.split("raw", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    # Hash of a window by doubling: words, pairs, fours, eights. Where no four occurs twice, no eight does.
    hashed = split.withColumn("fours", F.expr("transform(words, w -> xxhash64(w))"))
    for step in (1, 2):
        hashed = hashed.withColumn("fours", F.expr(doubled("fours", step)))
    windows = F.expr(f"""CASE WHEN size(array_distinct(fours)) = size(fours) THEN slice(fours, 1, 0)
        ELSE {doubled("fours", 4)} END""")
    counted = hashed.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("raw", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("raw", F.lit("!")).cast("long").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("windows"),
    )
    once = "size(array_distinct(windows)) = size(windows)"
    repeats = F.expr(f"CASE WHEN {once} THEN 0L ELSE {repeated_words('windows')} END")
    return counted.withColumn("n_repeat_words", repeats).drop("windows")


def judged(df: DataFrame, text: str, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The signals, ``base_failed``, the names of ``failed`` rules and ``kept``."""
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    return (
        measured(df, text, keep)
        .withColumns({"base_failed": F.expr(base), "failed": failed_rules(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only.

    The verdict goes through a one-row generator: a filter on it would else be pushed down, and every
    signal computed again for each time that it is mentioned.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return computed(judged(rows, "row.text", ["row"], rules), ["row"], {"kept": F.col("kept")}).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = judged(documents(spark, sf_dir), "text", ["doc_id"])
    return rules.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "n_exclamations", F.array_join("failed", ",").alias("failed"),
    )


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    nexts = ", ".join(f"lead(word, {k}) OVER d" for k in range(1, WINDOW))
    tests = ", ".join(f"CASE WHEN {r.failed()} THEN '{r.name}' END" for r in rules)
    return rf"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS raw,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), places AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split
    ), runs AS (
        SELECT doc_id, i, concat_ws(' ', word, {nexts}) AS run, lead(i, {WINDOW - 1}) OVER d AS last
        FROM places WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs WHERE last IS NOT NULL
    ), steps AS (
        SELECT doc_id, least({WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {WINDOW})) AS step
        FROM windows WHERE n > 1
    ), repeats AS (
        SELECT doc_id, sum(step) AS n FROM steps GROUP BY doc_id
    ), signals AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
            CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(raw, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(length(regexp_replace(raw, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
            CAST(len(lines) AS BIGINT) AS n_lines,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(len(list_filter(words, lambda x: list_contains([{stop}], lower(x)))) AS BIGINT) AS n_stop_words,
            CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
        FROM split LEFT JOIN repeats USING (doc_id)
    ), tested AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
            list_filter([{tests}], lambda x: x IS NOT NULL) AS failed
        FROM signals
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND len(failed) = 0 AS kept, n_lines, n_stop_words, n_exclamations,
        array_to_string(failed, ',') AS failed
    FROM tested
    """


QUERIES = {"op10_quality_rules": query}
SQL = {"op10_quality_rules": _sql()}
