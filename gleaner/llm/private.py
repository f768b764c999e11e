"""Personal data: base patterns, and terms that give protected entities away.

The base finds e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected
entity. The terms (runs of letters) of all documents that hold it are weighed: corpus counts give
the information content of the entity, IC = ln(N / n(e)), and the pointwise mutual information of term and
entity, PMI = ln(N n(e,t) / (n(e) n(t))). n(e) and n(t) count documents of the whole corpus, n(e,t) those
that hold both. PMI / IC is the share of the entity that the term discloses: 1 if the term occurs nowhere
else; common words have a small one by their n(t). In the documents of the entity, terms are removed from
``REMOVE`` on, and replaced by a general class from ``GENERALISE`` on, wherever they stand. An entity of one
document counts like any other. Documents without personal data are left alone.

Everything is built-in functions. Entities that stand in the same documents are weighed as one class. Terms and classes
are not multiplied: if a term stands in one document of a class only, n(e,t) is that document's, and the share is greatest
for the rarest class there, so a document needs one number. Only terms in several documents of a class are weighed with it,
and they stand in another one than that with most terms; so a page that lists many addresses, which stand elsewhere
too, meets none of their classes with all its terms. Terms too common for any share that counts are left out before. Counts
are combined map-side; of the texts only those with personal data are shuffled. They, their terms and classes are
written to the shared folder, as each is used several times.

Defined cases: a null text counts as empty and has no spans; repeated rows count as documents of their
own and get equal spans; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import documents, id_and_text
from gleaner.operators.rowwise import computed
from gleaner.session import write_through

KINDS = ("email", "ip", "card", "phone")

GENERALISE, REMOVE = 0.6, 0.9
TERM = r"\p{L}{2,}"

# The base patterns with possessive and anchored forms that match the same and take linear time: a run
# is tried from its beginning only, or from where the match before ended.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests that every text with a match passes.
GATES = {
    "email": "contains(text, '@')",
    "ip": r"text RLIKE '[0-9]\\.[0-9]'",
    "card": "text RLIKE '[0-9][0-9]'",
    "phone": "contains(text, '+')",
}
DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": """forall(transform(split(s.value, '[.]'), p -> ltrim('0', p)),
        p -> length(p) < 3 OR (length(p) = 3 AND p <= '255'))""",
    "card": f"""length({DIGITS}) BETWEEN 16 AND 19 AND aggregate(
        transform(split(reverse({DIGITS}), ''), (d, i) -> CASE
            WHEN d = '' THEN 0 WHEN i % 2 = 0 THEN CAST(d AS INT)
            WHEN d >= '5' THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END),
        0, (a, x) -> a + x) % 10 = 0""",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, kind: str) -> str:
    """SQL: spans of all matches; the text between matches tells where each begins, in code points."""
    return f"""aggregate(
        zip_with(regexp_extract_all({text}, {_literal(pattern)}, 0), split({text}, {_literal(pattern)}),
            (m, p) -> struct(m, p)),
        named_struct('at', 0, 'out', slice(array(named_struct('kind', {kind}, 'start', 0, 'end', 0, 'value', '')), 1, 0)),
        (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct(
            'at', a.at + length(x.p) + length(x.m),
            'out', concat(a.out, array(named_struct('kind', {kind}, 'start', a.at + length(x.p),
                'end', a.at + length(x.p) + length(x.m), 'value', x.m)))) END,
        a -> a.out)"""


def base_spans() -> Column:
    """Spans ``kind, start, end, value`` of the base, by kind and start, from the column ``text``."""
    parts = (
        f"CASE WHEN {GATES[k]} THEN filter({matches('text', PATTERNS[k], _literal(k))}, s -> {CHECKS[k]}) END"
        for k in KINDS
    )
    return F.expr(f"flatten(filter(array({', '.join(parts)}), s -> s IS NOT NULL))")


def with_base(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``spans``; rows of one ``row`` have equal ids and texts."""
    found = computed(id_and_text(docs), ["doc_id", "text"], {"spans": base_spans()})
    return found.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("hash")))


def private_rows(base: DataFrame) -> DataFrame:
    """Rows with personal data, equal ones once with their number ``times``. Only these texts are shuffled."""
    some = base.filter(F.size("spans") > 0)
    return some.groupBy("row").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("times"))


def occurrences(private: DataFrame) -> DataFrame:
    """``row``, ``times``, ``term`` and its ``places`` (start, end), for every term outside of personal data."""
    # Digits in place of personal data keep the places of all else and are no letters.
    covered = """aggregate(
        array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end))),
        named_struct('at', 0, 'out', ''),
        (a, s) -> CASE WHEN s.end <= a.at THEN a ELSE named_struct('at', s.end, 'out', concat(a.out,
            substring(text, a.at + 1, greatest(s.start - a.at, 0)), repeat('0', s.end - greatest(s.start, a.at)))) END,
        a -> concat(a.out, substring(text, a.at + 1, length(text))))"""
    plain = computed(private, ["row", "times"], {"plain": F.expr(covered)})
    term = _literal(TERM)
    pieces = plain.select(
        "row",
        "times",
        F.expr(f"posexplode(zip_with(regexp_extract_all(plain, {term}, 0), split(plain, {term}), (m, p) -> struct(m, p)))").alias("i", "t"),
    )
    # The text between the terms tells where each begins; long texts take no more than a running sum.
    upto = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ends = pieces.withColumn("end", F.sum(F.expr("length(t.p) + coalesce(length(t.m), 0)")).over(upto).cast("int"))
    each = ends.filter("t.m IS NOT NULL").select(
        "row", "times", F.lower("t.m").alias("term"), F.expr("struct(end - length(t.m) AS start, end)").alias("place")
    )
    return each.groupBy("row", "times", "term").agg(F.collect_list("place").alias("places"))


def document_counts(docs: DataFrame) -> DataFrame:
    """``term`` and the number of documents that hold it, over the whole corpus."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    return id_and_text(docs).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def classes(private: DataFrame) -> DataFrame:
    """``row``, ``class`` and ``n_entity``: entities that stand in the same rows are one class, weighed once."""
    each = (
        private.select("row", "times", F.explode("spans").alias("s"))
        .select("row", "times", F.concat_ws(":", "s.kind", F.lower("s.value")).alias("entity"))
        .distinct()
    )
    same = F.struct(
        F.count("*").alias("rows"), *[F.bit_xor(F.xxhash64(F.lit(k), F.col("row"))).alias(f"of{k}") for k in (1, 2)]
    )
    entities = each.groupBy("entity").agg(same.alias("class"), F.sum("times").alias("n_entity"))
    return each.select("row", "entity").join(entities, "entity").select("row", "class", "n_entity").distinct()


def share_of(total: Column, n_entity: Column, n_both: Column, n_term: Column) -> Column:
    """Mutual information of term and entity over the information content of the entity."""
    # A run of letters that elsewhere stands only beside personal data is in no count.
    n_term = F.greatest(n_term, n_both)
    content = F.log(total / n_entity)
    return F.when(content > 0, F.log(total * n_both / (n_entity * n_term)) / content).otherwise(F.lit(0.0))


def met_in_several(counted: DataFrame, own: DataFrame, total: Column) -> DataFrame:
    """Terms and the classes of several rows, in all rows of a class but ``most``, the one with most terms.

    ``row, class, n_entity, most, term, times, n_term``.
    """
    several = own.filter("class.rows > 1").join(counted.groupBy("row").agg(F.count("*").alias("n")), "row")
    most = several.groupBy("class").agg(F.max(F.struct("n", "row")).alias("most")).select("class", F.col("most.row").alias("most"))
    smaller = several.join(most, "class").filter("row <> most").select("row", "class", "n_entity", "most")
    # n(e,t) is n(e) at most, so a term that stands in more documents than this has too small a share.
    bound = F.col("n_entity") * F.pow(total / F.col("n_entity"), F.lit(1 - GENERALISE))
    common = F.col("n_term") > F.ceil(bound * 1.001)
    return smaller.join(counted, "row").filter(~F.coalesce(common, F.lit(False)))


def disclosure(docs: DataFrame, terms: DataFrame, own: DataFrame) -> DataFrame:
    """``row``, ``term`` and a ``share`` from ``GENERALISE`` on: the greatest is that of the entities it tells most of.

    ``terms`` holds ``row, times, term``, ``own`` the classes of the rows.
    """
    total = docs.agg(F.count("*")).scalar().cast("double")
    counted = write_through(terms.join(document_counts(docs), "term", "left"))
    share = lambda n_both: share_of(total, F.col("n_entity"), F.col(n_both), F.col("n_term"))
    # With the rarest class of its row, as if the term stood in no other row of that class.
    rarest = own.groupBy("row").agg(F.min("n_entity").alias("n_entity"))
    alone = counted.join(rarest, "row").select("row", "term", share("times").alias("share"))

    met = write_through(met_in_several(counted, own, total))
    sums = met.groupBy("class", "term", "n_entity", "most").agg(F.sum("times").alias("n_small"), F.first("n_term").alias("n_term"))
    there = terms.select(F.col("row").alias("most"), "term", F.col("times").alias("n_most"))
    both = sums.join(there, ["most", "term"], "left").withColumn("n_both", F.col("n_small") + F.coalesce("n_most", F.lit(0)))
    shares = both.select("class", "term", "most", "n_most", share("n_both").alias("share")).filter(F.col("share") >= GENERALISE)
    in_small = met.select("row", "class", "term").join(shares, ["class", "term"]).select("row", "term", "share")
    in_most = shares.filter("n_most IS NOT NULL").select(F.col("most").alias("row"), "term", "share")
    return alone.unionByName(in_small).unionByName(in_most).filter(F.col("share") >= GENERALISE)


def all_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, the base ``spans`` and the ``terms`` (start, end, action)."""
    base = with_base(docs)
    private = write_through(private_rows(base))
    met = write_through(occurrences(private))
    shares = disclosure(docs, met.select("row", "times", "term"), write_through(classes(private)))
    action = F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise")
    told = shares.groupBy("row", "term").agg(action.alias("action"))
    found = told.join(met.select("row", "term", "places"), ["row", "term"])
    placed = F.expr("flatten(collect_list(transform(places, p -> struct(p.start, p.end, action))))")
    terms = found.groupBy("row").agg(F.sort_array(placed).alias("terms"))
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, action: string>>)")
    return base.join(terms, "row", "left").select("doc_id", "text", "spans", F.coalesce("terms", none).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``text`` with personal data replaced by its kind, and terms removed or generalised."""
    marks = F.expr(
        """array_sort(concat(
            transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'by', concat('[', s.kind, ']'))),
            transform(terms, t -> named_struct('start', t.start, 'end', t.end, 'by', CASE
                WHEN t.action = 'remove' THEN ''
                WHEN substring(text, t.start + 1, 1) RLIKE '\\\\p{Lu}' THEN '[Name]' ELSE '[word]' END))))"""
    )
    cleaned = F.expr(
        """aggregate(marks, named_struct('at', 0, 'out', ''),
            (a, m) -> CASE WHEN m.start < a.at THEN a ELSE named_struct('at', m.end,
                'out', concat(a.out, substring(text, a.at + 1, m.start - a.at), m.by)) END,
            a -> concat(a.out, substring(text, a.at + 1, length(text))))"""
    )
    private = all_spans(docs).filter(F.size("spans") > 0).withColumn("marks", marks)
    return private.select("doc_id", cleaned.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_spans(documents(spark, sf_dir))
    told = "concat_ws(':', s.kind, CAST(s.start AS STRING), CAST(s.end AS STRING))"
    base = f"transform(spans, s -> {told})"
    terms = "transform(terms, s -> concat_ws(':', 'term', CAST(s.start AS STRING), CAST(s.end AS STRING)))"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(concat({base}, {terms}), ',')").alias("spans"),
        F.expr("CAST(size(filter(terms, t -> t.action = 'remove')) AS BIGINT)").alias("n_removed"),
        F.expr("CAST(size(filter(terms, t -> t.action = 'generalise')) AS BIGINT)").alias("n_generalised"),
    )


QUERIES = {"op2_private_terms": query}
SQL: dict[str, str] = {}
