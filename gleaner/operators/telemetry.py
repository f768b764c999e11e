"""Telemetry lines of unknown shape to a long table ``(gpu, ts, util)``.

The extraction is one projection per line, without shuffle or state, so it serves streams as well.
Nested objects are visited level by level inside the row until none is left; the number of braces
in the line bounds the levels, so no depth is cut off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.probes import (
    LIST,
    OBJECT,
    TYPED,
    as_list,
    as_object,
    each,
    entry_utilization,
    from_json,
    index_entry,
    index_number,
    let,
    line_instant,
    named_reading_index,
    nested_texts,
    only,
    probed,
    speaks_of_use,
)
from gleaner.operators.ordered import Measure, group_rows, position, scan_groups
from gleaner.operators.rowwise import computed

# Fixed value: points kept per series.
DOWNSAMPLE = 2000

# White space that is stripped around a line.
EDGE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
READINGS = "CAST(array() AS array<struct<gpu:bigint,util:double,bad_index:boolean>>)"
NODE = "struct<path:array<string>,entries:array<struct<key:string,value:variant,kind:string,num:double>>>"
NODES = f"CAST(array() AS array<{NODE}>)"


def reading(gpu: str, util: str, bad_index: str = "false") -> str:
    return f"struct(CAST({gpu} AS BIGINT) AS gpu, CAST({util} AS DOUBLE) AS util, {bad_index} AS bad_index)"


def text_at(text: str, path: str) -> str:
    """Text of the object under ``path``, keys in source order."""
    return f"aggregate({path}, {text}, (t, k) -> element_at({nested_texts('t')}, k))"


def contested(objects: str) -> str:
    """Whether any of the objects has several keys that speak of utilization."""
    several = each(objects, lambda o: f"size({only(o, speaks_of_use)}) > 1")
    return f"exists({several}, x -> x)"


def listed_readings(text: str, gpus: str) -> str:
    """Readings of the objects in the ``gpus`` list of the object ``text``."""
    texts = from_json(f"element_at({nested_texts(text)}, 'gpus')", "array<string>")
    objects = from_json(text, f"struct<gpus:array<{TYPED}>>") + ".gpus"
    # A list that also holds other things is refused as a whole, so its objects are opened one by one.
    kinds = each(as_list(gpus), lambda x: f"schema_of_variant({x})")
    mixed = f"zip_with({kinds}, {texts}, (k, t) -> CASE WHEN startswith(k, '{OBJECT}') THEN {from_json('t', TYPED)} END)"
    in_order = each(f"coalesce({objects}, {mixed})", lambda m: f"CASE WHEN {m} IS NOT NULL THEN {probed(m)} END")
    # The parsed objects list their keys sorted. The text is parsed again only where that could matter,
    # for an object with several keys that speak of utilization.
    parsed = each(
        as_list(gpus),
        lambda x: f"""CASE WHEN startswith(schema_of_variant({x}), '{OBJECT}')
            THEN {probed(f"try_variant_get({x}, '$', '{TYPED}')")} END""",
    )
    opened = let(parsed, lambda o: f"CASE WHEN {contested(o)} THEN {in_order} ELSE {o} END")
    read = f"""transform({opened}, (e, i) -> struct({entry_utilization("e", f"get({texts}, i)")} AS util,
        {index_entry("e")} AS index))"""
    numbered = each(
        only(read, lambda r: f"{r}.util IS NOT NULL"),
        lambda r: f"struct({r}.util AS util, {r}.index IS NOT NULL AS given, {index_number(f'{r}.index')} AS gpu)",
    )
    return each(numbered, lambda r: reading(f"{r}.gpu", f"{r}.util", f"({r}.given AND {r}.gpu IS NULL)"))


def gpus_list(entries: str) -> str:
    """The ``gpus`` entry if it holds a list."""
    return f"""try_element_at({only(entries, lambda e: f"{e}.key = 'gpus' AND {e}.kind = '{LIST}'")}, -1)"""


def keyed_readings(entries: str, gpu_count: int | None) -> str:
    """Readings under keys such as ``gpu0_util`` and, if the count is known, in lists of that length."""
    # The cheap test of the key spares most keys the pattern.
    numbered = each(
        only(entries, lambda e: f"{e}.num IS NOT NULL AND startswith(lower({e}.key), 'gpu')"),
        lambda e: f"struct({named_reading_index(f'{e}.key')} AS gpu, {e}.num AS util)",
    )
    keyed = each(
        only(numbered, lambda n: f"{n}.gpu <> ''"), lambda n: reading(f"try_cast({n}.gpu AS BIGINT)", f"{n}.util")
    )
    if not gpu_count:
        return keyed
    lists = each(
        only(entries, lambda e: f"{e}.kind = '{LIST}'"),
        lambda e: probed(f"map_from_entries(transform({as_list(e)}, (x, i) -> struct(CAST(i AS STRING), x)))"),
    )
    full = only(lists, lambda xs: f"size({xs}) = {int(gpu_count)} AND forall({xs}, x -> x.num IS NOT NULL)")
    return f"""concat({keyed}, flatten({each(full, lambda xs: f"transform({xs}, (x, i) -> {reading('i', 'x.num')})")}))"""


def nested_objects(path: str, entries: str) -> str:
    """The nested objects. Those inside lists do not count."""
    return each(
        only(entries, lambda e: f"{e}.kind = '{OBJECT}'"),
        lambda e: f"struct(concat({path}, array({e}.key)) AS path, {probed(as_object(e))} AS entries)",
    )


def nested_readings(text: str, entries: str, gpu_count: int | None = None) -> str:
    """Readings of all nested objects; one with a productive ``gpus`` list is not searched further."""

    def visit(n: str) -> str:
        listed = let(
            gpus_list(f"{n}.entries"),
            lambda g: f"CASE WHEN {g} IS NOT NULL THEN {listed_readings(text_at(text, f'{n}.path'), g)} END",
        )
        return let(
            f"coalesce({listed}, {READINGS})",
            lambda hits: f"""CASE WHEN size({hits}) > 0 THEN struct({NODES} AS open, {hits} AS found)
                ELSE struct({nested_objects(f"{n}.path", f"{n}.entries")} AS open,
                            {keyed_readings(f"{n}.entries", gpu_count)} AS found) END""",
        )

    level = let(
        each("state.open", visit),
        lambda nodes: f"struct(flatten({nodes}.open) AS open, concat(state.found, flatten({nodes}.found)) AS found)",
    )
    braces = f"length({text}) - length(replace({text}, '{{'))"
    roots = nested_objects("CAST(array() AS array<string>)", entries)
    return f"""aggregate(sequence(1, greatest({braces}, 1)),
        struct(CAST({roots} AS array<{NODE}>) AS open, {READINGS} AS found),
        (state, level) -> CASE WHEN size(state.open) = 0 THEN state ELSE {level} END,
        state -> state.found)"""


def plain_numbers(entries: str) -> str:
    """Fallback: every top-level number from 0 to 100 belongs to device 0."""
    return each(
        only(entries, lambda e: f"coalesce({e}.num BETWEEN 0 AND 100, false)"), lambda e: reading("0", f"{e}.num")
    )


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Non-blank lines with ``entries``, NULL if the line is no JSON object.

    The reader stops behind the first object, so the line is also counted as a list of one. Only
    that count does not know bare NaN and Infinity, for which the list is read in full.
    """
    keep = [c for c in lines.columns if c != line]
    trimmed = computed(lines, keep, {"text": F.btrim(F.col(line), F.lit(EDGE))}).filter(F.col("text") != "")
    listed = "concat('[', text, ']')"
    in_full = let(from_json(listed, f"array<{TYPED}>"), lambda o: f"CASE WHEN size({o}) = 1 THEN get({o}, 0) END")
    typed = f"""CASE WHEN NOT endswith(text, '}}') THEN NULL
        WHEN json_array_length({listed}) = 1 THEN {from_json("text", TYPED)}
        WHEN contains(text, 'NaN') OR contains(text, 'Infinity') THEN {in_full} END"""
    return computed(
        computed(trimmed, [*keep, "text"], {"typed": F.expr(typed)}), [*keep, "text"], {"entries": F.expr(probed("typed"))}
    )


def read_lines(parsed: DataFrame, gpu_count: int | None = None) -> DataFrame:
    """Add ``ts`` and ``readings`` to the lines that hold an object."""
    keep = [c for c in parsed.columns if c != "entries"]
    objects = parsed.filter(F.col("entries").isNotNull())
    listed = let(
        gpus_list("entries"), lambda g: f"CASE WHEN {g} IS NOT NULL THEN {listed_readings('text', g)} END"
    )
    first = computed(
        objects,
        [*keep, "entries"],
        {"ts": F.expr(line_instant("entries")), "listed": F.expr(f"coalesce({listed}, {READINGS})")},
    )
    nested = f"exists(entries, e -> e.kind = '{OBJECT}')"
    keyed = keyed_readings("entries", gpu_count)
    found = f"""CASE WHEN size(listed) > 0 THEN listed
        WHEN {nested} THEN concat({keyed}, {nested_readings("text", "entries", gpu_count)}) ELSE {keyed} END"""
    second = computed(first, [*keep, "entries", "ts"], {"found": F.expr(found)})
    readings = f"CASE WHEN size(found) > 0 THEN found ELSE {plain_numbers('entries')} END"
    return computed(second, [*keep, "ts"], {"readings": F.expr(readings)})


def extract_readings(lines: DataFrame, line: str = "value", gpu_count: int | None = None) -> DataFrame:
    """Long table of readings. Lines without a time, and lines of :func:`rejects`, give none."""
    keep = [c for c in lines.columns if c != line]
    read = read_lines(parse_lines(lines, line), gpu_count)
    usable = read.filter("ts IS NOT NULL AND NOT exists(readings, r -> r.bad_index)")
    return usable.select(*keep, "ts", F.explode("readings").alias("r")).select(
        *keep, F.coalesce("r.gpu", F.lit(0)).cast("bigint").alias("gpu"), "ts", F.col("r.util").alias("util")
    )


def rejects(lines: DataFrame, line: str = "value", gpu_count: int | None = None) -> DataFrame:
    """Lines that are JSON but cannot be read: no object, or a device index that is no integer."""
    parsed = parse_lines(lines, line)
    values = from_json("concat('[', text, ']')", "array<variant>")
    no_object = parsed.filter(f"entries IS NULL AND size({values}) = 1").select(
        "text", F.lit("not an object").alias("reason")
    )
    bad_index = read_lines(parsed, gpu_count).filter("exists(readings, r -> r.bad_index)").select(
        "text", F.lit("device index is no integer").alias("reason")
    )
    return no_object.unionByName(bad_index)


def downsample(
    df: DataFrame, series: list[str], order: list[str], k: int = DOWNSAMPLE,
    bucket: Column | None = None,
) -> DataFrame:
    """Every ``max(1, n div k)``-th row of a series with more than ``k`` rows; others stay whole."""
    placed = scan_groups(
        df, series, order, {"_place": position(), "_n": group_rows()}, bucket
    )
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return placed.filter((F.col("_n") <= k) | ((F.col("_place") - 1) % step == 0)).drop("_place", "_n")


def downsample_readings(
    readings: DataFrame, k: int = DOWNSAMPLE, bucket: Column | None = None
) -> DataFrame:
    """:func:`downsample` of a long table, where equal readings may repeat without limit.

    Equal readings are counted first and keep their places as a run, so a value that fills a third
    of the table is one row here.
    """
    runs = readings.groupBy("gpu", "ts", "util").agg(F.count(F.lit(1)).alias("_run"))
    placed = scan_groups(
        runs,
        ["gpu"],
        ["ts", "util"],
        {"_end": Measure("sum", F.col("_run")), "_n": Measure("sum", F.col("_run"), "all")},
        bucket,
    )
    step = F.when(F.col("_n") > k, F.greatest(F.lit(1), F.floor(F.col("_n") / k))).otherwise(F.lit(1))
    # Kept places are 0, step, 2*step, ...; a run covers places [end - run, end).
    before = F.ceil((F.col("_end") - F.col("_run")) / step)
    upto = F.ceil(F.col("_end") / step)
    kept = placed.withColumn("_kept", (upto - before).cast("int")).filter(F.col("_kept") > 0)
    return kept.select("gpu", "ts", "util", F.explode(F.sequence(F.lit(1), F.col("_kept")))).drop("col")


def devices(readings: DataFrame) -> DataFrame:
    return readings.select("gpu").distinct().orderBy("gpu")


def summarise(df: DataFrame, series: list[str], value: str) -> DataFrame:
    """Count, extremes and mean per series."""
    v = F.col(value)
    return df.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean")
    )


def in_time_order(readings: DataFrame) -> DataFrame:
    """Global order by device and instant: a range shuffle, so a large device covers many files."""
    return readings.orderBy("gpu", "ts", "util")
