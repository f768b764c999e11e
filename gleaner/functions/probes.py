"""Probing JSON objects of unknown shape.

An object travels as its JSON text. ``from_json(.., map<string,variant>)`` gives its entries in
source order with their JSON types; ``from_json(.., map<string,string>)`` gives the text of the
nested ones. (A VARIANT object alone would return its keys sorted, so "first key wins" could not be
answered from it.) Entries are turned into ``(key, value, kind, num)`` once and probed from there.

The expressions nest deeply, so these functions take and return Spark SQL text: one parse of the
whole is far quicker than building every node from Python.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

# The keys that are looked at, in this order.
TIME_KEYS = ["ts", "timestamp", "time", "t"]
UTIL_WORDS = ["util", "usage"]
NAMED_READING = r"^gpu[_-]?(\d+)[_\-]?.*util"

TYPED = "map<string,variant>"

# Kinds are the first letters of the type a VARIANT reports.
NUMBERS = ["BIGINT", "DOUBLE", "FLOAT", "DECIMA"]
OBJECT, LIST, STRING, BOOLEAN, NULL = "OBJECT", "ARRAY<", "STRING", "BOOLEA", "VOID"

# Range of calendar years 1 to 9999 in epoch seconds.
MIN_EPOCH = -62135596800
MAX_EPOCH = 253402300800

ISO_CLOCK = r"\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?"
ISO_OFFSET = r"[+-]\d{2}:?\d{2}(:?\d{2})?|Z"
ISO_TIME = rf"^\d{{4}}-\d{{2}}-\d{{2}}([\s\S]{ISO_CLOCK}({ISO_OFFSET})?)?$"
DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

_names = count()


def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def bound(function: str, array: str, body: Callable[[str], str]) -> str:
    """A higher-order function over ``array`` with a variable of its own."""
    name = f"v{next(_names)}"
    return f"{function}({array}, {name} -> {body(name)})"


def each(array: str, body: Callable[[str], str]) -> str:
    return bound("transform", array, body)


def only(array: str, test: Callable[[str], str]) -> str:
    return bound("filter", array, test)


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times inside ``body``.

    The struct around the result has a fixed type. Without it the type of the whole body would be
    derived again for every row.
    """
    return f"get({each(f'array({value})', lambda x: f'struct({body(x)} AS it)')}, 0).it"


def first_of(values: str) -> str:
    """First non-null element, NULL if there is none."""
    return let(values, lambda vs: f"get({only(vs, lambda x: f'{x} IS NOT NULL')}, 0)")


def from_json(text: str, kind: str) -> str:
    """Strict where the reader is lenient by default."""
    return f"from_json({text}, '{kind}', map('allowSingleQuotes', 'false', 'allowNumericLeadingZeros', 'false'))"


def probed(typed: str) -> str:
    """Map of variants to the array of its entries ``(key, value, kind, num)``, in source order."""
    kinds = each(
        f"map_entries({typed})",
        lambda e: f"struct({e}.key AS key, {e}.value AS value, substring(schema_of_variant({e}.value), 1, 6) AS kind)",
    )
    # A JSON number. Booleans are not, nor is a bare NaN.
    return each(
        kinds,
        lambda e: f"""struct({e}.key AS key, {e}.value AS value, {e}.kind AS kind,
            CASE WHEN {e}.kind IN ({words(NUMBERS)})
                 THEN nanvl(try_cast({as_text(e)} AS DOUBLE), CAST(NULL AS DOUBLE)) END AS num)""",
    )


def entries_of(text: str) -> str:
    """Entries of the object written in ``text``."""
    return probed(from_json(text, TYPED))


def nested_texts(text: str) -> str:
    return from_json(text, "map<string,string>")


def entry_at(entries: str, key: str) -> str:
    """Entry of a key, the last one if the key repeats."""
    found = only(entries, lambda e: f"{e}.key = '{key}'")
    return f"try_element_at({found}, -1)"


def as_object(entry: str) -> str:
    return f"try_variant_get({entry}.value, '$', '{TYPED}')"


def as_list(entry: str) -> str:
    return f"try_variant_get({entry}.value, '$', 'array<variant>')"


def as_text(entry: str) -> str:
    return f"try_variant_get({entry}.value, '$', 'string')"


def as_flag(entry: str) -> str:
    return f"try_variant_get({entry}.value, '$', 'boolean')"


def epoch_instant(seconds: str) -> str:
    """Epoch seconds to an instant, microseconds half to even; NULL outside years 1-9999."""
    return f"""CASE WHEN {seconds} >= {MIN_EPOCH}D AND {seconds} < {MAX_EPOCH}D THEN timestamp_micros(
        CAST(floor({seconds}) AS BIGINT) * 1000000
        + CAST(rint(({seconds} - floor({seconds})) * 1000000) AS BIGINT)) END"""


def iso_instant(text: str) -> str:
    """ISO date or date-time; a time without an offset is taken as UTC."""

    def joined(clock: str) -> str:
        offset = f"substring({text}, 12 + length({clock}), 20)"
        return f"""try_cast(concat(substring({text}, 1, 10), 'T', translate({clock}, ',', '.'),
            substring('00:00:00', length({clock}) + 1, 8),
            CASE WHEN {offset} = '' THEN 'Z' ELSE {offset} END) AS TIMESTAMP)"""

    clock = f"regexp_extract(substring({text}, 12, 60), r'^{ISO_CLOCK}', 0)"
    return f"CASE WHEN {text} RLIKE r'{ISO_TIME}' THEN {let(clock, joined)} END"


def text_instant(text: str) -> str:
    number = f"try_cast(trim({text}) AS DOUBLE)"
    decimal = f"CASE WHEN trim({text}) RLIKE r'{DECIMAL_TEXT}' THEN {epoch_instant(number)} END"
    return f"coalesce({iso_instant(text)}, {decimal})"


def instant_of(entry: str) -> str:
    """Instant held by one JSON value. Booleans count as 0 and 1 here."""
    return f"""CASE WHEN {entry}.num IS NOT NULL THEN {epoch_instant(f"{entry}.num")}
        WHEN {entry}.kind = '{STRING}' THEN {let(as_text(entry), text_instant)}
        WHEN {entry}.kind = '{BOOLEAN}' THEN {epoch_instant(f"CAST({as_flag(entry)} AS DOUBLE)")} END"""


def object_instant(entries: str) -> str:
    """First usable time key of one object."""
    found = each(
        only(entries, lambda e: f"{e}.key IN ({words(TIME_KEYS)})"),
        lambda e: f"struct(array_position(array({words(TIME_KEYS)}), {e}.key) AS place, {instant_of(e)} AS ts)",
    )
    return f"array_min({only(found, lambda f: f'{f}.ts IS NOT NULL')}).ts"


def line_instant(entries: str) -> str:
    """Time of a line: its own, else that of its first nested object with a ``ts`` key."""
    inner = each(only(entries, lambda e: f"{e}.kind = '{OBJECT}'"), as_object)
    stamped = only(inner, lambda m: f"map_contains_key({m}, 'ts')")
    return f"coalesce({object_instant(entries)}, {first_of(each(stamped, lambda m: object_instant(probed(m))))})"


def speaks_of_use(entry: str) -> str:
    return " OR ".join(f"contains(lower({entry}.key), '{w}')" for w in UTIL_WORDS)


def entry_utilization(entries: str, text: str) -> str:
    """Value of the first key that speaks of utilization: a number, or an object holding one.

    ``text`` is the text of the entry. It is only evaluated to tell which of several numbers in a
    nested object comes first.
    """

    def first_number(e: str) -> str:
        numbers = only(f"{probed(as_object(e))}.num", lambda x: f"{x} IS NOT NULL")
        in_order = first_of(entries_of(f"element_at({nested_texts(text)}, {e}.key)") + ".num")
        return let(numbers, lambda ns: f"CASE WHEN size({ns}) < 2 THEN get({ns}, 0) ELSE {in_order} END")

    return first_of(
        each(
            only(entries, speaks_of_use),
            lambda e: f"coalesce({e}.num, CASE WHEN {e}.kind = '{OBJECT}' THEN {first_number(e)} END)",
        )
    )


def is_given(entry: str) -> str:
    """Present and not JSON null."""
    return f"coalesce({entry}.kind <> '{NULL}', false)"


def is_truthy(entry: str) -> str:
    return f"""({is_given(entry)} AND CASE WHEN {entry}.num IS NOT NULL THEN {entry}.num <> 0
        WHEN {entry}.kind = '{BOOLEAN}' THEN {as_flag(entry)}
        WHEN {entry}.kind = '{STRING}' THEN {as_text(entry)} <> ''
        ELSE to_json({entry}.value) NOT IN ('{{}}', '[]') END)"""


def index_entry(entries: str) -> str:
    """The entry that names the device: ``index``, else a truthy ``gpu``, else ``id``."""
    named = ", ".join(f"{entry_at(entries, k)} AS {k}" for k in ("index", "gpu", "id"))
    return let(
        f"struct({named})",
        lambda n: f"""CASE WHEN {is_given(f"{n}.index")} THEN {n}.index
            WHEN {is_truthy(f"{n}.gpu")} THEN {n}.gpu WHEN {is_given(f"{n}.id")} THEN {n}.id END""",
    )


def index_number(entry: str) -> str:
    """Integer of an index, truncated; NULL if it is no integer."""
    text = f"trim({as_text(entry)})"
    return f"""CASE WHEN {entry}.num IS NOT NULL THEN try_cast({entry}.num AS BIGINT)
        WHEN {entry}.kind = '{BOOLEAN}' THEN CAST({as_flag(entry)} AS BIGINT)
        WHEN {entry}.kind = '{STRING}' AND {text} RLIKE r'^[+-]?\\d+$' THEN try_cast({text} AS BIGINT) END"""


def named_reading_index(key: str) -> str:
    """Device number in keys such as ``gpu0_util`` or ``GPU-4-utilization``; '' if it is another key."""
    return f"regexp_extract(lower({key}), r'{NAMED_READING}', 1)"
