"""Lines, names and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line screen.
MAX_LINE_UNITS = 120
PUNCTUATION_ONLY = r"[{}\[\]();,:]+"

# White space as a browser trims it: ASCII blanks, the Unicode separators and the byte order mark.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
BLANK = r"[\s\x{FEFF}\p{Z}]"


def trim_end(line: Column) -> Column:
    """Right trim of all Unicode blanks; plain ``rtrim`` strips spaces only."""
    return F.rtrim(line, F.lit(BLANKS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: an astral character counts twice."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def is_clean_line(line: Column) -> Column:
    """Line screen; ``line`` is already right-trimmed."""
    return (
        (line != "")
        & (utf16_length(line) <= MAX_LINE_UNITS)
        & ~line.rlike(rf"^{BLANK}*{PUNCTUATION_ONLY}\z")
    )


def clean_line_array(text: Column) -> Column:
    """All clean lines of one text, in order, without leaving the row."""
    return F.filter(F.transform(split_lines(text), trim_end), is_clean_line)


def comma_list(text: Column, lower: bool = False) -> Column:
    """Split on commas, trim, drop blanks."""
    items = F.filter(F.transform(F.split(text, ","), trim_both), lambda x: x != "")
    return F.transform(items, F.lower) if lower else items


def trim_both(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Case-blind substring test against a short parameter list; an empty list never matches."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    tests = [F.contains(lowered, F.lit(n.lower())) for n in needles if n]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def file_extension(path: Column) -> Column:
    """Lower-cased last extension, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def safe_file_name(repo: Column, path: Column) -> Column:
    """Flat file name for a (repository, path) pair."""
    safe_repo = F.regexp_replace(repo, r"[^A-Za-z0-9._-]+", "-")
    safe_path = F.regexp_replace(path, r"[^A-Za-z0-9._/-]+", "-")
    return F.concat(safe_repo, F.lit("__"), F.replace(safe_path, F.lit("/"), F.lit("__")))


def is_http_link(url: Column) -> Column:
    """External by prefix."""
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def url_scheme(url: Column) -> Column:
    """Lower-cased scheme, '' for a relative link."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_authority(url: Column) -> Column:
    """Lower-cased host and port without user data, '' if the link names none."""
    return F.lower(
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#@]*)", 1)
    )


def link_host(url: Column) -> Column:
    """Host of an absolute link, NULL for relative and mail links."""
    return F.nullif(F.regexp_replace(url_authority(url), r":\d*$", ""), F.lit(""))


def origin(scheme: Column, authority: Column) -> Column:
    """Scheme and authority, with the port left out where it is the usual one."""
    bare = F.regexp_replace(authority, r":$", "")
    usual = (
        F.when(scheme == "http", F.regexp_replace(bare, r":80$", ""))
        .when(scheme == "https", F.regexp_replace(bare, r":443$", ""))
        .otherwise(bare)
    )
    return F.concat(scheme, F.lit("://"), usual)


def is_foreign_origin(url: Column, page: Column) -> Column:
    """External by origin, seen from the page that carries the link; ``mailto:`` counts as external."""
    scheme, authority = url_scheme(url), url_authority(url)
    own_scheme, own_authority = url_scheme(page), url_authority(page)
    full_scheme = F.when(scheme == "", own_scheme).otherwise(scheme)
    relative = (scheme == "") & (authority == "")
    return ~relative & (origin(full_scheme, authority) != origin(own_scheme, own_authority))
