"""File payloads: decode, cut, count, screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File size cap and the text test.
MAX_BYTES_PER_FILE = 65536
TEXT_TEST_WINDOW = 4096
TEXT_TEST_THRESHOLD = 0.02


def decode_base64(content: Column) -> Column:
    """Tolerant base64: foreign characters are skipped, wrong padding gives NULL.

    Well-formed content, up to line breaks, is decoded as it is; only the rest is repaired first.
    """
    joined = F.translate(content, "\r\n", "")
    whole = joined.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(joined) % 4 == 0)
    return F.when(whole, F.try_to_binary(joined, F.lit("base64"))).otherwise(repaired_base64(content))


def repaired_base64(content: Column) -> Column:
    """``unbase64`` raises on a truncated last unit, so the padding is checked and rebuilt."""
    digits = F.regexp_replace(content, r"[^A-Za-z0-9+/]", "")
    rest = F.length(digits) % 4
    pads = F.length(content) - F.length(F.replace(content, F.lit("=")))
    padded = F.concat(digits, F.repeat(F.lit("="), (4 - rest) % 4))
    complete = (rest == 0) | ((rest == 2) & (pads >= 2)) | ((rest == 3) & (pads >= 1))
    return F.when(complete, F.try_to_binary(padded, F.lit("base64")))


def payload_bytes(encoding: Column, content: Column, download: Column | None = None) -> Column:
    """Bytes of one stored payload; whatever cannot be decoded is empty."""
    other = F.lit(None).cast("binary") if download is None else download
    inline = (encoding == "base64") & content.isNotNull()
    return F.coalesce(F.when(inline, decode_base64(content)).otherwise(other), F.lit(b""))


def cut_bytes(content: Column, max_bytes: int | None = None) -> Column:
    """First ``max_bytes`` bytes of a BINARY, possibly in the middle of a character; all of it without a cap."""
    return content if max_bytes is None else F.substring(content, 1, max_bytes)


def is_text(content: Column, window: int | None = None) -> Column:
    """No NUL anywhere, and under 2 % control bytes in the first ``window`` bytes, by default in all."""
    chars = F.decode(content, "ISO-8859-1")  # one character per byte
    start = chars if window is None else F.substring(chars, 1, window)
    control = F.regexp_count(start, F.lit(r"[\x00-\x08\x0E-\x1F]"))
    share = control / F.greatest(F.lit(1), F.length(start))
    return ~F.contains(chars, F.lit("\x00")) & (share < TEXT_TEST_THRESHOLD)


def text_of(content: Column) -> Column:
    """BINARY to text; broken bytes become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def utc_stamp(ts: Column) -> Column:
    """``2024-01-31T23:59:59Z``; the session zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
