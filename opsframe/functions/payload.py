"""Base64 payload columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.functions.text import blank_if_null, col

# Media types by file extension.
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "svg": "image/svg+xml", "ico": "image/x-icon", "pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv",
    "json": "application/json", "xml": "application/xml", "zip": "application/zip", "mp3": "audio/mpeg",
    "mp4": "video/mp4", "woff2": "font/woff2",
}
DEFAULT_MEDIA = "application/octet-stream"
DATA_URI = r"(?is)^data:([^;,]*)?;base64,(.*)$"  # fixed value


def b64_encode(c: Column | str, urlsafe: bool = False, nopad: bool = False, wrap: int | None = None) -> Column:
    """Base64 of a binary column, or of a text column's UTF-8 bytes."""
    out = F.translate(F.base64(col(c).cast("binary")), "\r\n", "")
    if urlsafe:
        out = F.translate(out, "+/", "-_")
    if nopad:
        out = F.regexp_replace(out, "=+$", "")
    if wrap:
        out = F.regexp_replace(out, "(.{%d})(?!$)" % wrap, "$1\n")
    return out


def b64_decode(c: Column | str) -> Column:
    """Bytes of a Base64 text in either alphabet, padding optional; NULL when it cannot be Base64."""
    t = F.translate(F.regexp_replace(blank_if_null(c), r"(?U)\s+", ""), "-_", "+/")
    body = F.regexp_replace(t, "=+$", "")
    usable = (F.length(t) % 4 != 1) & body.rlike("^[A-Za-z0-9+/]*$")
    # six spare bits make no byte
    whole = F.when(F.length(body) % 4 == 1, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("="))
    return F.when(usable, F.unbase64(padded))


def _utf16_length(s: Column) -> Column:
    return F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def is_likely_text(c: Column | str) -> Column:
    """Whether bytes read as text: valid UTF-8 with few control characters."""
    raw = col(c)
    s = F.regexp_replace(raw.cast("string"), "^﻿", "")
    size = _utf16_length(s)
    control = F.regexp_count(s, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    readable = (size > 0) & ~s.contains("�") & ((size - 2 * control) / size > 0.6)
    return F.when(F.octet_length(raw) == 0, True).when(~F.is_valid_utf8(raw.cast("string")), False).otherwise(readable)


def data_uri(media: Column | str, b64: Column | str) -> Column:
    m = blank_if_null(media)
    return F.concat(F.lit("data:"), F.when(m == "", DEFAULT_MEDIA).otherwise(m), F.lit(";base64,"), col(b64))


def parse_data_uri(c: Column | str) -> Column:
    """Struct ``mime, b64``; NULL for anything else."""
    s = blank_if_null(c)
    mime = F.regexp_extract(s, DATA_URI, 1)
    return F.when(
        s.rlike(DATA_URI),
        F.struct(F.when(mime == "", DEFAULT_MEDIA).otherwise(mime).alias("mime"),
                 F.regexp_extract(s, DATA_URI, 2).alias("b64")),
    )


def media_type(name: Column | str) -> Column:
    ext = F.element_at(F.split(F.lower(blank_if_null(name)), r"\."), -1)
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit(DEFAULT_MEDIA))
