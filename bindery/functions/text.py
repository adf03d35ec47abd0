"""Whitespace, token, encoding and rendering rules as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The token pattern, the accepted extensions, the UUID forms and
# the display formats.
TOKEN_PATTERN = r"^[A-Za-z0-9_\-\.]+$"
SQL_EXTENSIONS = (".sql",)
CONFIG_EXTENSION = ".json"
TEMPLATE_EXTENSIONS = (".txt", ".html", ".jinja", ".j2", ".tmpl", ".xml", ".csv")
UUID_HEX_PATTERN = r"\A[0-9A-Fa-f]{32}\z"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Unicode white space plus the four separators U+001C to U+001F.
_SPACE = r"[\s\x1C-\x1F]"


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)\A{_SPACE}*\z")


def is_token(text: Column) -> Column:
    """Does the text, white space around it aside, match the token pattern?"""
    inner = TOKEN_PATTERN.strip("^$")
    return text.rlike(rf"(?U)\A{_SPACE}*{inner}{_SPACE}*\z")


def is_uuid(text: Column) -> Column:
    """True for 32 hex digits, with hyphens, braces or a URN prefix allowed."""
    bare = F.regexp_replace(text, "urn:|uuid:", "")
    bare = F.regexp_replace(bare, r"\A[{}]+|[{}]+\z", "")
    return F.regexp_replace(bare, "-", "").rlike(UUID_HEX_PATTERN)


def decode_base64(text: Column) -> Column:
    """Base64 to binary; null if it cannot be decoded.

    Characters outside the alphabet are ignored, and so is whatever follows the
    padding, as lenient decoders do. What is left must be whole groups of four.
    """
    clean = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    body = F.regexp_extract(clean, "^([A-Za-z0-9+/]*={0,2})", 1)
    whole = F.length(body) % 4 == 0
    return F.when(whole, F.try_to_binary(body, F.lit("base64")))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a UTC wall-clock timestamp, microseconds and offset kept."""
    return F.concat(F.date_format(ts, ISO_FORMAT), F.lit("+00:00"))


def utc_now() -> Column:
    """Wall clock in UTC, whatever the time zone of the session."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
