"""Text functions: base32 names, escapes for listings, pages and links. Column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3548 alphabet and the digits of base 32 that Spark's conv() writes.
_DIGITS, _ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_hex(hex_text: Column, digits: int = 40) -> Column:
    """Base 32 without padding of a hexadecimal string of 5 * k * 2 digits (k groups of 40 bits as two of 20)."""
    groups = [F.lpad(F.conv(F.substring(hex_text, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(digits // 5)]
    return F.translate(F.concat(*groups), _DIGITS, _ALPHABET)


def sha1_base32(content: Column) -> Column:
    return base32_hex(F.sha1(content))


def sha1_urn(content: Column) -> Column:
    return F.concat(F.lit("urn:sha1:"), sha1_base32(content))


def unbase32(text: Column) -> Column:
    """Bytes of an unpadded base-32 string of 8 * k letters; other characters are skipped."""
    clean = F.regexp_replace(F.upper(text), "[^A-Z2-7]", "")
    digits = F.translate(clean, _ALPHABET, _DIGITS)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(digits).cast("int") - 1), F.lit(4)), lambda i: _hex5(F.substring(digits, i + 1, F.lit(4))))
    return F.when(F.length(digits) == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(groups, "")))


def _hex5(four: Column) -> Column:
    return F.lpad(F.conv(four, 32, 16), 5, "0")


def escape(text: Column) -> Column:
    """Backslash escapes of line breaks, tabs, quotes and backslashes."""
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("'", "\\'"), ('"', '\\"')):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``. An unknown escape stands for its character; a lone last backslash stays."""

    def plain(part: Column) -> Column:  # without escaped backslashes, which the parts stood between
        for raw, written in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            part = F.replace(part, F.lit(written), F.lit(raw))
        return F.regexp_replace(part, r"(?s)\\(.)", "$1")

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def html_escape(text: Column) -> Column:
    for raw, written in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


#: Characters that stay as they are in a path segment besides letters and digits.
SEGMENT_SAFE = "-._~:!$'()*,"


def uri_segment(text: Column) -> Column:
    """Percent-encoded UTF-8 for one segment of a path."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in SEGMENT_SAFE:
        if c not in "-._*":  # url_encode leaves these
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def page_link(urn: Column, name: Column) -> Column:
    """Relative link to a blob under a name for people; slashes in it become dashes."""
    return F.concat(F.lit("../"), uri_segment(urn), F.lit("/"), uri_segment(F.replace(F.coalesce(name, urn), F.lit("/"), F.lit("-"))))


def urn_sha1(urn: Column) -> Column:
    """The SHA-1 part of a urn:sha1 or urn:bitprint name, null for any other text."""
    found = F.regexp_extract(urn, r"^urn:(?:sha1:([A-Z2-7]{32})|bitprint:([A-Z2-7]{32})\.[A-Z2-7]{39})$", 1)
    other = F.regexp_extract(urn, r"^urn:bitprint:([A-Z2-7]{32})\.[A-Z2-7]{39}$", 1)
    both = F.when(found != "", found).otherwise(other)
    return F.when(both != "", both)


def sector_path(sha1_b32: Column) -> Column:
    return F.concat(F.substring(sha1_b32, 1, 2), F.lit("/"), sha1_b32)


def source_kind(uri: Column) -> Column:
    """Whether a source names a directory listing or a compound image."""
    is_dir = F.lit(False)
    for prefix in ("rdf-subject:", "x-rdf-subject:", "x-parse-rdf:"):
        is_dir = is_dir | uri.startswith(prefix)
    return F.when(is_dir, "directory").otherwise("compound-image")


def raw_path_urn(path: Column) -> Column:
    """The name in a path of the form /raw/<urn>/<any name>, null for others."""
    found = F.regexp_extract(path, "^/raw/([^/]+)/", 1)
    return F.when(found != "", found)
