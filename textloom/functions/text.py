"""Column functions on text, paths and URLs. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() and \s treat as space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts above this many characters are ingested one sample per paragraph.
LONG_TEXT_CHARS = 5000

_REPLACEMENT = "\ufffd"
_ESCAPE = "\ufdd0"


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends.

    Trimming the right end indexes every character of the text, so it is left to
    the texts that end in whitespace.
    """
    spaces = F.array(*[F.lit(c) for c in WHITESPACE])

    def ends(t: Column) -> Column:
        padded = F.exists(spaces, lambda space: F.endswith(t, space))
        return F.ltrim(F.when(padded, F.rtrim(t, F.lit(WHITESPACE))).otherwise(t), F.lit(WHITESPACE))

    return once(text, ends)


def collapse_whitespace(text: Column) -> Column:
    """Replace every run of Unicode whitespace by one space.

    Java's Unicode ``\\s`` with these four controls is the set above, and several
    times faster than a class that lists it.
    """
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def valid_text(text: Column) -> Column:
    """Drop the bytes that are not valid UTF-8 and keep all others.

    Spark replaces such bytes by U+FFFD, so a U+FFFD that the text really holds
    is escaped before and restored after.
    """
    escaped = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "a"))
    escaped = F.replace(escaped, F.lit(_REPLACEMENT), F.lit(_ESCAPE + "b"))
    kept = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    kept = F.replace(kept, F.lit(_ESCAPE + "b"), F.lit(_REPLACEMENT))
    kept = F.replace(kept, F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))
    return F.when(F.is_valid_utf8(text), text).otherwise(kept)


def pieces(text: Column, separator: str) -> Column:
    """Split on a literal separator, strip each piece, drop the blank ones."""
    parts = F.split(text, f"\\Q{separator}\\E")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def lines(text: Column) -> Column:
    return pieces(text, "\n")


def paragraphs(text: Column, separator: str = "\n\n", longer_than: int = LONG_TEXT_CHARS) -> Column:
    """Paragraphs of a long text, or the one stripped text when it is short."""
    return once(strip(text), lambda body: F.when(F.length(body) > longer_than, pieces(body, separator)).otherwise(F.array(body)))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes as lower-case hex."""
    return F.sha2(text, 256)


def content_key(text: Column) -> Column:
    """The same hash as 32 bytes: half the shuffle volume of the hex form."""
    return F.unhex(F.sha2(text, 256))


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_http_url(url: Column) -> Column:
    """Whether the scheme is http or https; any path and query will do. A lone bracket in the host makes no address."""
    host = F.regexp_extract(url, r"^[\x00-\x20]*[^:/?#]+://([^/?#]*)", 1)
    whole = F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))
    return F.coalesce(url.rlike(r"(?i)^[\x00-\x20]*https?:") & whole, F.lit(False))


def shorten(text: Column, limit: int, mark: str = "…") -> Column:
    """Cut a text that is longer than ``limit`` and put ``mark`` behind the cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)
