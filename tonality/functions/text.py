"""Text cleaning as built-in column expressions (P1, P2, P13, split/join on whitespace).

Python's ``str.strip`` / ``str.split`` treat every Unicode white-space character as a separator,
while Spark's ``trim`` only removes spaces and Java's ``\\s`` is ASCII unless ``(?U)`` is set.
The class below lists the Python white-space set explicitly, so the Spark regex (Java) and the
DuckDB oracle (RE2) use one and the same definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters for which Python's str.isspace() is true.
WS_CHARS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_CLASS = f"[{WS_CHARS}]"
_EDGE_WS = f"^{WS_CLASS}+|{WS_CLASS}+$"
# The same set as literal characters: the ASCII part Java's (non-Unicode) \s covers, and the rest.
JAVA_ASCII_WS = "\t\n\x0b\x0c\r "
OTHER_WS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
WS_LITERAL = JAVA_ASCII_WS + OTHER_WS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Remove leading and trailing white space (all of Python's white-space characters)."""
    return F.btrim(_c(col), F.lit(WS_LITERAL))


def normalize_text(col) -> Column:
    """String cast, lower case, strip. Null becomes the empty string (see ``is_missing``)."""
    return F.coalesce(strip_ws(F.lower(_c(col).cast("string"))), F.lit(""))


def is_missing(col) -> Column:
    """Flag for a null input text, which ``normalize_text`` turns into ''."""
    return _c(col).isNull()


# The ASCII part of the set for a regex: Java's white space and the four separators it leaves out.
_ASCII_WS = r"\s\x1c-\x1f"


def _plain_ws(text: Column) -> Column:
    """All white space made ASCII; a text of ASCII alone (as many bytes as characters) is so already."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, OTHER_WS, " " * len(OTHER_WS)))


# The same one by one: a negated class of single characters and one range is matched about ten times faster than one with ``\s`` or more ranges.
_EACH_WS = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
_RUN_WS = rf" [{_EACH_WS}]+|[{_EACH_WS[1:]}][{_EACH_WS}]*"  # all but a single space


def clean_ascii(col) -> Column:
    """Lower case, keep only ``a-z`` and white space, collapse white-space runs to one space.

    The non-ASCII white-space characters are first mapped to a space with ``translate`` (a plain
    character map), so both regexes can use ASCII-only classes. Same result as the one-class form.
    """
    lowered = F.lower(F.coalesce(_c(col).cast("string"), F.lit("")))
    kept = F.regexp_replace(_plain_ws(lowered), f"[^a-z{_EACH_WS}]+", "")
    # after the collapse the only white space left is a single space
    return F.trim(F.regexp_replace(kept, _RUN_WS, " "))


def words(col, min_len: int = 1) -> Column:
    """Split a text on runs of white space (Python's set) into words of at least ``min_len`` chars.

    Stays compiled: under a filter with a lambda Spark interprets the text's expression, anew at each place that names it.
    """
    if min_len <= 1:
        parts = F.split(_plain_ws(_c(col)), f"[{_ASCII_WS}]+")
        return F.array_remove(parts, "") if min_len == 1 else parts
    return F.regexp_extract_all(_plain_ws(_c(col)), F.lit(f"([^{_EACH_WS}]{{{min_len},}})"), F.lit(1))


def run_stamp(at=None) -> Column:
    """The ``yyyyMMdd_HHmmss`` stamp used to name evaluation records (of now, or of a timestamp)."""
    return F.date_format(F.current_timestamp() if at is None else _c(at), "yyyyMMdd_HHmmss")


def has_suffix(col, suffixes) -> Column:
    """P10: whether a path ends with one of the suffixes, in any letter case."""
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(_c(col)), F.lit(s.lower()))
    return out
