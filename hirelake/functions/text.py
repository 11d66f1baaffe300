"""Text columns. Everything here stays a JVM expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def or_text(c: Column | str, default: str) -> Column:
    """``default`` for both null and the empty text."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(default))


def filled(c: Column | str) -> Column:
    """True for a text that is neither null nor empty; never null."""
    return F.coalesce(col(c) != "", F.lit(False))


def contains_any(c: Column | str, terms: Sequence[str]) -> Column:
    """Case-insensitive *contains one of*; false for no terms and for null text.

    Terms travel inside the plan as literals, so the test needs no join at any rule count.
    """
    lowered = F.lower(col(c))
    terms = [t.lower() for t in dict.fromkeys(terms)]
    if not terms:
        return F.lit(False)
    return F.coalesce(lowered.rlike("|".join(map(quoted, terms))), F.lit(False))


def quoted(term: str) -> str:
    """A pattern of just this text."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def slug(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("_"))


def insert_after_first(text: Column, needle: str, addition: Column) -> Column:
    """``text`` with ``addition`` placed behind the first ``needle`` (which must occur)."""
    cut = F.instr(text, needle) + F.lit(len(needle) - 1)
    return F.concat(F.substring(text, F.lit(1), cut), addition,
                    F.substring(text, cut + 1, F.length(text)))


def percent_decode(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and keeps text that does not decode."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


# One white-space character, and those of them that end a line.
_SPACE = r"[ \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]"
_LINE_END = r"[\n\r\f\x0b\x1c\x1d\x1e\x85\u2028\u2029]"


def clean_lines(c: Column) -> Column:
    """Trim every line, split it at double spaces, drop blanks, rejoin with newlines.

    A white-space run holding a line break or two adjacent spaces is a boundary; any other run is
    kept as it is. One replacement therefore does the whole job without building arrays. The
    pattern tries the usual cases on the first character, as most runs are single spaces.
    """
    boundary = (f"{_SPACE}(?:(?<={_LINE_END})|(?<= ) |{_SPACE}*(?:{_LINE_END}|  )){_SPACE}*")
    return strip(F.regexp_replace(c, boundary, "\n"))
