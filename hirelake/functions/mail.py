"""Mailbox columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import WHITESPACE, col, filled, strip

# Fixed value: accepted mailbox form.
MAILBOX = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"


def mailbox_ok(c: Column | str) -> Column:
    return filled(c) & F.coalesce(strip(c).rlike(MAILBOX), F.lit(False))


def mail_domain(c: Column | str) -> Column:
    """Lower-case part behind the last ``@`` of the trimmed mailbox."""
    return F.lower(strip(F.substring_index(strip(c), "@", -1)))


def company_domain(domain: Column | str, name: Column | str) -> Column:
    """The stored domain, else one guessed from the company name."""
    guess = F.concat(F.replace(F.lower(col(name)), F.lit(" "), F.lit("")), F.lit(".com"))
    return F.coalesce(F.nullif(col(domain), F.lit("")), guess)


def _guess_columns(full_name: Column | str, domain: Column | str) -> list[Column]:
    """The guesses as single columns, most likely first; null where one does not apply.

    Plain string expressions instead of arrays, so they compile and a caller that wants only the
    first acceptable one stops there.
    """
    at = F.when(filled(domain), F.concat(F.lit("@"), F.lower(strip(domain))))
    name = F.lower(strip(full_name))
    first = F.nullif(F.regexp_extract(name, f"^([^{WHITESPACE}]+)", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(name, f"[{WHITESPACE}]([^{WHITESPACE}]+)$", 1), F.lit(""))
    return [
        F.concat(first, F.lit("."), last, at), F.concat(first, at),
        F.concat(F.substring(first, 1, 1), F.lit("."), last, at), F.concat(first, last, at),
        F.concat(last, F.lit("."), first, at), F.concat(F.lit("careers"), at)]


def mailbox_guesses(full_name: Column | str, domain: Column | str) -> Column:
    """Likely mailboxes of a person at a domain, most likely first, without repeats.

    No domain gives an empty list; a blank name only the shared careers mailbox.
    """
    return F.array_distinct(F.array_compact(F.array(*_guess_columns(full_name, domain))))


def first_sound_mailbox(full_name: Column | str, domain: Column | str) -> Column:
    """First guess of the right form; null when there is none."""
    return F.coalesce(*[F.when(g.rlike(MAILBOX), g) for g in _guess_columns(full_name, domain)])


def name_from_mailbox(c: Column | str) -> Column:
    """Display name from the local part: a letter behind a non-letter becomes upper case."""
    local = F.lower(F.substring_index(col(c), "@", 1))
    # Marking each word start lets initcap, which only knows spaces, do the rest.
    marked = F.regexp_replace(local, r"(\P{L})(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
