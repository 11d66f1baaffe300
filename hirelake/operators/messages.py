"""Message rendering and quality gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import col, insert_after_first, slug
from hirelake.rules import Rules

# Placeholder forms a finished message must not contain.
PLACEHOLDERS = {
    "bracket placeholder": r"(?i)\[(?:insert|your|candidate|my|company|contact|name|role|date)\b[^\]]*\]",
    "tag placeholder": r"(?i)<(?:company|name|role|contact|date)>",
    "brace placeholder": r"\{[a-z_]+\}",
    "date placeholder": r"\bYYYY\b",
}


def keywords_text(words: Column | str, default: str) -> Column:
    """Comma-separated keywords; the default for a missing or empty list."""
    listed = F.array_join(col(words), ", ")
    return F.when(F.size(col(words)) > 0, listed).otherwise(F.lit(default))


def speculative_key(name: Column | str) -> Column:
    return F.concat(F.lit("speculative://"), slug(name))


def pasted_key(name: Column | str, text: Column | str) -> Column:
    """Key of a pasted text: slug plus the first eight digits of its MD5 (over the whole text)."""
    return F.concat(F.lit("pasted://"), slug(name), F.lit("_"),
                    F.substring(F.md5(col(text)), 1, 8))


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` fields of a fixed template with columns.

    The template is cut at its fields on the driver, so values are concatenated, never rescanned:
    a value that itself looks like a field stays as it is.
    """
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), fields[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def or_fallback(parsed: DataFrame, fallback: Mapping[str, Column]) -> DataFrame:
    """Fields of the accepted responses, the fallback columns for rejected ones."""
    rest = [c for c in parsed.columns if c not in ("response", "accepted")]
    return parsed.select(*rest, "accepted", *[
        F.coalesce(F.col(f"response.{name}"), value).alias(name) for name, value in fallback.items()])


def signature(rules: Rules) -> str:
    """The sender's links as HTML, without their scheme in the visible part."""
    links = [u for u in (rules.linkedin_url, rules.github_url) if u]
    shown = [u.replace("https://", "").replace("http://", "") for u in links]
    return "<br>" + " | ".join(f'<a href="{u}">{s}</a>' for u, s in zip(links, shown, strict=True)) \
        if links else ""


def sign(body: Column | str, rules: Rules) -> Column:
    """Add the sender's links unless one is there: behind the first sender name, else at the end."""
    c = col(body)
    mark = signature(rules)
    if not mark:
        return c
    urls = [u for u in (rules.linkedin_url, rules.github_url) if u]
    linked = c.contains(urls[0])
    for u in urls[1:]:
        linked = linked | c.contains(u)
    signed = F.concat(c, F.lit(f"<p>{mark}</p>"))
    if rules.sender_name:
        signed = F.when(c.contains(rules.sender_name),
                        insert_after_first(c, rules.sender_name, F.lit(mark))).otherwise(signed)
    return F.when(linked, c).otherwise(signed)


def placeholder_errors(*texts: Column | str) -> Column:
    """Names of the placeholder forms found in any of the texts (array, empty when clean)."""
    found = []
    for name, pattern in PLACEHOLDERS.items():
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.coalesce(col(t).rlike(pattern), F.lit(False))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def check_messages(messages: DataFrame, *texts: str) -> DataFrame:
    """Add ``errors`` and ``is_valid`` over the given whole texts."""
    return messages.withColumn("errors", placeholder_errors(*texts)) \
        .withColumn("is_valid", F.size("errors") == 0)


def unsupported(added: Column | str, base: Column | str) -> Column:
    """Keywords that were added without being in the base list, case-blind, in order."""
    low = F.transform(col(added), lambda w: F.lower(w))
    return F.coalesce(F.array_except(low, F.transform(col(base), lambda w: F.lower(w))),
                      F.array().cast("array<string>"))
