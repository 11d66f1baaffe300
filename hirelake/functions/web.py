"""Address and HTML columns."""

from __future__ import annotations

from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import clean_lines, col, percent_decode, strip

# Named references from Python's table of HTML5 names: those that end with a semicolon, and the few old
# ones that may stand without it, longest first, so that a pattern finds the longest.
NAMED = {name: text for name, text in html5.items() if name.endswith(";")}
OLD = {name: html5[name] for name in sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)}
# Where these are the only references, replacing them one after the other is right; ``amp`` has to be the last.
USUAL = ("lt;", "gt;", "quot;", "nbsp;", "amp;")
UNUSUAL = r"&(?!(?:lt|gt|quot|nbsp|amp);)[#a-zA-Z]"
REPLACEMENT = "\ufffd"
# Numeric references to these codes mean the Windows-1252 character, where there is one.
WINDOWS = {c: t for c in range(0x80, 0xA0) if (t := bytes([c]).decode("cp1252", "ignore"))}

# Scripts, styles and comments hide markup from the parser, so they go in one left-to-right pass.
OPAQUE = r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>)"
# Elements left out with all they hold, cut at their tags.
CHROME = ("header", "footer", "nav")
CHROME_TAG = r"(?i)(?=</?(?:header|footer|nav)\b)"
MARKUP = r"<(?:![^>]*|/?[a-zA-Z][^>]*)>"


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """The text with every character reference decoded once; references nobody knows stay as written.

    A name needs its semicolon unless it is an old one; of those the longest that fits counts
    (``&notit;`` is a negation sign and ``it;``). In an attribute's value an old name without semicolon counts
    only if neither ``=`` nor a letter or digit follows, so that ``?a=1&copy=2`` stays an address.
    """
    usual = c
    for name in USUAL:
        usual = F.replace(usual, F.lit(f"&{name}"), F.lit(NAMED[name]))
    return F.when(~c.contains("&"), c).when(~c.rlike(UNUSUAL), usual).otherwise(_decoded(c, attribute))


def _decoded(c: Column, attribute: bool) -> Column:
    """Any references decoded in one pass. Each name of a text is looked up once in the table of all names."""
    names = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&([a-zA-Z][a-zA-Z0-9]*;)"), 1))
    # One element, so that pieces, names and their texts are worked out once and not once per piece.
    bound = F.array(F.struct(F.split(c, "&", -1).alias("pieces"), names.alias("names")))
    known = F.transform(bound, lambda b: F.struct(
        b["pieces"].alias("pieces"), b["names"].alias("names"),
        F.transform(b["names"], lambda n: F.try_element_at(_table(NAMED), n)).alias("texts")))
    joined = F.transform(known, lambda b: F.array_join(F.transform(
        b["pieces"], lambda x, i: F.when(i == 0, x).otherwise(_reference(x, b["names"], b["texts"], attribute))), ""))
    return F.get(joined, F.lit(0))


def _reference(piece: Column, names: Column, texts: Column, attribute: bool) -> Column:
    """``lt;rest``, ``ltrest``, ``#65;rest`` or ``#x41;rest`` decoded."""
    full = F.regexp_extract(piece, "^[a-zA-Z][a-zA-Z0-9]*;", 0)
    by_name = F.get(texts, (F.array_position(names, full) - 1).cast("int"))
    old = F.regexp_extract(piece, f"^(?:{'|'.join(OLD)}){'(?![=a-zA-Z0-9])' * attribute}", 0)
    by_old = F.try_element_at(_table(OLD), old)
    number = F.regexp_extract(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+)", 0)
    behind = F.regexp_replace(_from(piece, F.length(number) + 1), "^;", "")
    return F.when(by_name.isNotNull(), F.concat(by_name, _from(piece, F.length(full) + 1))) \
        .when(by_old.isNotNull(), F.concat(by_old, _from(piece, F.length(old) + 1))) \
        .when(number != "", F.concat(_numeric(number), behind)) \
        .otherwise(F.concat(F.lit("&"), piece))


def _table(pairs: Mapping) -> Column:
    """A constant map, cut from one literal: thousands of single ones would take seconds to plan."""
    text = "\x02".join(f"{name}\x01{value}" for name, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def _from(c: Column, position: Column) -> Column:
    return F.substring(c, position, F.length(c))


def _numeric(token: Column) -> Column:
    hexed = F.lower(token).startswith("#x")
    digits = F.ltrim(F.substring(token, F.when(hexed, 3).otherwise(2), F.length(token)), F.lit("0"))
    short = F.length(digits) <= 7
    code = F.when(short, F.when(hexed, F.conv(F.nullif(digits, F.lit("")), 16, 10)).otherwise(F.nullif(digits, F.lit("")))) \
        .cast("bigint")
    usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.try_element_at(_table(WINDOWS), code.cast("string"))
    char = F.coalesce(F.when(code.between(0x80, 0x9F), windows), char)
    return F.when(F.coalesce(usable, F.lit(False)), char).otherwise(REPLACEMENT)


def without_chrome(c: Column) -> Column:
    """The markup outside header, footer and nav elements, nested ones included.

    The page is cut at their tags only. Names of open elements are kept on a stack; an end tag closes
    the last element of its name and what is open inside it, one without a start is ignored. An element
    without an end reaches to the end of its page.
    """
    none = F.array().cast("array<string>")
    known = r"(?i)^</?(?:header|footer|nav)\b"

    def step(acc: Column, piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z]+)", 1))
        tag = name.isin(*CHROME) & F.rlike(piece, F.lit(known))
        opens = tag & ~piece.startswith("</") & ~F.rlike(piece, F.lit(r"(?s)^<[^>]*/>"))
        back = F.array_position(F.reverse(acc["open"]), name)
        left = F.when(tag & piece.startswith("</") & (back > 0),
                      F.slice(acc["open"], F.lit(1), (F.size(acc["open"]) - back).cast("int"))) \
            .when(opens, F.concat(acc["open"], F.array(name))).otherwise(acc["open"])
        return F.struct(left.alias("open"), F.when(F.size(left) == 0, F.concat(acc["kept"], F.array(piece)))
                        .otherwise(acc["kept"]).alias("kept"))

    start = F.struct(none.alias("open"), none.alias("kept"))
    kept = F.aggregate(F.split(c, CHROME_TAG, -1), start, step, lambda acc: F.array_join(acc["kept"], "\n"))
    return F.when(c.rlike(CHROME_TAG), kept).otherwise(c)


def with_html_text(df: DataFrame, html: str, out: str) -> DataFrame:
    """Add the visible text of a page: no scripts, styles, comments, header, footer or nav; one text
    node per line; entities decoded.

    Built in steps: each step reads its input more than once, and a column of its own makes Spark
    evaluate that input only once per row.
    """
    df = df.withColumn(out, F.regexp_replace(col(html), OPAQUE, "\n"))
    for step in (without_chrome, lambda c: F.regexp_replace(c, MARKUP, "\n"), decode_entities):
        df = df.withColumn(out, step(F.col(out)))
    return df.withColumn(out, F.coalesce(clean_lines(F.col(out)), F.lit("")))


def node_text(fragment: Column) -> Column:
    """Text of an inline fragment: tags removed without a break, entities decoded, trimmed."""
    return strip(decode_entities(F.regexp_replace(fragment, MARKUP, "")))


def url_domain(url: Column | str) -> Column:
    """Network location of an address: lower case, no leading ``www.``, port and user info kept.

    Addresses without one, or with unbalanced brackets, give the empty text.
    """
    host = F.lower(F.regexp_extract(
        col(url), r"^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    broken = host.contains("[") != host.contains("]")
    return F.coalesce(F.when(broken, F.lit("")).otherwise(F.regexp_replace(host, r"^www\.", "")),
                      F.lit(""))


def bare_domain(domain: Column | str) -> Column:
    """A domain as typed by people: trimmed, lower case, scheme and path removed if a scheme is there."""
    c = F.lower(strip(domain))
    after = F.substring_index(F.substring_index(c, "//", -1), "/", 1)
    return F.when(c.startswith("http://") | c.startswith("https://"), after).otherwise(c)


def redirect_target(href: Column | str) -> Column:
    """Result link to its target: the ``uddg`` parameter if present; ``//host`` gets a scheme."""
    c = strip(href)
    parameter = F.split_part(F.split_part(c, F.lit("uddg="), F.lit(2)), F.lit("&"), F.lit(1))
    c = F.when(c.contains("uddg="), strip(percent_decode(parameter))).otherwise(c)
    return F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)


def ru_target(href: Column | str) -> Column:
    """Target of the path form of redirect (``/RU=<encoded>/``); null when the link has none."""
    return percent_decode(F.nullif(F.regexp_extract(col(href), r"/RU=([^/]+)", 1), F.lit("")))


# An attribute's value: in double or single quotes, or bare.
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r"""(?s)^(["'])(.*)\1$""", "$2")


def with_class(name: str) -> str:
    """Pattern of what follows a tag's name if its class list holds ``name``."""
    return rf"""(?=[^>]*\sclass\s*=\s*(?:"[^"]*(?<![\w-]){name}(?![\w-])|'[^']*(?<![\w-]){name}(?![\w-])|{name}(?![\w-])))"""


def anchors(html: Column | str) -> Column:
    """All anchors as ``array<struct<href, title>>``, in page order."""
    pattern = rf"(?is)<a\b[^>]*?\shref\s*=\s*{VALUE}[^>]*>(.*?)</a\s*>"
    hrefs = F.regexp_extract_all(col(html), F.lit(pattern), 1)
    labels = F.regexp_extract_all(col(html), F.lit(pattern), 2)
    return F.transform(
        F.arrays_zip(hrefs.alias("h"), labels.alias("l")),
        lambda a: F.struct(decode_entities(unquoted(a["h"]), attribute=True).alias("href"), node_text(a["l"]).alias("title")),
    )


def result_entries(html: Column | str) -> Column:
    """Entries of a result page as ``array<struct<title, href, snippet>>``.

    The page is cut at its result blocks; an entry needs both a link and a snippet anchor.
    """
    cut = F.split(col(html), rf"(?is)<div\b{with_class('result__body')}[^>]*>")
    blocks = F.slice(cut, F.lit(2), F.size(cut))
    link = rf"(?is)<a\b{with_class('result__url')}[^>]*?\shref\s*=\s*{VALUE}[^>]*>(.*?)</a\s*>"
    snippet = rf"(?is)<a\b{with_class('result__snippet')}[^>]*>(.*?)</a\s*>"
    entries = F.transform(blocks, lambda b: F.struct(
        node_text(F.regexp_extract(b, link, 2)).alias("title"),
        strip(decode_entities(unquoted(F.regexp_extract(b, link, 1)), attribute=True)).alias("href"),
        node_text(F.regexp_extract(b, snippet, 1)).alias("snippet"),
        (F.rlike(b, F.lit(link)) & F.rlike(b, F.lit(snippet))).alias("complete")))
    return F.transform(F.filter(entries, lambda e: e["complete"]),
                       lambda e: F.struct(e["title"], e["href"], e["snippet"]))


def path_entries(html: Column | str) -> Column:
    """Entries of the second engine's page as ``array<struct<title, target, snippet>>``, in page order.

    The page is cut at its anchors; one whose link names a target in its path is an entry. Its title is the heading's
    text if it stands in one, else its own; the snippet is the text of the element that follows its block.
    """
    pieces = F.split(col(html), r"(?i)(?=<a\b)")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    anchor = rf"(?is)^<a\b[^>]*?\shref\s*=\s*{VALUE}[^>]*>(.*?)</a\s*>"
    entries = F.transform(pieces, lambda p: F.struct(
        node_text(F.regexp_extract(p, r"(?is)^(.*?)</(?:h3|div)\s*>", 1)).alias("heading"),
        node_text(F.regexp_extract(p, anchor, 2)).alias("label"),
        ru_target(strip(decode_entities(unquoted(F.regexp_extract(p, anchor, 1)), attribute=True))).alias("target"),
        F.rlike(p, F.lit(r"(?is)^.*?</h3\s*>")).alias("headed"),
        node_text(F.regexp_extract(p, r"(?is)</div\s*>\s*<(\w+)\b[^>]*>(.*?)</\1\s*>", 2)).alias("snippet")))
    return F.transform(F.filter(entries, lambda e: e["target"].isNotNull()), lambda e: F.struct(
        F.coalesce(F.nullif(F.when(e["headed"], e["heading"]).otherwise(e["label"]), F.lit("")), e["target"]).alias("title"),
        e["target"].alias("target"), e["snippet"].alias("snippet")))
