"""Page text, result links, ranked hits and evidence chunks."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.text import clean_lines, contains_any
from hirelake.functions.web import (
    anchors,
    path_entries,
    redirect_target,
    result_entries,
    ru_target,
    url_domain,
    with_html_text,
)
from hirelake.operators.keys import lookup

# Tasks get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Hits per query that evidence is gathered from, at most.
EVIDENCE_HITS = 100


def page_text(pages: DataFrame) -> DataFrame:
    """Visible text per page, as JVM expressions only."""
    return with_html_text(pages, "html", "text")


class _VisibleText(HTMLParser):
    """Collects text nodes outside the dropped elements (nesting-aware, references decoded by the parser)."""

    DROPPED = ("script", "style", "header", "footer", "nav")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = [""]
        self.open: list[str] = []

    def _text(self, data: str) -> None:
        if not self.open:
            self.nodes[-1] += data

    def handle_starttag(self, tag, attrs):
        self.nodes.append("")
        if tag in self.DROPPED:
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.nodes.append("")
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.nodes.append("")

    def handle_data(self, data):
        self._text(data)


def _node_lines(html: str | None) -> str:
    parser = _VisibleText()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.nodes)


def page_text_parsed(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """As :func:`page_text`, with text nodes from a real parser for unusual markup.

    A narrow Arrow-batched map: each task parses its own partition's pages. Lines are cleaned as columns.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "nodes": batch["html"].map(_node_lines)})

    kind = pages.schema[key].dataType.simpleString()
    nodes = pages.select(key, "html").mapInPandas(parse, f"{key} {kind}, nodes STRING")
    return nodes.select(key, F.coalesce(clean_lines(F.col("nodes")), F.lit("")).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """All anchors of all pages: ``(page_id, pos, href, title)``."""
    return pages.select("page_id", F.posexplode(anchors("html")).alias("pos", "link")) \
        .select("page_id", "pos", "link.href", "link.title")


def result_hits(result_pages: DataFrame) -> DataFrame:
    """Entries of result pages with cleaned targets: ``(query_id, pos, title, url, snippet)``."""
    rows = result_pages.select("query_id", F.posexplode(result_entries("html")).alias("pos", "e"))
    return rows.select("query_id", "pos", "e.title", redirect_target("e.href").alias("url"), "e.snippet")


def clean_hits(hits: DataFrame) -> DataFrame:
    """Hits with the redirect removed."""
    return hits.withColumn("target", redirect_target("href"))


def clean_ru_hits(hits: DataFrame, own_hosts: list[str]) -> DataFrame:
    """Targets of path redirects, without the engine's own pages, first occurrence per query."""
    targets = hits.withColumn("target", ru_target("href")).where(F.col("target").isNotNull())
    outside = targets.where(~contains_any("target", own_hosts))
    return outside.groupBy("query_id", "target").agg(F.min("pos").alias("pos"))


def top_hits(hits: DataFrame, denied: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` hits per query in page order, after the domain filter.

    The rank bound is applied per task before the shuffle, so a query with very many hits is cheap.
    """
    cleaned = clean_hits(hits).withColumn("domain", url_domain("target"))
    allowed = lookup(cleaned, denied.select("domain").distinct(), ["domain"], ["domain"], how="left_anti")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("pos"))
    return allowed.withColumn("rank", rank).where(F.col("rank") <= limit)


def with_placeholder_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits, plus one stand-in result for each query ``(query_id, query)`` that found nothing."""
    empty = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    stand_in = empty.select(
        "query_id", F.lit(0).alias("pos"), F.concat(F.lit("Search result for "), "query").alias("title"),
        F.concat(F.lit("https://example.com/search?q="), F.url_encode("query")).alias("url"),
        F.concat(F.lit("Stand-in result for: "), "query").alias("snippet"))
    return hits.select("query_id", "pos", "title", "url", "snippet").unionByName(stand_in)


def _first_hits(hits: DataFrame, denied: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` hits per query outside the denied domains, numbered from 0."""
    located = hits.withColumn("_domain", url_domain("url"))
    allowed = lookup(located, denied.select("domain").distinct(), ["_domain"], ["domain"], how="left_anti").drop("_domain")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("pos"))
    return allowed.withColumn("_rank", rank).where(F.col("_rank") <= limit).withColumn("pos", (F.col("_rank") - 1).cast("int")).drop("_rank")


def path_hits(result_pages: DataFrame, own_hosts: list[str]) -> DataFrame:
    """Entries of the second engine's pages, first occurrence of a target per query, without the engine's own:
    ``(query_id, pos, title, url, snippet)``."""
    rows = result_pages.select("query_id", F.posexplode(path_entries("html")).alias("pos", "e"))
    outside = rows.where(~contains_any("e.target", own_hosts))
    first = outside.groupBy("query_id", F.col("e.target").alias("url")).agg(F.min_by(F.struct("pos", "e.title", "e.snippet"), "pos").alias("f"))
    return first.select("query_id", "f.pos", "f.title", "url", "f.snippet")


def search_results(queries: DataFrame, first_pages: DataFrame, second_pages: DataFrame, denied: DataFrame,
                   own_hosts: list[str], limit: int) -> DataFrame:
    """Up to ``limit`` results per query ``(query_id, query)``: ``(query_id, pos, title, url, snippet)``.

    The second engine's pages are read only for queries to which the first gave nothing that is allowed; a query
    with nothing from either gets one stand-in.
    """
    found = _first_hits(result_hits(first_pages), denied, limit).select("query_id", "pos", "title", "url", "snippet")
    answered = found.select("query_id").distinct()
    asked_again = second_pages.join(answered, "query_id", "left_anti")
    more = _first_hits(path_hits(asked_again, own_hosts), denied, limit).select("query_id", "pos", "title", "url", "snippet")
    return with_placeholder_hits(queries, found.unionByName(more))


def evidence(hits: DataFrame, pages: DataFrame, chars: int, limit: int = EVIDENCE_HITS) -> DataFrame:
    """One evidence text per query: a header and the opening of each hit's page, in hit order.

    Of ``hits(query_id, rank, url, title)`` those of rank ``limit`` or less count, so a query gathers
    at most that many chunks. Only pages that were hit are cleaned, each once and whole; of a page
    stored twice the smallest text counts. ``chars`` is the evidence size per hit, a report parameter.
    """
    near = hits.where(F.col("rank") <= limit)
    wanted = pages.join(near.select("url").distinct(), "url", "left_semi")
    texts = with_html_text(wanted, "html", "text").groupBy("url").agg(F.min("text").alias("text"))
    chunk = F.concat(F.lit("\n--- "), "title", F.lit(" ("), "url", F.lit(") ---\n"),
                     F.substring("text", 1, chars))
    joined = lookup(near, texts, ["url"], ["url"], how="inner").select("query_id", F.struct("rank", chunk.alias("chunk")).alias("c"))
    ordered = F.transform(F.sort_array(F.collect_list("c")), lambda c: c["chunk"])
    return joined.groupBy("query_id").agg(F.array_join(ordered, "").alias("evidence"),
                                          F.count("*").alias("hits"))


def union_hits(*hit_lists: DataFrame) -> DataFrame:
    """Result lists one after the other (a bag: repeats stay)."""
    out = hit_lists[0]
    for more in hit_lists[1:]:
        out = out.unionByName(more)
    return out
