"""Pages -> links, heading paths, attribute rows and definitions."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docattr.functions import html as h
from docattr.functions.text import ascii_fold


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    exploded = pages.select(key, F.posexplode(h.anchors(F.col(html))).alias("pos", "a"))
    return exploded.select(key, "pos", "a.href", "a.text")


def elements(pages: DataFrame, tags: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    exploded = pages.select(key, F.posexplode(h.blocks(F.col(html), tags)).alias("pos", "e"))
    return exploded.select(key, "pos", "e.kind", h.plain_text(F.col("e.inner")).alias("text"), "e.inner")


def heading_paths(stream: DataFrame, key: str, pos: str, level: str, text: str, slots: int = 6) -> DataFrame:
    """Path of carried-forward headings for every row without a level.

    Slots are never cleared; the path holds the filled slots up to the level of the last
    heading. One page bounds each window.
    """
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    carried = [
        F.last(F.when(F.col(level) == k, F.col(text)), ignorenulls=True).over(w) for k in range(1, slots + 1)
    ]
    depth = F.last(F.col(level), ignorenulls=True).over(w)
    out = stream.withColumns({"_slots": F.array(*carried), "_depth": F.coalesce(depth, F.lit(0))})
    path = F.filter(F.slice("_slots", F.lit(1), F.col("_depth")), lambda x: x.isNotNull())
    return out.filter(F.col(level).isNull()).withColumn("path", path).drop("_slots", "_depth")


def carry_forward(df: DataFrame, key: str, pos: str, value: Column, name: str) -> DataFrame:
    """Last non-null value so far, inside one document."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def definition(html: Column, tag: str, boundary: str, target: str) -> Column:
    """Paragraphs before the boundary as one text, links to attributes marked; nested-div ones skipped."""
    head = F.substring_index(html, boundary, 1)
    inner = F.transform(h.blocks(head, [tag]), lambda b: b["inner"])
    kept = F.filter(inner, lambda p: ~p.contains("<div"))
    texts = F.filter(F.transform(kept, lambda p: h.mark_links(p, target)), lambda t: t != "")
    return ascii_fold(F.array_join(texts, "\n"))


def linked_attributes(text: Column) -> Column:
    """Sorted distinct last path segments of the marked links."""
    urls = F.regexp_extract_all(text, F.lit(r"<attr value=([^>]*)>"), 1)
    return F.array_sort(F.array_distinct(F.transform(urls, lambda u: F.element_at(F.split(u, "/"), -1))))


def expand_frontier(start: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Start urls as ``main`` and everything they link to as ``link-1``, distinct."""
    main = start.select(key, "url").withColumn("rank", F.lit("main"))
    hop = start.select(key, "url").join(edges.select("url", "target"), "url").select(
        key, F.col("target").alias("url"), F.lit("link-1").alias("rank"))
    return main.unionByName(hop).distinct()


# --- strict parser for nested pages ---------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LEVEL = {"h1": 1, "h2": 2, "h3": 3}
STREAM_SCHEMA = "pos int, level int, text string, href string, link_text string"


class _Article(HTMLParser):
    """Collects headings, folder labels and list items of folders below the main article."""

    def __init__(self, main_id: str):
        super().__init__(convert_charrefs=True)
        self.main_id, self.rows = main_id, []
        self.stack: list[dict] = []
        self.main_depth = None

    def _depth(self):
        return None if self.main_depth is None else len(self.stack) - self.main_depth

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in VOID:
            return
        node = {"tag": tag, "classes": (attrs.get("class") or "").split(), "attrs": attrs, "text": [], "links": [], "items": []}
        self.stack.append(node)
        if self.main_depth is None and attrs.get("id") == self.main_id:
            self.main_depth = len(self.stack)

    def handle_data(self, data):
        for node in self.stack:
            node["text"].append(data)

    def handle_endtag(self, tag):
        if not any(n["tag"] == tag for n in self.stack):
            return
        while self.stack:
            node = self.stack.pop()
            if self.main_depth is not None:
                self._close(node)
            if len(self.stack) < (self.main_depth or 0):
                self.main_depth = None if self.main_depth is None else -1
            if node["tag"] == tag:
                break
        if self.main_depth == -1:
            self.main_depth = 10 ** 6  # the article is over

    def _close(self, node):
        depth, parent = self._depth(), self.stack[-1] if self.stack else None
        text = "".join(node["text"]).strip()
        if node["tag"] == "a":
            for outer in self.stack:
                outer["links"].append((node["attrs"].get("href"), "".join(node["text"])))
        if depth == 0:
            level = LEVEL.get(node["tag"])
            if level and not (level == 3 and ":" in text):
                self.rows.append((level, text, None, None))
            elif node["tag"] == "div" and "folderlabel" in node["classes"] and "open/close all folders" not in text:
                self.rows.append((4, text, None, None))
        elif parent is not None and parent["tag"] == "div" and "folder" in parent["classes"] and depth == 1:
            if node["tag"] == "h2":
                self.rows.append((5, text, None, None))
            elif node["tag"] == "h3" and ":" not in text:
                self.rows.append((6, text, None, None))
        if node["tag"] == "li" and depth is not None and depth >= 2:
            outer = self.stack[self.main_depth:]
            if "folder" in outer[0]["classes"] and outer[1]["tag"] == "ul":
                href, link = node["links"][0] if node["links"] else (None, None)
                self.rows.append((None, text, href, link))


def parse_article(html: str, main_id: str = "main-article") -> list[tuple]:
    parser = _Article(main_id)
    parser.feed(html or "")
    parser.close()
    return [(i, *row) for i, row in enumerate(parser.rows)]


def article_stream(pages: DataFrame, key: str = "page_id", html: str = "html", main_id: str = "main-article") -> DataFrame:
    """Strict element stream of nested pages, one batch of pages at a time."""
    import pandas as pd

    field = pages.schema[key].dataType.simpleString()
    names = [key, "pos", "level", "text", "href", "link_text"]

    def parse(batches):
        for pdf in batches:
            rows = [(k, *row) for k, text in zip(pdf[key], pdf[html]) for row in parse_article(text, main_id)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"level": "Int32", "pos": "int32"})

    return pages.select(key, html).mapInPandas(parse, f"{key} {field}, {STREAM_SCHEMA}")


@F.udtf(returnType=STREAM_SCHEMA, useArrow=True)
class HtmlElements:
    """Strict element stream of one page as a table function: ``FROM pages, LATERAL html_elements(html)``."""

    def eval(self, html: str):
        yield from parse_article(html)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``html_elements`` known to the SQL of this session."""
    spark.udtf.register("html_elements", HtmlElements)


def entity_attributes(stream: DataFrame, key: str, target: str) -> DataFrame:
    """(page, path, url, explanation) of the list items whose first link points at an attribute."""
    rows = heading_paths(stream, key, "pos", "level", "text").filter(F.col("href").contains(target))
    prefix = F.concat(F.col("link_text"), F.lit(":"))
    tail = F.trim(F.substring(F.col("text"), F.length(prefix) + 1, F.length("text")))
    return rows.select(
        key, "pos", F.array_join("path", "->").alias("path"), F.col("href").alias("url"),
        F.when(F.startswith("text", prefix), tail).otherwise(F.col("text")).alias("explanation"),
    )
