"""HTML fragments as Spark expressions, for flat markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docattr.functions.text import squeeze

# Character references resolved in text; the ampersand goes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]

ANCHOR = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def plain_text(fragment: Column) -> Column:
    out = F.regexp_replace(fragment, r"<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def blocks(html: Column, tags: list[str]) -> Column:
    """Elements in document order: array<struct<kind, inner>>."""
    names = "|".join(tags)
    pattern = F.lit(rf"(?s)<({names})(?:\s[^>]*)?>(.*?)</(?:{names})>")
    kinds, inner = F.regexp_extract_all(html, pattern, 1), F.regexp_extract_all(html, pattern, 2)
    return F.zip_with(kinds, inner, lambda k, i: F.struct(k.alias("kind"), i.alias("inner")))


def anchors(html: Column) -> Column:
    """Links in document order: array<struct<href, text>>."""
    href, inner = F.regexp_extract_all(html, F.lit(ANCHOR), 1), F.regexp_extract_all(html, F.lit(ANCHOR), 2)
    return F.zip_with(href, inner, lambda h, t: F.struct(h.alias("href"), plain_text(t).alias("text")))


def absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith(base), url).otherwise(F.concat(F.lit(base), url))


def mark_links(fragment: Column, target: str) -> Column:
    """Plain text of a fragment in which links to ``target`` became ``<attr value=...>`` tags."""
    pattern = rf'(?s)<a\s[^>]*?href="([^"]*{target}[^"]*)"[^>]*>(.*?)</a>'
    # control characters keep the new tags apart while the markup is stripped
    kept = F.regexp_replace(fragment, pattern, "\u0001attr value=$1\u0002$2\u0001/attr\u0002")
    return F.translate(plain_text(kept), "\u0001\u0002", "<>")


def list_item(item: Column, target: str) -> Column:
    """struct(url, explanation) of a list item, null unless its first link points at ``target``."""
    href = F.regexp_extract(item, ANCHOR, 1)
    link = plain_text(F.regexp_extract(item, ANCHOR, 2))
    content = plain_text(item)
    prefix = F.concat(link, F.lit(":"))
    tail = F.trim(F.substring(content, F.length(prefix) + 1, F.length(content)))
    return F.when(
        href.contains(target),
        F.struct(href.alias("url"), F.when(F.startswith(content, prefix), tail).otherwise(content).alias("explanation")),
    )
