"""URL rules and a blocklist behind a blocked Bloom filter.

A URL is judged by the longest rule that fits it, else by a list of canonical URLs. The list is held
as a blocked Bloom filter: a key's hash picks one block of 8 x 32 bits and sets one bit in each of its
words. The number of blocks is a parameter, so the filter's size is bounded whatever the length of the
list, and it may be broadcast; a fuller filter only passes more. What it passes goes to an exact
hash join with the list, which removes the false positives; what it stops is not on the list.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is not
listed; null entries of the list are ignored, repeated ones count once; repeated pages are judged
each; an empty list blocks nothing; an empty table gives an empty result; clashing names in either
table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
BLOCKS = 1 << 15
#: Most blocks of a filter that is sized from its keys.
LARGEST = 1 << 18
WORDS = 8


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes, sorted query without
    tracking parameters; no scheme and no fragment. Null where there is no host."""
    name = F.regexp_replace(host(url), r"^www\.|:(80|443)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(name != "", F.concat(name, F.regexp_replace(path(url), r"/++$", ""), tail))


def longest_rule(name: Column, where: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((name == h) | name.endswith("." + h)) & where.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number and one bit mask per word."""
    h = F.xxhash64(F.lit(11), key)
    bits = [F.pmod(F.shiftrightunsigned(h, 5 * i), F.lit(32)).cast("int") for i in range(WORDS)]
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1), b) for b in bits]


def bloom(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """(block, w0..w7): at most ``blocks`` rows, merged map-side."""
    block, masks = _place(F.col(key), blocks)
    return keys.filter(F.col(key).isNotNull()).groupBy(block.alias("block")).agg(
        *[F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)])


def listed(rows: DataFrame, key: str, keys: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` with ``maybe`` (the filter passes the key) and ``listed`` (the key is on the list)."""
    names = keys.select(F.col(keys.columns[0]).alias("_listed")).filter("_listed IS NOT NULL").distinct()
    filled = bloom(names, "_listed", blocks).withColumnsRenamed({"block": "_block"} | {f"w{i}": f"_w{i}" for i in range(WORDS)})
    block, masks = _place(F.col(key), blocks)
    passes = reduce(lambda a, b: a & b, [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    # the filter has at most ``blocks`` rows of 40 bytes: bounded, so broadcast
    probed = rows.join(F.broadcast(filled), block == F.col("_block"), "left").withColumn(
        "maybe", F.col(key).isNotNull() & F.coalesce(passes, F.lit(False))).drop(*filled.columns)
    # only possible hits are shuffled to the list
    stopped = probed.filter(~F.col("maybe")).withColumn("listed", F.lit(False))
    hits = probed.filter("maybe").join(names, F.col(key) == F.col("_listed"), "left")
    return stopped.unionByName(hits.withColumn("listed", F.col("_listed").isNotNull()).drop("_listed"))


def probed(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: true for all whose key is in the table ``keys``, and for few others.

    The filter has a block per 16 keys, up to ``LARGEST`` blocks of 40 bytes, so it can be broadcast; beyond, it
    passes more rows, which an exact join behind it settles as it does the others.
    """
    blocks = min(LARGEST, max(1 << 8, keys.count() // 16))
    filled = bloom(keys, key, blocks).withColumnsRenamed({"block": "_block"} | {f"w{i}": f"_w{i}" for i in range(WORDS)})
    block, masks = _place(F.col(key), blocks)
    passes = reduce(lambda a, b: a & b, [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    return rows.join(F.broadcast(filled), block == F.col("_block"), "left").withColumn(
        "maybe", F.coalesce(passes, F.lit(False))).drop(*filled.columns)


def judge(pages: DataFrame, blocklist: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          blocks: int = BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, maybe, listed); ``blocklist`` holds URLs in its first column."""
    url = F.col("url")
    keys = blocklist.select(canonical(F.col(blocklist.columns[0])).alias("key"))
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_key"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = listed(rows, "_key", keys, blocks)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"),
                         "maybe", "listed")
