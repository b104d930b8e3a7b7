"""Near copies for corpora: the linked fingerprints of ``simhash``, and all texts of a similarity of ``LEAST`` or more.

A fingerprint of 64 bits tells texts apart that differ in a few words of a hundred; a radius that holds such
pairs holds unrelated ones, too, and prunes nothing. So candidates beyond the radius come from
min-hashes over five-word shingles: ``BANDS`` bands of ``ROWS`` minima each, two texts being candidates if they agree
on a band, which pairs of similarity 0.8 miss with probability (1 - 0.8 ** ROWS) ** BANDS = 0.002. Every
candidate is verified: its shingle sets are joined and their exact similarity (common ones over all of both) decides.

A band's texts are not paired with each other at first: each meets ``HEADS`` texts of its band, drawn by hash per band
(all of them in bands of two, nearly all in small ones), so pairs grow with texts where a band's texts are similar. Then
a bound takes out the texts that cannot be similar to any of another group: two texts have only shingles in common that occur
in both their groups. The others meet the texts of their band that share most, as long as that
halves them, and then the rest is compared exactly: all pairs of texts of a band that are still in different groups, have not
met and share one of the rare shingles that similar texts must share. So no two similar texts of a band are left apart. Texts of equal shingle sets are one
text, and pairs that are already linked are not compared.

Defined cases: those of ``simhash``; A-Z fall to a-z; a text of fewer than five words has one shingle, the
whole of it; texts without words have none and are linked by their fingerprint only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.llm import simhash
from docattr.llm.urls import probed
from docattr.llm.words import byte_words, row_key, row_keys
from docattr.operators.graph import star_components
from docattr.session import cut, discard

SHINGLE = 5
#: Least similarity as a fraction.
LEAST = (4, 5)
BANDS = 12
ROWS = 4
HEADS = 3
_ODD = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``shingle`` words."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words).lower()
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(stops[:-1] + 1).tolist()]
    last = stops[shingle - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 7) for a, b in zip(starts, last, strict=False)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One hash per band of minima."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at:at + 2048, None] ^ _ODD[0]) * _ODD[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    grouped = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(grouped)]


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp, s1, s2, n, bands) per row: ``s1`` and ``s2`` are a digest of the shingle set, ``n`` its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, first, second, sizes, found = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py()
                hashes = shingles(text)
                a, b = np.frombuffer(hashlib.md5(hashes.tobytes()).digest(), "<i8").tolist()
                fps.append(simhash.simhash(text))
                first.append(a)
                second.append(b)
                sizes.append(len(hashes))
                found.append(bands(hashes))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "row", "fp", "s1", "s2", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(
        run, "doc_id long, row struct<a:long,b:long>, fp long, s1 long, s2 long, n long, bands array<long>")


def in_bands(sets: DataFrame) -> DataFrame:
    """(s1, s2, n, root, band): a row per set and band, without the bands of one text."""
    each = sets.select("s1", "s2", "n", "root", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("band")
    return cut(each.join(cut(shared), "band"))


def _comparable(n: str, o: str) -> Column:
    """Whether sizes allow the similarity."""
    least, of = LEAST
    return of * F.least(n, o) >= least * F.greatest(n, o)


def _ordered(pairs: DataFrame, mine: Column, other: Column) -> DataFrame:
    both = pairs.select(F.least(mine, other).alias("x"), F.greatest(mine, other).alias("y"))
    return both.select(F.col("x.s1").alias("x1"), F.col("x.s2").alias("x2"), F.col("y.s1").alias("y1"), F.col("y.s2").alias("y2")).distinct()


def candidates(each: DataFrame, *first: Column) -> DataFrame:
    """(x1, x2, y1, y2): pairs of sets to verify first, of rows as from ``in_bands``: texts and the heads of their bands, with other
    roots and sizes that allow the similarity. Heads are drawn among the texts that come first by ``first``."""
    me = F.struct("s1", "s2", "n", "root")

    def head(i: int) -> Column:
        return F.min(F.struct(*first, F.xxhash64(F.lit(i), "band", "s1", "s2").alias("h"), me.alias("head")))["head"]

    heads = each.groupBy("band").agg(F.array_distinct(F.array(*[head(i) for i in range(HEADS)])).alias("heads"))
    met = each.join(heads, "band").select("s1", "s2", "n", "root", F.explode("heads").alias("o"))
    near = met.filter((F.col("root") != F.col("o.root")) & _comparable("n", "o.n"))
    return _ordered(near, F.struct("s1", "s2"), F.struct("o.s1", "o.s2"))


def several_roots(each: DataFrame) -> DataFrame:
    """The rows of ``each`` in bands whose texts have several roots."""
    several = each.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
    return each.join(several, "band")


def rest(each: DataFrame, done: DataFrame) -> DataFrame:
    """(x1, x2, y1, y2): all other pairs of a band (or what ``band`` holds) with different roots and sizes that allow the similarity, without those in
    ``done``. Roots are paired before texts, so texts of one root never meet."""
    open_bands = cut(several_roots(each))
    roots = open_bands.select("band", "root").distinct()
    two = roots.select("band", F.col("root").alias("u")).join(roots.select("band", F.col("root").alias("v")), "band").filter("u < v")

    def side(root: str, c: str) -> DataFrame:
        return open_bands.select("band", F.col("root").alias(root), F.struct("s1", "s2").alias(c), F.col("n").alias(f"n{c}"))

    met = two.join(side("u", "x"), ["band", "u"]).join(side("v", "y"), ["band", "v"]).filter(_comparable("nx", "ny"))
    return _ordered(met, F.col("x"), F.col("y")).join(done, ["x1", "x2", "y1", "y2"], "left_anti")


def hashed(texts: DataFrame) -> DataFrame:
    """(s1, s2, hashes) of (s1, s2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["s1", "s2", "hashes"])

    return texts.select("s1", "s2", "text").mapInArrow(run, "s1 long, s2 long, hashes array<long>")


def shingle_lists(docs: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(s1, s2, hashes) of the sets ``asked`` (s1, s2); ``rows`` as from ``marks``.

    Only texts whose key a filter passes are moved, and they are reduced to one shingle list per set.
    """
    least_row = F.min(F.struct(F.col("row.a").alias("k1"), F.col("row.b").alias("k2"))).alias("r")
    one = cut(rows.join(asked, ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(least_row).select("s1", "s2", "r.k1", "r.k2"))
    texts = probed(docs.select(*row_keys("doc_id", "text"), "text"), "k1", one).filter("maybe").join(one, ["k1", "k2"])
    return cut(hashed(texts).dropDuplicates(["s1", "s2"]))


def linkable(each: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``each`` (as from ``in_bands``) in bands of several roots with ``k``, without those of texts that are similar
    to none of another root in the band; ``sets`` as from ``shingle_lists`` has the lists of all in such bands.

    Two texts of different roots have only shingles in common that occur under several roots: ``k`` of a text's. Similar
    ones have at least least / (least + of) of both sizes in common, and the other is no smaller than the least
    of the band. Without the texts that fall short, fewer shingles occur under several roots, so this is done
    again as long as it takes half of the rows.
    """
    least, of = LEAST
    left = cut(several_roots(each))
    while True:
        texts = left.select("s1", "s2", "root").distinct()
        held = cut(texts.join(sets, ["s1", "s2"]).select("s1", "s2", "root", F.explode("hashes").alias("h")))
        common = cut(held.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("h"))
        # a filter may pass a shingle too many, which only keeps a text
        counted = probed(held, "h", common).groupBy("s1", "s2").agg(F.count_if("maybe").alias("k"))
        smallest = left.groupBy("band").agg(F.min("n").alias("o"))
        known = left.drop("k").join(counted, ["s1", "s2"]).join(smallest, "band")
        other = F.greatest(of * F.col("o"), least * F.col("n"))
        able = known.filter(of * (least + of) * F.col("k") >= least * (of * F.col("n") + other)).drop("o")
        last, left = left, cut(several_roots(able))
        before, now = last.count(), left.count()
        discard(held, common, last)
        if 2 * now > before or not now:
            return left


def prefixes(able: DataFrame, sets: DataFrame) -> DataFrame:
    """(s1, s2, n, root, band): for texts as from ``linkable`` their rarest shingles, with the shingle as ``band``.

    Similar texts of different roots have at least c shingles in common, all of them under several roots. Ordered by how
    many texts have them, the first k - c + 1 of such shingles of either text, at least, then have one in common.
    """
    least, of = LEAST
    smallest = able.groupBy("band").agg(F.min("n").alias("o"))
    texts = able.join(smallest, "band").groupBy("s1", "s2", "n", "root").agg(F.min("o").alias("o"))
    held = cut(texts.join(sets, ["s1", "s2"]).select("s1", "s2", "n", "root", "o", F.explode("hashes").alias("h")))
    held_by = F.count(F.lit(1)).alias("f")
    common = held.groupBy("h").agg(held_by, F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("h", "f")
    ordered = F.sort_array(F.collect_list(F.struct("f", "h"))).alias("t")
    each = held.join(common, "h").groupBy("s1", "s2", "n", "root", "o").agg(ordered)
    other = F.greatest(of * F.col("o"), least * F.col("n"))
    c = F.ceil(least * (of * F.col("n") + other) / F.lit(of * (least + of)))
    first = F.greatest(F.size("t") - c + 1, F.lit(0)).cast("int")
    return cut(each.select("s1", "s2", "n", "root", F.explode(F.slice(F.col("t.h"), 1, first)).alias("band")))


def in_one_band(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """The ``pairs`` of sets that agree on a band; ``each`` as from ``in_bands``."""
    held = cut(each.groupBy("s1", "s2").agg(F.collect_set("band").alias("b")))
    left, right = (held.toDF(f"{c}1", f"{c}2", f"b{c}") for c in "xy")
    met = pairs.join(left, ["x1", "x2"]).join(right, ["y1", "y2"])
    return met.filter(F.arrays_overlap("bx", "by")).select("x1", "x2", "y1", "y2")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` whose shingle sets are as similar as ``LEAST``; ``sets`` as from ``shingle_lists`` has theirs."""
    left, right = (sets.select(F.col("s1").alias(f"{c}1"), F.col("s2").alias(f"{c}2"), F.col("hashes").alias(f"h{c}")) for c in "xy")
    least, of = LEAST
    common = F.size(F.array_intersect("hx", "hy"))
    # common / (all - common) >= least / of
    return pairs.join(left, ["x1", "x2"]).join(right, ["y1", "y2"]).filter(
        (least + of) * common >= least * (F.size("hx") + F.size("hy"))).select("x1", "x2", "y1", "y2")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, root) per row: texts that the fingerprints or the similarity link, directly or over others."""
    rows = cut(marks(docs))
    distinct = cut(rows.select("fp").distinct())
    roots = star_components(simhash.links(distinct), "fp", "root").withColumnsRenamed({"node": "fp"})
    named = cut(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    # one row per shingle set; sets under several roots link them
    held = cut(rows.filter("n > 0").groupBy("s1", "s2", "n", "bands", "fp").agg(F.count(F.lit(1)).alias("times")).drop("times").join(named, "fp"))
    sets = cut(held.groupBy("s1", "s2", "n", "bands").agg(F.min("root").alias("root")))
    owner = sets.select("s1", "s2", "root")
    equal = held.select("s1", "s2", F.col("root").alias("u")).join(owner.withColumnsRenamed({"root": "v"}), ["s1", "s2"]).select("u", "v")
    each = in_bands(sets)

    def similar(pairs: DataFrame) -> DataFrame:
        near = verified(lists, pairs)
        return near.join(owner.toDF("x1", "x2", "u"), ["x1", "x2"]).join(owner.toDF("y1", "y2", "v"), ["y1", "y2"]).select("u", "v")

    def merged(links: DataFrame) -> DataFrame:
        return cut(star_components(links, "u", "v")).select(F.col("node").alias("root"), F.col("root").alias("_root"))

    def rerooted(rows: DataFrame, more: DataFrame) -> DataFrame:
        return cut(rows.join(more, "root", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root"))

    done = cut(candidates(each))
    lists = shingle_lists(docs, rows, several_roots(each).select("s1", "s2").distinct())
    links = cut(equal.unionByName(similar(done)))
    more = merged(links)
    able = linkable(rerooted(each, more), lists)
    count = able.count()
    while count:
        # texts that share most are most likely to link the others
        pairs = cut(candidates(able, -F.col("k")).join(done, ["x1", "x2", "y1", "y2"], "left_anti"))
        done = cut(done.unionByName(pairs))
        links = cut(links.unionByName(similar(pairs)))
        more = merged(links)
        able = linkable(rerooted(able, more), lists)
        before, count = count, able.count()
        if 2 * count > before:
            left = cut(in_one_band(rest(prefixes(able, lists), done), able))
            more = merged(links.unionByName(similar(left)))
            break
    final = named.join(more, "root", "left").select("fp", F.coalesce("_root", "root").alias("root"))
    return rows.select("doc_id", "row", "fp").join(final, "fp").select("doc_id", "row", "root")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class stays, chosen as in ``simhash.representatives``."""
    return simhash.kept(docs, classes(docs))
