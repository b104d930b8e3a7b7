"""SimHash near-duplicates through vantage-point trees.

Fingerprints within ``radius`` differing bits are linked; classes are the connected components
of the links. A vantage-point tree halves a set by the Hamming distance to a vantage
fingerprint: near ones inside, far ones outside. By the triangle inequality a query needs the other
half only where its distance lies within the search bound of the boundary; everything else
is pruned.

64-bit fingerprints of unrelated documents all lie about 32 bits apart, so with a bound of 3 over
half of all fingerprints overlap every boundary. The search is therefore spread over ``trees``
trees, each on its own share of the bits: two fingerprints that differ in at most ``radius``
bits differ in at most ``radius // trees`` bits of one share, which is the bound in that tree. With
4 trees the bound is 0 and no boundary overlaps; with 2 it is 1, with 1 it is the plain tree.
Candidates are always held against all 64 bits.

The upper levels of a tree are fitted on a bounded sample (``SAMPLE`` fingerprints, which steers
sizes only, never results) and cut the fingerprints into shards, at home in one leaf and copied to
the leaves their bound overlaps. Inside a shard the tree goes on, down to ``LEAF`` fingerprints, by
the same rule; see ``linked_sets``. A shard returns a spanning star of each of its linked sets, not their pairs,
and the stars are joined by contraction.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; equal
fingerprints are handled once, so groups of copies cost nothing more; a null id never is the
smallest of its class, whose ``component_id`` is null if it holds no other; rows are documents;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.llm.urls import probed
from docattr.llm.words import byte_words, row_key, row_keys, unpacked, whole_row
from docattr.operators.graph import star_components
from docattr.session import cut

SHINGLE = 3
RADIUS = 3
TREES = 4
SAMPLE = 16384
SHARD = 4096
LEAF = 96
SEARCH = 4096
ALL_BITS = (1 << 64) - 1


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats counted."""
    words = byte_words(text)
    if not words:
        return 0
    # only A-Z fall to a-z, as for bytes.lower
    joined = b" ".join(words).lower()
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = stops[shingle - 1:] or stops[-1:]
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, last, strict=False)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        block = hashes[at:at + 4096].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = 0
    for i in np.flatnonzero(2 * set_bits > n).tolist():
        value |= 1 << i
    return value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): one row per row of ``docs``; ``row`` is its key, ``fp`` holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row struct<a:long,b:long>, fp long")


def masks(trees: int, among: int = ALL_BITS) -> list[int]:
    """The bits of ``among``, dealt to ``trees`` disjoint masks."""
    bits = [i for i in range(64) if among >> i & 1]
    edges = [len(bits) * i // trees for i in range(trees + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _distance(fps: np.ndarray, vantage, mask: int = ALL_BITS) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def _vantage(fps: np.ndarray, mask: int) -> tuple[int, int] | None:
    """(vantage, radius) that halves the set best among a few candidates; None if none splits it."""
    best = None
    for vantage in fps[:: max(1, len(fps) // 3)][:3]:
        within = np.cumsum(np.bincount(_distance(fps, vantage, mask), minlength=65))
        smaller = np.minimum(within, len(fps) - within)
        radius = int(smaller.argmax())
        if smaller[radius] and (best is None or smaller[radius] > best[0]):
            best = (int(smaller[radius]), int(vantage), radius)
    return best and best[1:]


def fit_tree(sample: np.ndarray, mask: int, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside) of about ``leaves`` leaves; a child below 0 is leaf ``-child-1``."""
    nodes: list[list[int]] = []
    count = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal count
        split = _vantage(points, mask) if wanted > 1 and len(points) > 1 else None
        if split is None:
            count += 1
            return -count
        at = len(nodes)
        nodes.append([*split, 0, 0])
        inside = _distance(points, split[0], mask) <= split[1]
        share = max(1, min(wanted - 1, round(wanted * inside.mean())))
        nodes[at][2] = grow(points[inside], share)
        nodes[at][3] = grow(points[~inside], wanted - share)
        return at

    root = grow(sample, leaves)
    return [tuple(n) for n in nodes] if root >= 0 else []


def route(fps: np.ndarray, nodes: list, mask: int, bound: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions): the leaves that hold or overlap each fingerprint's ball of ``bound``."""
    todo = [(0 if nodes else -1, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node < 0:
            yield -node - 1, at
            continue
        vantage, radius, inside, outside = nodes[node]
        d = _distance(fps[at], vantage, mask)
        todo.append((inside, at[d <= radius + bound]))
        todo.append((outside, at[d > radius - bound]))


def _spread(fps: np.ndarray, at: np.ndarray, radius: int, join) -> None:
    """Link within one set: spread from a fingerprint to all that it reaches, over and over;
    each one is compared with the rest once, and no list of pairs is made."""
    if len(at) <= LEAF:
        near = np.bitwise_count(fps[at, None] ^ fps[None, at]) <= radius
        at = at[near.sum(axis=1) > 1]
    rest = at
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        first = front[0]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                near |= (np.bitwise_count(fps[front[i:i + 64], None] ^ fps[None, rest]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            for other in front.tolist():
                join(first, other)


def linked_sets(fps: np.ndarray, radius: int, mask: int, trees: int) -> np.ndarray:
    """Label of the linked set of each (distinct) fingerprint: the smallest position in it.

    The tree on ``mask`` goes on down to sets of ``LEAF``; both halves get what the bound overlaps, so
    every pair of the shard meets. A set that the mask cannot split further and that is too
    large to search is dealt to ``trees`` trees on the bits not used so far.
    """
    bound = radius // trees
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)

    todo = [(np.arange(len(fps)), mask, ALL_BITS & ~mask)]
    while todo:
        at, here, unused = todo.pop()
        if len(at) <= LEAF:
            _spread(fps, at, radius, join)
            continue
        split = _vantage(fps[at], here)
        if split:
            d = _distance(fps[at], split[0], here)
            halves = [at[d <= split[1] + bound], at[d > split[1] - bound]]
            if max(map(len, halves)) <= 0.9 * len(at) or not bound:
                todo += [(half, here, unused) for half in halves]
                continue
        if len(at) <= SEARCH or unused.bit_count() < 4 * trees:
            _spread(fps, at, radius, join)
            continue
        todo += [(at, part, unused & ~part) for part in masks(trees, unused)]
    return np.array([find(i) for i in range(len(fps))], np.int64)


def links(distinct: DataFrame, radius: int = RADIUS, trees: int = TREES, sample: int = SAMPLE,
          shard: int = SHARD) -> DataFrame:
    """(fp, root): spanning stars of the linked sets of every shard; ``distinct`` has each ``fp`` once."""
    bound = radius // trees
    total = distinct.count()
    seen = distinct.orderBy(F.xxhash64(F.lit(5), "fp")).limit(sample).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    leaves = max(1, min(sample // 8, -(-total // shard)))
    grown = [(mask, fit_tree(seen, mask, leaves)) for mask in masks(trees)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False)
            places, rows = [], []
            for tree, (mask, nodes) in enumerate(grown):
                for leaf, at in route(raw.view(np.uint64), nodes, mask, bound):
                    places.append(np.full(len(at), tree * leaves + leaf, np.int64))
                    rows.append(at)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(places)), pa.array(raw[np.concatenate(rows)])], names=["shard", "fp"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        fps = np.unique(table["fp"].to_numpy())
        label = linked_sets(fps.view(np.uint64), radius, grown[key[0].as_py() // leaves][0], trees)
        joined = label != np.arange(len(fps))
        return pa.table({"fp": fps[joined], "root": fps[label[joined]]})

    # few bytes and much work in each shard: their number must not shrink with the bytes
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.mapInArrow(deal, "shard long, fp long").repartition(spread, "shard")
    return dealt.groupBy("shard").applyInArrow(search, "fp long, root long")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, trees: int = TREES) -> DataFrame:
    """(doc_id, row, fp, root, component_id) per row: ``root`` is the class's smallest fingerprint,
    ``component_id`` the smallest id that the document reaches over links."""
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("_min")))
    roots = cut(star_components(links(distinct.select("fp"), radius, trees), "fp", "root"))
    named = distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("_min").alias("component_id"))
    return rows.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, trees: int = TREES) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class stays: the one with the smallest id, ids that
    are null last, rows with one id by their key; of equal rows one stays."""
    return kept(docs, classes(docs, shingle, radius, trees))


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The representatives of the classes ``found``, which have (doc_id, row, root) of every row."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keepers = cut(found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.row.a").alias("k1"), F.col("k.row.b").alias("k2")))
    every = found.groupBy(F.col("row.a").alias("k1"), F.col("row.b").alias("k2")).agg(F.count(F.lit(1)).alias("times"))
    # keys of which a row goes; the texts of all other rows need not move
    touched = cut(every.join(keepers.withColumn("stays", F.lit(True)), ["k1", "k2"], "left").filter("stays IS NULL OR times > 1").select("k1", "k2"))
    rows = probed(docs.select(*row_keys("doc_id", "text"), whole_row(docs)), "k1", touched)
    some = rows.filter("maybe").join(keepers, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return rows.filter("NOT maybe").select("row").unionByName(some.select("row")).select(*unpacked(docs))
