"""Hard negatives: rows of another label that score just below an anchor's positives.

Vectors are integers, ``floor(SCALE * x)``. Every row gets a one-bit code: the signs ``b`` of its randomly rotated vector ``y``,
with its alignment ``A = <b, y> / d``, so that ``y = A b + r`` with ``r`` at right angles to ``b``. For a rotated anchor ``z`` held in
``PLANES`` bit planes, ``<b, z>`` is a sum of popcounts up to the planes' rounding error, and ``<r, z>`` is at most ``|r|`` times the
part of ``z`` at right angles to ``b`` (Cauchy-Schwarz). That gives an interval which always holds the score, so
rows whose interval cannot reach the wanted range or the best ones so far are left out without loss, and only the
others are scored in integers.

Anchors and rows meet in tiles: rows are dealt into chunks and anchors into blocks, each of a fixed number of components, and one
task holds one chunk and one block. A tile returns at most ``k`` rows per anchor (and positive), best first; the best
of all tiles are ranked in Spark. Two passes: positives first, as their scores bound the negatives'.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; equal rows
are one row; other rows that share an id are rows of their own (ties of score go by id, then by a hash of the row); vectors
score only with vectors of their length; an empty vector scores 0; scores beyond a ``long`` are held at its ends; an anchor with
no positives, or a positive with no negatives, has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docattr.session import cut

SCALE = 256
K = 5
#: A negative scores between these parts of a hundred of its positive's score.
LOW, HIGH = 80, 100
PLANES = 8
#: Components of a chunk of rows and of a block of anchors.
CHUNK, ANCHORS = 1 << 19, 1 << 17
SEED = 23

CODED = "id long, label long, v array<long>, k1 long, k2 long, code binary, alignment double, rest double"


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))[0] if d else np.zeros((0, 0))


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, v, k1, k2) of the rows that take part; ``rows`` has vec_id, label and embedding."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.col("label").cast("long")
    whole = some.select(
        F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("long")).alias("v"))
    keyed = whole.select("*", F.xxhash64("id", "label", "v").alias("k1"), F.xxhash64(F.lit(1), "id", "label", "v").alias("k2"))
    return keyed.dropDuplicates(["k1", "k2"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits of the rotated rows in words of 64, alignment with them, and the length of the rest."""
    d = v.shape[1]
    y = v.astype(np.float64) @ rotation(d).T
    bits = np.packbits(y >= 0, axis=1, bitorder="little")
    words = np.zeros((len(v), -(-d // 64) * 8), np.uint8)
    words[:, :bits.shape[1]] = bits
    alignment = np.abs(y).mean(axis=1) if d else np.zeros(len(v))
    rest = np.sqrt(np.maximum(0.0, (y * y).sum(axis=1) - alignment * alignment * d))
    return words.view(np.uint64), alignment, rest


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` as from ``usable`` with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("v")], np.int64)
            codes, alignment, rest = [b""] * len(lengths), np.zeros(len(lengths)), np.zeros(len(lengths))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                words, alignment[at], rest[at] = encode(_matrix(batch.column("v").take(pa.array(at)), len(at)))
                for i, w in zip(at.tolist(), words, strict=True):
                    codes[i] = w.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes, pa.binary()), pa.array(alignment), pa.array(rest)],
                names=["id", "label", "v", "k1", "k2", "code", "alignment", "rest"])

    return rows.mapInArrow(run, CODED)


class Bounds:
    """Intervals of the scores of a chunk's rows with one anchor."""

    def __init__(self, codes: np.ndarray, alignment: np.ndarray, rest: np.ndarray, d: int):
        self.codes, self.alignment, self.rest, self.d = codes, alignment, rest, d
        self.ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)

    def of(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, n = self.d, len(self.codes)
        if not d:
            return np.zeros(n), np.zeros(n)
        low, step = z.min(), (z.max() - z.min()) / (2 ** PLANES - 1)
        steps = np.round((z - low) / step).astype(np.int64) if step else np.zeros(d, np.int64)
        off = np.abs(z - (low + step * steps)).sum()
        planes = np.zeros((PLANES, self.codes.shape[1] * 64), bool)
        planes[:, :d] = steps >> np.arange(PLANES)[:, None] & 1
        planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
        counted = np.zeros(n, np.int64)
        for j, plane in enumerate(planes):
            counted += np.bitwise_count(self.codes & plane).sum(axis=1, dtype=np.int64) << j
        # <b, z> with b = 2 * bit - 1
        product = low * (2 * self.ones - d) + step * (2 * counted - steps.sum())
        least = np.maximum(0.0, np.abs(product) - off)
        across = np.sqrt(np.maximum(0.0, z @ z - least * least / d))
        error = self.alignment * off + self.rest * across
        error += 1e-9 * (1.0 + np.sqrt(z @ z) * (self.alignment * np.sqrt(d) + self.rest))  # of floating point
        return self.alignment * product - error, self.alignment * product + error


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, held at the ends of a long."""
    top = max(int(np.abs(v).max(initial=0)), 1) * max(int(np.abs(q).max(initial=0)), 1) * max(1, len(q))
    if 0 < top < 1 << 62:
        return v @ q
    ends = np.iinfo(np.int64)
    return np.array([min(max(s, ends.min), ends.max) for s in v.astype(object) @ q.astype(object)], np.int64)


class Chunk:
    """The rows of a tile with their bounds; tasks go over its anchors."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        self.k1, self.k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        self.v = _matrix(table.column("v"), n)
        d = self.v.shape[1]
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64).reshape(n, -1)
        self.bounds = Bounds(codes, table.column("alignment").to_numpy(), table.column("rest").to_numpy(), d)

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the first ``k`` by score, id and hash."""
        return np.lexsort((self.k2[at], self.k1[at], self.ids[at], -scores))[:k]


def _reaching(at: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """Those of ``at`` that may be among the first ``k``, given which are ``sure`` to count."""
    floors = low[at[sure]]
    if len(floors) < k:
        return at
    return at[high[at] >= np.partition(floors, len(floors) - k)[len(floors) - k]]


FOUND = "a1 long, a2 long, p1 long, p2 long, anchor_id long, positive_id long, positive_score long, id long, score long, k1 long, k2 long"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _tile(rows: DataFrame, anchors: DataFrame, one) -> DataFrame:
    """Every anchor against every row of its length: ``one(chunk, anchor, v)`` yields rows of ``FOUND``."""
    d = F.size("v")
    chunks = F.ceil(F.lit(rows.count()) * F.greatest(d, F.lit(1)) / F.lit(CHUNK)).cast("long")
    blocks = F.ceil(F.lit(max(1, anchors.count())) * F.greatest(d, F.lit(1)) / F.lit(ANCHORS)).cast("long")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    left = rows.select("*", d.alias("d"), F.pmod("k1", chunks).alias("chunk"), every(blocks).alias("block"))
    right = anchors.select("*", d.alias("d"), F.pmod("k2", blocks).alias("block"), every(chunks).alias("chunk"))
    tile = ["d", "chunk", "block"]

    def run(near: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if near.num_rows and asked.num_rows:
            chunk, vectors = Chunk(near), _matrix(asked.column("v"), asked.num_rows)
            turned = vectors.astype(np.float64) @ rotation(vectors.shape[1]).T
            for i, anchor in enumerate(asked.drop_columns(["v"]).to_pylist()):
                found += one(chunk, anchor, vectors[i], turned[i])
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * len(_NAMES))], names=_NAMES)

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, FOUND)


def positives(rows: DataFrame, anchors: DataFrame, k: int = K) -> DataFrame:
    """(a1, a2, anchor_id, id, score, k1, k2): the first ``k`` other rows of each anchor's label."""

    def one(chunk: Chunk, anchor: dict, v: np.ndarray, z: np.ndarray) -> Iterator[tuple]:
        same = np.flatnonzero((chunk.labels == anchor["label"]) & ~((chunk.k1 == anchor["k1"]) & (chunk.k2 == anchor["k2"])))
        low, high = chunk.bounds.of(z)
        at = _reaching(same, low, high, np.ones(len(same), bool), k)
        scores = exact(chunk.v[at], v)
        for i in chunk.first(at, scores, k).tolist():
            j = at[i]
            yield (anchor["k1"], anchor["k2"], None, None, anchor["id"], None, None, int(chunk.ids[j]), int(scores[i]), int(chunk.k1[j]), int(chunk.k2[j]))

    return _best(_tile(rows, anchors, one), ["a1", "a2"], k)


def negatives(rows: DataFrame, asked: DataFrame, k: int = K, low_part: int = LOW, high_part: int = HIGH) -> DataFrame:
    """The first ``k`` rows of another label for each anchor and positive in the range that the positive's score gives.

    ``asked`` holds anchors with ``positives``, an array of (score, id, k1, k2).
    """

    def one(chunk: Chunk, anchor: dict, v: np.ndarray, z: np.ndarray) -> Iterator[tuple]:
        other = np.flatnonzero(chunk.labels != anchor["label"])
        low, high = chunk.bounds.of(z)
        scored = {}
        for p in anchor["positives"]:
            # whole numbers between the parts of the score
            least, most = -(-low_part * p["score"] // 100), high_part * p["score"] // 100
            if least > most:
                continue
            if (least, most) not in scored:
                at = other[(high[other] >= least) & (low[other] <= most)]
                at = _reaching(at, low, high, (low[at] >= least) & (high[at] <= most), k)
                scores = exact(chunk.v[at], v)
                fits = (scores >= least) & (scores <= most)
                at, scores = at[fits], scores[fits]
                first = chunk.first(at, scores, k)
                scored[least, most] = at[first], scores[first]
            for j, score in zip(*scored[least, most], strict=True):
                yield (anchor["k1"], anchor["k2"], p["k1"], p["k2"], anchor["id"], p["id"], p["score"], int(chunk.ids[j]), int(score),
                       int(chunk.k1[j]), int(chunk.k2[j]))

    return _best(_tile(rows, asked, one), ["a1", "a2", "p1", "p2"], k)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "k1", "k2")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, asks: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the rows where ``asks`` holds for ``id``."""
    index = cut(coded(usable(rows, scale)))
    anchors = cut(index.filter(asks).select("id", "label", "v", "k1", "k2"))
    best = positives(index, anchors, k).groupBy("a1", "a2").agg(
        F.array_sort(F.collect_list(F.struct("score", "id", F.col("k1"), F.col("k2")))).alias("positives"))
    asked = cut(anchors.join(best.withColumnsRenamed({"a1": "k1", "a2": "k2"}), ["k1", "k2"]))
    return negatives(index, asked, k).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``rows`` with a wrong label where ``every`` divides the id."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label).alias("label"), "embedding")


def report(rows: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100."""
    return mine(relabelled(rows), F.col("id") % 100 == 0)
