"""Removing repeated passages with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document. Every word covered by a window whose words
also start earlier (in a document before, or earlier in its own) is removed; the first occurrence stays.

The reference of a document is everything before it, which no broadcast could hold, so the reference is
sharded by content. In every window the ``ANCHOR``-word run with the smallest hash is its
anchor; equal windows have equal anchors, wherever they stand. Anchors that occur once are
dropped by a count over the corpus. The windows of one anchor occurrence form a segment of a
few dozen words, equal segments of an anchor are merged, and each anchor's segments are a reference shard:
its suffix automaton is built segment by segment in corpus order, each one first streamed through what is
there. The matching statistic at a word is the length of the longest run ending there that came earlier;
where it reaches ``WINDOW``, the window is a repetition. A shard is bounded by ``SHARD_SEGMENTS``; the
segments of an anchor above it (a common phrase in ever new surroundings) go an exact way round:
their windows are compared by content, counted map-side, so no key is ever held in one task.

``remove_known`` is the same with a given, bounded reference, which is broadcast.

Defined cases: a null or blank text has no words; documents of fewer words than a window keep all;
order is by id, nulls last; equal rows (id and text) are one document and get equal results; rows
with one id and different texts are ordered by text hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.llm.words import byte_words
from docattr.session import cut

WINDOW = 20
ANCHOR = 8
SHARD_SEGMENTS = 2000
LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All runs of the words added so far; ``stream`` gives matching statistics against them."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: Iterable) -> None:
        """Add one passage; runs do not cross passages."""
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state of the runs of p followed by word, apart from the longer runs of q."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, known, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def stream(self, words: Iterable) -> Iterator[int]:
        """Per word, the length of the longest run ending there that is in the automaton."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield length


def covered(statistics: Iterable[int], window: int) -> list[tuple[int, int]]:
    """Maximal (start, stop) word spans covered by matches of at least ``window`` words."""
    spans: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= window:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _anchors(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, number of windows) of every anchor occurrence, in order."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    runs = np.zeros(len(words) - anchor + 1, np.uint64)
    for i in range(anchor):
        runs = runs * _MIX + hashes[i:i + len(runs)]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    places = np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1)
    at = places.argmin(axis=1) + np.arange(len(places))
    positions, first, count = np.unique(at, return_index=True, return_counts=True)
    return runs[positions].view(np.int64), positions, first, count


def _key(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): the corpus order as two numbers."""
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(LAST)).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def scanned(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, k1, k2, n_words, whole, anchors): number and digest of all words, anchor hashes and whether
    one comes again in the document."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()),
                        ("whole", pa.string()), ("anchors", pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int8())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, wholes, ends, hashes, again = [], [], [0], [], []
            for text in batch.column(3):
                words = byte_words(text.as_py())
                counts.append(len(words))
                wholes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    found, times = np.unique(_anchors(words, window, anchor)[0], return_counts=True)
                    hashes.append(found)
                    again.append(np.minimum(times, 2).astype(np.int8))
                    ends.append(ends[-1] + len(found))
                else:
                    ends.append(ends[-1])
            flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.int64), (again, np.int8))]
            pairs = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(schema.field("anchors").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(wholes, pa.string()), lists], schema=schema)

    return _key(docs).mapInArrow(
        run, "doc_id long, k1 long, k2 long, n_words long, whole string, anchors array<struct<hash:long,n:byte>>")


_PLACES = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                     ("start", pa.int64()), ("n", pa.int64())])


def segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, digest, k1, k2, start, n): where the segments of the ``kept`` anchors of (k1, k2, text, kept) lie.

    A segment that comes again in its document is a repetition from end to end; such spans, merged, come
    as rows without an anchor, and only a document's first ones go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, seen, again = byte_words(text), set(), []
                if len(words) < window:
                    continue
                hashes, _, first, count = _anchors(words, window, anchor)
                wanted = np.isin(hashes, np.array(kept, np.int64))
                for h, at, n in zip(hashes[wanted].tolist(), first[wanted].tolist(), (count[wanted] + window - 1).tolist(), strict=True):
                    digest = xxhash.xxh64_intdigest(b" ".join(words[at:at + n])) - (1 << 63)
                    if (h, digest) not in seen:
                        seen.add((h, digest))
                        rows.append((h, digest, k1, k2, at, n))
                    elif again and at <= again[-1][1]:
                        again[-1][1] = at + n
                    else:
                        again.append([at, at + n])
                rows += [(None, None, k1, k2, a, b - a) for a, b in again]
            yield _batch(rows, _PLACES)

    return docs.select("k1", "k2", "text", "kept").mapInArrow(
        run, "anchor long, digest long, k1 long, k2 long, start long, n long")


def passages(docs: DataFrame) -> DataFrame:
    """(anchor, size, k1, k2, start, words): the words at the ``places`` of (k1, k2, text, places)."""
    schema = pa.schema([("anchor", pa.int64()), ("size", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("start", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = byte_words(text)
                for x in places:
                    part = b" ".join(words[x["start"]:x["start"] + x["n"]])
                    rows.append((x["anchor"], x["size"], k1, k2, x["start"], part))
            yield _batch(rows, schema)

    return docs.select("k1", "k2", "text", "places").mapInArrow(
        run, "anchor long, size long, k1 long, k2 long, start long, words binary")


_SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_SPANS_SQL = "k1 long, k2 long, start long, stop long"


def _search_shards(distinct: DataFrame, window: int, shards) -> DataFrame:
    """Repeated spans of the first occurrences of segments that share an anchor, by suffix automata."""

    def run(_key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("anchor", "k1", "k2", "start", "words")), strict=True))
        out, current, automaton = [], None, None
        for anchor, k1, k2, start, part in rows:
            if anchor != current:
                current, automaton = anchor, SuffixAutomaton()
            words = part.split()
            out += [(k1, k2, start + a, start + b) for a, b in covered(automaton.stream(words), window)]
            automaton.add(words)
        return pa.Table.from_batches([_batch(out, _SPANS)])

    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), shards)).repartition(spread, "shard")
    return dealt.groupBy("shard").applyInArrow(run, _SPANS_SQL)


def _search_windows(distinct: DataFrame, window: int) -> DataFrame:
    """The same for anchors of too many segments: their windows, compared by content."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, start, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = part.split()
                for i in range(len(words) - window + 1):
                    digest = xxhash.xxh128_digest(b" ".join(words[i:i + window]))
                    rows.append((*np.frombuffer(digest, "<i8").tolist(), k1, k2, start + i))
            yield _batch(rows, schema)

    each = distinct.select("k1", "k2", "start", "words").mapInArrow(run, "a long, b long, k1 long, k2 long, start long")
    place = F.struct("k1", "k2", "start")
    first = each.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = each.join(first.select("a", "b", "first"), ["a", "b"]).filter(F.col("first") != place)
    return again.select("k1", "k2", "start", (F.col("start") + window).alias("stop"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
                   shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(k1, k2, start, stop): word spans that windows with an earlier occurrence cover; ``texts`` as for ``segments``."""
    place = F.struct("k1", "k2", "start")
    every = cut(segments(texts, window, anchor))
    # equal segments of an anchor are repetitions from end to end, but for the first
    merged = cut(every.filter("anchor IS NOT NULL").groupBy("anchor", "digest").agg(
        F.min(F.struct("k1", "k2", "start", "n")).alias("f"), F.count(F.lit(1)).alias("times")).select(
        "anchor", "digest", "times", "f.*"))
    first = merged.filter("times > 1").select("anchor", "digest", place.alias("first"))
    inside = every.filter("anchor IS NULL").select("k1", "k2", "start", "n")
    copies = every.filter("anchor IS NOT NULL").join(first, ["anchor", "digest"]).filter(F.col("first") != place)
    copies = copies.select("k1", "k2", "start", "n").unionByName(inside).select(
        "k1", "k2", "start", (F.col("start") + F.col("n")).alias("stop"))
    # words are fetched only for anchors with segments that differ
    sizes = cut(merged.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    places = merged.join(sizes, "anchor").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "size", "start", "n")).alias("places"))
    several = cut(passages(texts.select("k1", "k2", "text").join(places, ["k1", "k2"])))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).scalar()
    shards = F.greatest(F.lit(1), F.ceil(total / F.lit(4 * shard_segments)))
    return copies.unionByName(_search_shards(several.filter(F.col("size") <= shard_segments), window, shards)).unionByName(
        _search_windows(several.filter(F.col("size") > shard_segments), window))


def _without(texts: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, kept): (k1, k2, text, spans) without the words of the spans."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = byte_words(text)
                stay = np.ones(len(words), bool)
                for span in spans:
                    stay[span["start"]:span["stop"]] = False
                kept = b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)
                rows.append((k1, k2, len(words) - int(stay.sum()), kept.decode("utf-8", "surrogatepass")))
            yield _batch(rows, schema)

    return texts.select("k1", "k2", "text", "spans").mapInArrow(run, "k1 long, k2 long, n_removed long, kept string")


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
             shard_segments: int = SHARD_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(scan, cleaned): one row per row of ``docs`` as ``scanned``, and one (k1, k2, n_removed, kept) for each of those
    documents that lose words; ``kept`` holds the remaining words joined by blanks."""
    scan = cut(scanned(docs, window, anchor))
    each = scan.select("k1", "k2", F.explode("anchors").alias("a")).select(
        "k1", "k2", F.col("a.hash").alias("hash"), F.col("a.n").alias("n"))
    shared = each.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash")
    wanted = each.select("k1", "k2", "hash").join(shared, "hash", "left_semi").groupBy("k1", "k2").agg(
        F.collect_set("hash").alias("kept"))
    # from here on only documents that share an anchor, and equal rows are one
    unique = _key(docs).groupBy("k1", "k2").agg(F.min("text").alias("text"))
    texts = cut(unique.join(wanted, ["k1", "k2"]))
    spans = repeated_spans(texts, window, anchor, shard_segments)
    listed = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cleaned = _without(texts.select("k1", "k2", "text").join(listed, ["k1", "k2"]))
    return scan.drop("anchors"), cleaned


def report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    scan, cleaned = repeated(docs, window, anchor, shard_segments)
    lost = cleaned.select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("sha"))
    joined = scan.join(lost, ["k1", "k2"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce("sha", "whole").alias("kept_sha256"))


def remove_known(docs: DataFrame, reference: list[str], window: int = WINDOW, shard_words: int = 50_000,
                 most_words: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): documents without spans of ``window`` words or more that are in a given
    reference of at most ``most_words`` words. The passages are broadcast; every task builds
    one automaton per shard of them and streams its documents through all."""
    passages = [byte_words(t) for t in reference]
    if sum(map(len, passages)) > most_words:
        raise ValueError(f"the reference has more than {most_words} words: too large to broadcast")
    shards: list[list[list[bytes]]] = [[]]
    for words in passages:
        if sum(map(len, shards[-1])) > shard_words:
            shards.append([])
        shards[-1].append(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for shard in sent.value:
            automata.append(SuffixAutomaton())
            for words in shard:
                automata[-1].add(words)
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = byte_words(text)
                stay = np.ones(len(words), bool)
                for automaton in automata:
                    for start, stop in covered(automaton.stream(words), window):
                        stay[start:stop] = False
                kept = b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)
                rows.append((key, len(words), len(words) - int(stay.sum()), kept.decode("utf-8", "surrogatepass")))
            yield _batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string")
