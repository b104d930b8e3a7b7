"""Document fingerprints from closed syncmers over words.

Of the ``k - s + 1`` runs of ``s`` words inside a run of ``k`` words, take the one with the smallest hash; the
k-run is a closed syncmer if that is its first or its last one. Whether a run is chosen depends on
its own words only, so two texts that share a passage share its anchors wherever it stands, and the
anchors' positions align the passages (``matches``). The likeness of two texts is the share of common anchors among all
distinct ones of both, none left out, whatever the length; the fingerprint is a digest of all of them. Everything is built-in expressions inside the row.

Defined cases: a null or blank text has no anchors and the empty fingerprint; a text of fewer than ``k`` words
has one anchor, its whole word sequence; one of ``k`` words or more without a closed syncmer (some of up to
11 words at 8 and 3) has one anchor, its k-run of the smallest hash; two empty fingerprints have likeness 1, an empty and another
one 0; ties of the smallest hash count as an edge if an edge has it; equal texts have equal
fingerprints; other columns are ignored. For ``with_next``: rows are ordered by descending id, then by
text hash, nulls last; repeated rows are documents of their own, and a single document is its
own next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docattr.llm.words import words
from docattr.operators.ordered import bind

K = 8
S = 3
#: Ranges of the document order per shuffle partition.
RANGES = 4
#: Rows that the ranges are fitted on; they steer sizes only.
SAMPLE = 16384


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct(pos, hash)> of the closed syncmers; ``pos`` is the k-run's first word."""

    def chosen(w: Column) -> Column:
        size = F.size(w)
        inner = F.transform(F.sequence(F.lit(0), size - s), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))

        def of(h: Column) -> Column:
            def closed(i: Column) -> Column:
                edge = F.least(F.get(h, i), F.get(h, i + (k - s)))
                return edge <= F.least(*[F.get(h, i + j) for j in range(1, k - s)])

            def anchor(i: Column) -> Column:
                return F.struct(i.alias("pos"), F.xxhash64(
                    F.get(h, i), *[F.get(h, i + j) for j in range(s, k - s + 1, s)], F.get(h, i + (k - s))).alias("hash"))

            every = F.sequence(F.lit(0), size - k)
            lone = F.array_min(F.transform(every, lambda i: F.struct(anchor(i)["hash"].alias("hash"), i.alias("pos"))))
            return bind(F.filter(every, closed), lambda starts: F.when(
                F.size(starts) > 0, F.transform(starts, anchor)).otherwise(
                F.array(F.struct(lone["pos"].alias("pos"), lone["hash"].alias("hash")))))

        one = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(w).alias("hash")))
        none = F.slice(one, 1, 0)
        return F.when(size >= k, bind(inner, of)).when(size > 0, one).otherwise(none)

    return bind(words(text), chosen)


def hashes(found: Column) -> Column:
    """The distinct anchor hashes, in order."""
    return F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"])))


def fingerprint(every: Column) -> Column:
    """SHA-256 over all hashes as fixed-width hexadecimal digits; empty if there are none."""
    digits = F.array_join(F.transform(every, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return F.when(F.size(every) == 0, "").otherwise(F.sha2(digits, 256))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all of both, 0 to 1."""
    def of(common: Column) -> Column:
        return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))

    return bind(F.size(F.array_intersect(a, b)), of)


def matches(a: Column, b: Column) -> Column:
    """array<struct(pos_a, pos_b)>: first positions of anchors with equal hashes, for positional matching."""
    def first(found: Column) -> Column:
        return F.map_from_entries(F.transform(
            F.array_distinct(F.transform(found, lambda x: x["hash"])),
            lambda h: F.struct(h, F.get(F.filter(found, lambda x: x["hash"] == h), F.lit(0))["pos"])))

    both = F.array_intersect(F.transform(a, lambda x: x["hash"]), F.transform(b, lambda x: x["hash"]))
    return bind(first(a), lambda left: bind(first(b), lambda right: F.transform(both, lambda h: F.struct(
        F.element_at(left, h).alias("pos_a"), F.element_at(right, h).alias("pos_b")))))


def with_next(rows: DataFrame, add: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """(doc_id, columns, next_columns): ``columns`` of ``add(rows)``, and those of the next document in descending
    order of id; the last one's is the first. ``rows`` has ``doc_id`` and ``text``; ``add`` works row by row.

    Rows are cut into ranges of (id, text hash) at quantiles of a sample, so rows without id or with one id are spread
    like others; inside a range the next row is a window away, and the first row of each range, one per
    range, is copied behind the last row of the range before.
    """
    spark = rows.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ~x is -x - 1, which no id overflows
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("d"),
                     F.xxhash64("text").alias("tie"))
    keyed = rows.select("doc_id", "text", place.alias("_place"))
    sample = keyed.select("_place").orderBy(F.xxhash64(F.lit(3), "_place"), "_place").limit(SAMPLE).collect()
    seen = sorted(tuple(r["_place"]) for r in sample)
    bounds = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    listed = F.array(*[F.struct(F.lit(n).alias("none"), F.lit(d).cast("long").alias("d"), F.lit(h).cast("long").alias("tie"))
                       for n, d, h in bounds]).cast("array<struct<none:boolean,d:bigint,tie:bigint>>")
    at = F.aggregate(listed, F.lit(0), lambda n, b: n + (b <= F.col("_place")).cast("int"))
    placed = keyed.withColumn("_at", at)
    # one row per range: its number, the key of its first row and the range before it
    loop = Window.orderBy("_at")
    heads = placed.groupBy("_at").agg(F.min("_place").alias("_first")).select(
        F.col("_first").alias("_head"),
        F.coalesce(F.lag("_at").over(loop), F.max("_at").over(Window.partitionBy())).alias("_before"))
    found = placed.join(F.broadcast(heads), F.col("_place") == F.col("_head"))
    # each range also gets a copy of the row that follows its last one; it is dropped after the window
    ghosts = found.select("doc_id", "text", "_place", F.col("_before").alias("_at"), F.lit(1).alias("_ghost")).dropDuplicates(["_at"])
    every = placed.select("doc_id", "text", "_place", "_at", F.lit(0).alias("_ghost")).unionByName(ghosts)
    # the text travels once, inside the struct that the window looks ahead to
    every = add(every).select("doc_id", "_at", "_ghost", "_place", F.struct(*columns).alias("_me"))
    order = Window.partitionBy("_at").orderBy("_ghost", "_place")
    whole = every.withColumn("_next", F.lead("_me").over(order)).filter("_ghost = 0")
    return whole.select("doc_id", *[F.col(f"_me.{c}").alias(c) for c in columns],
                        *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by as many first ones of another text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def edit_report(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, lambda r: r, ["text"])
    rows = rows.withColumn("changed", edited(F.col("text"), F.col("next_text")))
    # the texts travel, not their anchors, which would take more room
    for c, name in (("text", "own"), ("changed", "new"), ("next_text", "other")):
        rows = rows.withColumn(name, F.explode(F.array(hashes(anchors(F.col(c), k, s)))))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))
