"""Line dedup: a line that stands in several documents stays in the first of them.

A line's key is the line without white space at its ends, A-Z in lower case, held as 128 bits of hashes. The hashes
are range-partitioned and sorted by document and position inside, so first occurrences come by in one pass; texts stay where
they are until the end. What the pass returns is a bitmap per document: 64 lines a word, and only the words with a dropped
line are there. Keys so frequent that they would fill a task are found in a bounded sample; their first document comes
from a minimum that is reduced before it is shuffled, and is sent to the lines, so they enter no range at all.
Built-in functions only.

Defined cases: a null text is empty, an empty text is one empty line; keys of fewer than ``LEAST`` code points always stay;
a document is its ``doc_id``: rows that share one keep each other's lines, and rows without one are together
the last document; equal rows have equal bitmaps; an empty table gives an empty result; ``kept`` carries all other columns,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docattr.operators.ordered import bind
from docattr.session import cut

#: Least code points of a key.
LEAST = 10
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled lines per shuffle partition, and how many of one key make it a frequent one (a share of about 1 / (4 * partitions)).
SAMPLE, FREQUENT = 64, 16


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def line_key(line: Column) -> Column:
    """The line stripped, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    # ASCII throughout, where ``lower`` does the same and is several times faster
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _row(doc_id: str, text: str) -> list[Column]:
    """128 bits that equal (doc_id, text) share."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2")]


def hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, k1, k2, pos): one row per line whose key is long enough."""
    each = docs.select(F.col(doc_id).alias("doc_id"), *_row(doc_id, text), F.posexplode(F.split(_text(text), "\n")).alias("pos", "line"))
    keyed = each.filter(F.char_length("line") >= least).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "k1", "k2", "pos")


def frequent(rows: DataFrame) -> DataFrame:
    """(h1, h2, first_doc): hashes that a range could not hold; at most ``SAMPLE / FREQUENT`` per shuffle partition."""
    wanted = SAMPLE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, rows.count())
    slots = 1 << 40
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(3), "k1", "pos"), F.lit(slots)) < min(slots, slots * wanted // total))
    often = drawn.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).select("h1", "h2")
    return rows.join(F.broadcast(often), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))


def _after(doc: str, first: str) -> Column:
    """Whether a document comes behind the first one of its key; null is the last document."""
    return F.col(first).isNotNull() & (F.col(doc).isNull() | (F.col(doc) > F.col(first)))


def dropped(rows: DataFrame) -> DataFrame:
    """(k1, k2, pos) of the lines that do not stay, of rows as from ``hashes``."""
    often = cut(frequent(rows))
    marked = rows.join(F.broadcast(often.withColumn("often", F.lit(True))), ["h1", "h2"], "left")
    known = marked.filter(F.col("often") & _after("doc_id", "first_doc")).select("k1", "k2", "pos")
    ranged = marked.filter("often IS NULL").drop("often", "first_doc").repartitionByRange("h1", "h2")
    passed = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    streamed = ranged.withColumn("first_doc", F.first("doc_id").over(passed))
    return known.unionByName(streamed.filter(_after("doc_id", "first_doc")).select("k1", "k2", "pos"))


def bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(k1, k2, n_dropped, keep) of the texts that lose a line: ``keep`` holds (word, bits) for every 64 lines
    with a dropped one, a bit per line that stays."""
    gone = dropped(cut(hashes(docs, doc_id, text, least)))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("k1", "k2", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))))
    return words.groupBy("k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), packed.alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, joined again; words that are not in the bitmap keep all their lines."""
    def filled(w, i):
        before = F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before - 1), F.array(w["bits"]))

    def rest(dense):
        def stays(_, i):
            word = F.coalesce(F.get(dense, F.shiftright(i, 6)), F.lit(-1).cast("long"))
            return F.getbit(word, i % 64) == 1

        return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")

    return F.when(keep.isNull(), text).otherwise(bind(F.flatten(F.transform(keep, filled)), rest))


def _marked(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """The rows of ``docs`` as the struct ``row`` with their bitmap and the text that stays."""
    found = bitmaps(docs, doc_id, text, least)
    rows = docs.select(*_row(doc_id, text), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, ["k1", "k2"], "left").withColumn(
        "rest", kept_text(F.coalesce(F.col("row")[text], F.lit("")), F.col("keep")))


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the text that stays; a null text stays null."""
    marked = _marked(docs, doc_id, text, least)
    return marked.select(*[
        (F.when(F.col("row")[c].isNotNull(), F.col("rest")) if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row."""
    marked = _marked(docs.select("doc_id", "text"), "doc_id", "text", LEAST)
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.sha2("rest", 256).alias("kept_sha256"))
