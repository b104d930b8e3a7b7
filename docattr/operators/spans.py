"""Paragraphs, contexts and their spans, held as arrays in the row of one (entity, document).

Nothing here shuffles: a row holds the lines of one document, so memory is bounded by a
document and the text is moved at most once, by the join that brings in the roster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions import names as nm
from docattr.functions import text as tx
from docattr.operators import mentions as mn
from docattr.operators.ordered import bind, budget_prefix, keep_where, offsets, order_for, pack_min


def shift(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def join_parts(parts: Column, delimiter: str) -> Column:
    """array<struct<text,spans>> -> struct(text, spans) joined by a delimiter, spans rebased."""

    def build(p):
        starts = offsets(F.transform(p, lambda x: F.length(x["text"])), len(delimiter))
        spans = F.flatten(F.zip_with(p, starts, lambda x, at: shift(x["spans"], at)))
        return F.struct(F.array_join(F.transform(p, lambda x: x["text"]), delimiter).alias("text"), spans.alias("spans"))

    return bind(parts, build)


def clean_between_spans(text: Column, spans: Column) -> Column:
    """White space runs before and between spans become one blank; text after the last span stays."""

    def build(x):
        t, ss = x["t"], x["s"]

        def gap(s, i):
            begin = F.when(i > 0, F.get(ss, i - 1)["end"]).otherwise(F.lit(0))
            return F.regexp_replace(F.substring(t, begin + 1, s["start"] - begin), r"\s+", " ")

        pieces = F.transform(ss, lambda s, i: F.struct(
            gap(s, i).alias("gap"), F.substring(t, s["start"] + 1, s["end"] - s["start"]).alias("name")))

        def assemble(p):
            at = offsets(F.transform(p, lambda q: F.length(q["gap"]) + F.length(q["name"])), 0)
            tail = F.when(F.size(ss) > 0, F.element_at(ss, -1)["end"]).otherwise(F.lit(0))
            body = F.array_join(F.transform(p, lambda q: F.concat(q["gap"], q["name"])), "")

            def moved(q, at_i):
                begin = at_i + F.length(q["gap"])
                return F.struct(begin.alias("start"), (begin + F.length(q["name"])).alias("end"))

            return F.struct(
                F.concat(body, F.substring(t, tail + 1, F.length(t))).alias("text"),
                F.zip_with(p, at, moved).alias("spans"),
            )

        return bind(pieces, assemble)

    return bind(F.struct(text.alias("t"), spans.alias("s")), build)


def entity_rows(docs: DataFrame, roster: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entity, parts): per document and entity the lines that mention it, with their number and spans.

    The lines of a document are scanned once for all its entities, and only those with a mention are copied.
    """
    joined = docs.select(key, text).join(mn.pack_roster(roster, key), key)
    rows = joined.select(key, "roster", F.explode(nm.parts(F.col(text), F.col("names"))).alias("_p"))
    return rows.select(key, F.get("roster", F.col("_p.entry"))["entity"].alias("entity"), F.col("_p.parts").alias("parts"))


def paragraphs(rows: DataFrame, clean: bool = True) -> DataFrame:
    """Adjacent lines that mention the entity become one paragraph with rebased spans."""
    def build(p):
        # lines with consecutive numbers are a run, which ends where the next begins
        begins = F.transform(p, lambda x, i: F.when((i == 0) | (x["no"] != F.get(p, i - 1)["no"] + 1), i))

        def paragraph(run):
            joined = join_parts(run, " ")
            return bind(joined, lambda j: clean_between_spans(j["text"], j["spans"])) if clean else joined

        def cut_at(b):
            return F.transform(b, lambda lo, k: paragraph(F.slice(p, lo + 1, F.coalesce(F.get(b, k + 1), F.size(p)) - lo)))

        return bind(F.filter(begins, lambda i: i.isNotNull()), cut_at)

    return rows.withColumn("paragraphs", bind(F.col("parts"), build)).drop("parts")


def entity_segments(rows: DataFrame) -> DataFrame:
    """All paragraphs of an entity in a document as one newline-joined text with spans."""
    joined = join_parts(F.col("paragraphs"), "\n")
    kept = keep_where(paragraphs(rows), "_j", joined, lambda j: F.size(j["spans"]) > 0)
    return kept.select("*", "_j.text", "_j.spans").drop("_j", "paragraphs")


def split_paragraphs(text: Column, spans: Column, min_words: int) -> Column:
    """Text -> array<struct<text,spans,words>>: lines packed to a minimum size, spans inside each, rebased.

    Paragraph starts and spans are sorted together once: a paragraph's spans are those between its start and
    the next one. A span may end exactly at the paragraph end.
    """

    def build(x):
        lines = x["lines"]
        groups = pack_min(F.transform(lines, tx.word_count), min_words)
        starts = offsets(F.transform(lines, lambda t: F.length(t)), 1)

        def numbered(y):
            # lines at which a group begins; groups are runs, so each ends where the next begins
            begins = F.transform(y["g"], lambda g, i: F.when((i == 0) | (g != F.get(y["g"], i - 1)), i))

            def placed(firsts):
                los = F.transform(firsts, lambda f: F.get(y["at"], f))
                marks = F.concat(
                    F.transform(los, lambda lo: F.struct(lo.alias("at"), F.lit(0).alias("kind"))),
                    F.transform(x["spans"], lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("kind"))))
                places = F.transform(F.array_sort(marks), lambda m, i: F.when(m["kind"] == 0, i))
                return F.struct(firsts.alias("f"), F.filter(places, lambda i: i.isNotNull()).alias("p"))

            def cut_at(z):
                def part(first, k):
                    n = F.coalesce(F.get(z["f"], k + 1), F.size(y["g"])) - first
                    # spans before this paragraph and before the next one
                    before = F.get(z["p"], k) - k
                    until = F.coalesce(F.get(z["p"], k + 1) - k - 1, F.size(x["spans"]))
                    here = F.slice(x["spans"], before + 1, until - before)
                    return bind(F.struct(
                        F.array_join(F.slice(lines, first + 1, n), "\n").alias("t"), F.get(y["at"], first).alias("lo"), here.alias("s")), inner)

                return F.transform(z["f"], part)

            def inner(w):
                inside = F.filter(w["s"], lambda s: s["end"] <= w["lo"] + F.length(w["t"]))
                return F.struct(w["t"].alias("text"), shift(inside, -w["lo"]).alias("spans"), tx.word_count(w["t"]).alias("words"))

            return bind(bind(F.filter(begins, lambda i: i.isNotNull()), placed), cut_at)

        return bind(F.struct(groups.alias("g"), starts.alias("at")), numbered)

    return bind(F.struct(F.split(text, "\n").alias("lines"), F.array_sort(spans).alias("spans")), build)


def build_context(parts: Column, order: Column, budget: int) -> Column:
    """struct(text, spans, taken) of the paragraphs that fit the budget in the given order, read in text order."""

    def pick(x):
        sizes = F.transform(x["order"], lambda i: F.get(x["parts"], i)["words"])
        taken = F.array_sort(F.slice(x["order"], F.lit(1), budget_prefix(sizes, budget)))

        def merge(t):
            joined = join_parts(F.transform(t, lambda i: F.get(x["parts"], i)), "\n")
            return bind(joined, lambda j: F.struct(j["text"].alias("text"), j["spans"].alias("spans"), F.size(t).alias("taken")))

        return bind(taken, merge)

    return bind(F.struct(parts.alias("parts"), order.alias("order")), pick)


def contexts(segments: DataFrame, key: str, min_words: int, budget: int, strategy: str, seed: int = 2050) -> DataFrame:
    """Budgeted context per (entity, document) from its segment text and spans."""
    parts = segments.withColumn("_parts", split_paragraphs(F.col("text"), F.col("spans"), min_words))
    order = order_for(strategy, F.size("_parts"), F.concat_ws("|", F.col(key).cast("string"), "entity"), seed)
    picked = parts.withColumn("_c", build_context(F.col("_parts"), order, budget))
    return picked.select(
        key, "entity", F.col("_c.text").alias("text"), F.col("_c.spans").alias("spans"), F.col("_c.taken").alias("taken"),
        (F.size("_parts") - F.col("_c.taken")).alias("excluded"))


def spans_inside(text: Column, spans: Column) -> Column:
    """The texts the spans point at."""
    return F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


def entity_mask(text: Column, spans: Column, name: Column, tokenize) -> Column:
    """struct(tokens, mask): tokens of the name, then of the text cut at the spans; 1 on name tokens."""

    def build(x):
        t, ss = x["t"], x["s"]

        def cut(s, i):
            begin = F.when(i > 0, F.get(ss, i - 1)["end"]).otherwise(F.lit(0))
            outside = tokenize(F.substring(t, begin + 1, s["start"] - begin))
            inside = tokenize(F.substring(t, s["start"] + 1, s["end"] - s["start"]))
            return F.array(F.struct(outside.alias("t"), F.lit(0).alias("m")), F.struct(inside.alias("t"), F.lit(1).alias("m")))

        tail = F.when(F.size(ss) > 0, F.element_at(ss, -1)["end"]).otherwise(F.lit(0))
        pieces = F.concat(
            F.array(F.struct(tokenize(name).alias("t"), F.lit(1).alias("m"))),
            F.flatten(F.transform(ss, cut)),
            F.array(F.struct(tokenize(F.substring(t, tail + 1, F.length(t))).alias("t"), F.lit(0).alias("m"))),
        )
        return bind(pieces, lambda p: F.struct(
            F.flatten(F.transform(p, lambda q: q["t"])).alias("tokens"),
            F.flatten(F.transform(p, lambda q: F.array_repeat(q["m"], F.size(q["t"])))).alias("mask"),
        ))

    return bind(F.struct(text.alias("t"), spans.alias("s")), build)
