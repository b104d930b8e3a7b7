"""Labelled lines -> script segments; texts -> typed tokens. All work stays inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions.text import ascii_fold, squeeze
from docattr.operators.ordered import bind, offsets

# Run grammar over line tags (slugline, description, speaker + speech).
RUNS = r"(S+)|(N+)|((C+)([EDX]+))"


def script_segments(lines: Column, tags: Column, drop_tail: bool = False) -> Column:
    """array<struct<kind,text,speaker>> of the non-blank segments in reading order.

    ``tags`` is one letter per line. Lines between two runs, and after the last one unless
    ``drop_tail``, become an ``other`` segment.
    """
    folded = F.translate(tags, "OTM", "XXX")

    def kind(run):
        return F.when(run.startswith("S"), "slugline").when(run.startswith("N"), "desc").otherwise("utter")

    def other(run):
        return F.struct(F.lit("other").alias("kind"), run.alias("run"))

    def pieces(x):
        paired = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["runs"])), x["runs"], lambda g, r: F.array(
            other(g), F.struct(kind(r).alias("kind"), r.alias("run"))))
        parts = F.flatten(paired)
        if not drop_tail:
            parts = F.concat(parts, F.array(other(F.element_at(x["gaps"], -1))))
        return F.filter(parts, lambda p: p["run"] != "")

    def texts(x):
        def text(start, n):
            return squeeze(ascii_fold(F.array_join(F.slice(x["lines"], start + 1, n), " ")))

        def build(p, start):
            cue = F.length(F.regexp_extract(p["run"], "^(C+)", 1))
            return F.struct(
                p["kind"].alias("kind"), text(start, F.length(p["run"])).alias("text"),
                F.when(p["kind"] == "utter", text(start, cue)).otherwise("").alias("speaker"),
            )

        starts = offsets(F.transform(x["parts"], lambda p: F.length(p["run"])), 0)
        return F.filter(F.zip_with(x["parts"], starts, build), lambda s: s["text"] != "")

    scanned = F.struct(F.regexp_extract_all(folded, F.lit(RUNS), 0).alias("runs"), F.split(folded, RUNS, -1).alias("gaps"))
    return bind(F.struct(lines.alias("lines"), bind(scanned, pieces).alias("parts")), texts)


def segment_table(docs: DataFrame, key: str, lines: Column, tags: Column, drop_tail: bool = False) -> DataFrame:
    """(key, seg_no, segment_id, kind, text, speaker)."""
    rows = docs.select(key, F.posexplode(script_segments(lines, tags, drop_tail)).alias("seg_no", "s"))
    return rows.select(
        key, "seg_no", F.concat_ws("-", F.col(key).cast("string"), "s.kind", F.col("seg_no").cast("string")).alias("segment_id"),
        "s.kind", "s.text", "s.speaker",
    )


# --- typed tokens and negation cues ---------------------------------------------------------

TAG = r"<attr value=[^>]*+>[^<]*+</attr>"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# possessive loops: a loop over a group that may back up recurses once per round and overflows the stack
SENTENCE = rf"(?:{TAG}|[^.!?<]++|<)++[.!?]*+|[.!?]++"

# Words that signal that an attribute is named as an opposite.
CUES = ["contrast", "opposite", "not", "never", "nor", "inverse", "conflict", "conflicts", "unlike", "different",
        "inversion", "counterpart", "difference", "counterparts", "differences", "opposites"]
SKIPPED = ["and", ","]


def typed_sentences(text: Column, typed_words: list[str] | None = None) -> Column:
    """array of sentences, each an array<struct<tok,type>>; type is ``token`` or an attribute.

    Attributes come from marked links, or from a word list for texts without marks.
    """

    def tokens(sentence):
        items = F.regexp_extract_all(sentence, F.lit(rf"{TAG}|{TOKEN}"), 0)

        def expand(item):
            value = F.element_at(F.split(F.regexp_extract(item, r"^<attr value=([^>]*)>", 1), "/"), -1)
            inner = F.regexp_extract_all(F.regexp_extract(item, r"^<attr value=[^>]*>([^<]*)<", 1), F.lit(TOKEN), 0)
            plain = F.when(item.isin(typed_words), item).otherwise("token") if typed_words else F.lit("token")
            return F.when(
                item.startswith("<attr value="),
                F.transform(inner, lambda t: F.struct(t.alias("tok"), value.alias("type"))),
            ).otherwise(F.array(F.struct(item.alias("tok"), plain.alias("type"))))

        return F.flatten(F.transform(items, expand))

    return F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), tokens)


def token_table(docs: DataFrame, key: str, text: Column, typed_words: list[str] | None = None) -> DataFrame:
    """(key, sent, pos, tok, type)."""
    sents = docs.select(key, F.posexplode(typed_sentences(text, typed_words)).alias("sent", "s"))
    return sents.select(key, "sent", F.posexplode("s").alias("pos", "t")).select(key, "sent", "pos", "t.tok", "t.type")


def cued_attributes(sentences: Column, cues: list[str] | None = None, window: int = 5) -> Column:
    """Sorted attributes with a cue among the nearest ``window`` distinct plain tokens on either side."""
    cue_set = F.array(*[F.lit(c) for c in (cues or CUES)])

    def near(tokens):
        plain = F.filter(tokens, lambda t: (t["type"] == "token") & ~t["tok"].isin(SKIPPED))
        return F.slice(F.array_distinct(F.transform(plain, lambda t: F.lower(t["tok"]))), 1, window)

    def in_sentence(s):
        def starts_run(t, i):
            before = F.when(i > 0, F.get(s, i - 1)["type"])
            return (t["type"] != "token") & (before.isNull() | (before != t["type"]))

        numbered = F.transform(s, lambda t, i: F.struct(t["type"].alias("type"), i.alias("i"), starts_run(t, i).alias("first")))

        def cued(r):
            # tokens of the run itself are typed, so the right side may start at the run
            left = near(F.reverse(F.slice(s, F.lit(1), r["i"])))
            right = near(F.slice(s, r["i"] + 1, F.size(s)))
            return F.arrays_overlap(left, cue_set) | F.arrays_overlap(right, cue_set)

        return F.transform(F.filter(numbered, lambda r: r["first"] & cued(r)), lambda r: r["type"])

    return F.array_sort(F.array_distinct(F.flatten(F.transform(sentences, in_sentence))))
