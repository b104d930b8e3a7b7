"""Name rosters, mention finding and anonymisation.

All names of a document are found in one pass over each of its lines, by an automaton of its roster. Offsets count code points. A mention needs a non-word character or a text end on both
sides and uses those characters up, so of two adjacent repeats only the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions import names as nm
from docattr.functions import text as tx
from docattr.operators.ordered import bind, first_k, global_index, offsets
from docattr.session import cut


def mention_pattern(aliases: Column) -> Column:
    names = F.array_join(F.transform(aliases, tx.regex_quote), "|")
    return F.concat(F.lit(f"(^|{tx.NON_WORD})("), names, F.lit(f")({tx.NON_WORD}|$)"))


def name_roster(occurrences: DataFrame, key: str, name: str, k: int, min_count: int = 2) -> DataFrame:
    """Names of a document that occur at least ``min_count`` times, the k most frequent."""
    counts = occurrences.groupBy(key, name).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    return first_k(counts, [key], [F.col("n").desc(), name], k).select(key, name)


def word_roster(texts: DataFrame, key: str, words: Column, k: int, min_count: int = 2) -> DataFrame:
    """``name_roster`` of the words of texts, given as an array, written out because several branches read it.

    A word that occurs once in the only text of its key is dropped where the text is, so few words are shuffled. Keys of
    several texts, null as one, keep all words.
    """
    listed = texts.select(key, words.alias("_words"))
    if min_count > 1:
        several = cut(texts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")))
        again = bind(F.sort_array("_words"), lambda ws: F.filter(
            ws, lambda w, i: (w == F.get(ws, i - 1)) | (w == F.get(ws, i + 1))))
        if several.isEmpty():
            listed = listed.select(key, again.alias("_words"))
        else:
            flagged = listed.join(several.withColumn("_all", F.lit(True)), F.col(key).eqNullSafe(F.col("_key")), "left")
            listed = flagged.select(key, F.when(F.col("_all"), F.col("_words")).otherwise(again).alias("_words"))
    return cut(name_roster(listed.select(key, F.explode("_words").alias("entity")), key, "entity", k, min_count))


def pack_roster(roster: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """One row per document with its roster and the JSON of its spellings; a roster is bounded by the cast size.

    Written out, because the join with the texts should know its size: small rosters are
    broadcast to the texts, never the texts to the rosters, and large ones are shuffled.
    """
    fields = [F.col("entity"), F.col("aliases"), *[F.col(c) for c in extra or []]]
    packed = roster.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("roster"))
    return cut(packed.withColumn("names", F.to_json(F.col("roster.aliases"))))


# Noncharacters reserved for internal use; they mark where a match and its parts begin.
MARKED = "\ufdd0$1\ufdd1$2\ufdd2$3\ufdd3"


def _scan(text: Column, pattern: Column) -> Column:
    """Text before the first match, then (boundary, name, boundary, text up to the next match) per
    match. The pattern differs per row, so it is run once and the rest is cut at fixed marks."""
    return F.split(F.regexp_replace(text, pattern, F.lit(MARKED)), "\ufdd0")


def _spans(scan: Column) -> Column:
    """Regex parts -> array<struct<start,end,text>>."""
    n = F.size(scan) - 1
    fields = F.transform(F.slice(scan, F.lit(2), n), lambda p: F.split(p, "[\ufdd1-\ufdd3]"))
    sizes = F.transform(scan, lambda p: F.length(p))

    def build(x):
        # three marks per match are not part of the text
        widths = F.transform(x["sizes"], lambda w, i: F.when(i > 0, w - 3).otherwise(w))
        begins = F.slice(offsets(widths, 0), F.lit(2), F.size(x["fields"]))

        def span(f, at):
            start = at + F.length(F.get(f, F.lit(0)))
            name = F.get(f, F.lit(1))
            return F.struct(start.alias("start"), (start + F.length(name)).alias("end"), name.alias("text"))

        return F.zip_with(x["fields"], begins, span)

    return bind(F.struct(fields.alias("fields"), sizes.alias("sizes")), build)


def mention_spans(text: Column, pattern: Column) -> Column:
    """All mentions of one pattern in a text; the automaton finds the same."""
    return F.flatten(F.transform(F.array(_scan(text, pattern)), _spans))


def roster_mentions(text: Column, roster: Column, names: Column, extra: list[str] | None = None, first_only: bool = False) -> Column:
    """array<struct<entity,start,end,text,...>> of every roster entry, sorted by start, longest first."""
    def named(m):
        entry = F.get(roster, m["entry"])
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), entry["entity"].alias("entity"), m["text"].alias("text"),
            *[entry[c].alias(c) for c in extra or []])

    return F.transform(nm.mentions(text, names, first_only), named)


def find_mentions(segments: DataFrame, roster: DataFrame, key: str = "doc_id", first_only: bool = False) -> DataFrame:
    """(key, seg_no, entity, start, end, text): one pass over every segment, however many names there are."""
    joined = segments.join(pack_roster(roster, key), key)
    rows = joined.select(key, "seg_no", F.explode(
        roster_mentions(F.col("text"), F.col("roster"), F.col("names"), first_only=first_only)).alias("m"))
    return rows.select(key, "seg_no", "m.entity", "m.start", "m.end", "m.text")


def find_utterances(segments: DataFrame, roster: DataFrame, key: str = "doc_id") -> DataFrame:
    """First mention of each entity in the speaker text of a segment."""
    return find_mentions(segments, roster, key, first_only=True)


def assign_codes(roster: DataFrame, known: DataFrame, key: str, prefix: str = "CHARACTER") -> DataFrame:
    """Roster with the anonymous code of each entity; entities without an id get the next numbers."""
    joined = roster.join(known.select(key, "entity", "number"), [key, "entity"], "left")
    top = known.agg(F.coalesce(F.max("number"), F.lit(-1))).scalar()
    have = joined.filter("number IS NOT NULL")
    fresh = global_index(joined.filter("number IS NULL").drop("number"), [key, "entity"], "number")
    fresh = fresh.withColumn("number", F.col("number") + top + 1)
    both = have.unionByName(fresh)
    return both.withColumn("code", tx.padded_id(prefix, F.col("number"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))))).drop("number")


def drop_overlaps(mentions: Column) -> Column:
    """Left to right, mentions that start before the previous kept one ends are dropped."""
    empty = F.slice(mentions, 1, 0)
    start = F.struct(empty.alias("kept"), F.lit(-1).alias("end"))

    def step(s, m):
        take = m["start"] >= s["end"]
        return F.struct(
            F.when(take, F.concat(s["kept"], F.array(m))).otherwise(s["kept"]).alias("kept"),
            F.when(take, m["end"]).otherwise(s["end"]).alias("end"),
        )

    return F.aggregate(mentions, start, step, lambda s: s["kept"])


def replace_mentions(text: Column, mentions: Column, code: str = "code") -> Column:
    """struct(text, mentions) with disjoint sorted mentions replaced by their code."""

    def build(x):
        t, ms = x["t"], x["m"]

        def piece(m, i):
            begin = F.when(i > 0, F.get(ms, i - 1)["end"]).otherwise(F.lit(0))
            return F.struct(F.substring(t, begin + 1, m["start"] - begin).alias("gap"), m.alias("m"))

        def assemble(p):
            at = offsets(F.transform(p, lambda q: F.length(q["gap"]) + F.length(q["m"][code])), 0)
            tail = F.when(F.size(ms) > 0, F.element_at(ms, -1)["end"]).otherwise(F.lit(0))
            body = F.array_join(F.transform(p, lambda q: F.concat(q["gap"], q["m"][code])), "")

            def moved(q, at_i):
                begin = at_i + F.length(q["gap"])
                end = begin + F.length(q["m"][code])
                return F.struct(q["m"]["entity"].alias("entity"), begin.alias("start"), end.alias("end"), q["m"][code].alias("text"))

            return F.struct(
                F.concat(body, F.substring(t, tail + 1, F.length(t))).alias("text"),
                F.zip_with(p, at, moved).alias("mentions"))

        return bind(F.transform(ms, piece), assemble)

    return bind(F.struct(text.alias("t"), mentions.alias("m")), build)


def anonymize(segments: DataFrame, coded_roster: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments with every mention replaced by its code, and the rewritten mentions as an array."""
    packed = pack_roster(coded_roster, key, ["code"])
    joined = segments.join(packed, key, "left")
    found = joined.withColumn("_found", roster_mentions(F.col("text"), F.col("roster"), F.col("names"), ["code"]))
    new = bind(drop_overlaps(F.col("_found")), lambda k: F.when(F.size(k) > 0, replace_mentions(F.col("text"), k)))
    return found.withColumn("_new", new).select(
        key, "seg_no", F.coalesce("_new.text", "text").alias("text"), F.col("_new.mentions").alias("mentions"))


def anonymize_simple(segments: DataFrame, coded_roster: DataFrame, key: str = "doc_id") -> DataFrame:
    return anonymize(segments, coded_roster, key).drop("mentions")


def match_report(roster: DataFrame, mentions: DataFrame, utterances: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per entity the number of mentions and utterances, zeros included, and whether anything matched."""
    def counted(df, name):
        return df.groupBy(key, "entity").agg(F.count(F.lit(1)).alias(name))

    out = roster.select(key, "entity").distinct()
    for df, name in ((mentions, "n_mentions"), (utterances, "n_utterances")):
        out = out.join(counted(df, name), [key, "entity"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("matched", (F.col("n_mentions") > 0) | (F.col("n_utterances") > 0))


def alias_report(roster: DataFrame, mentions: DataFrame, utterances: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entity, alias, matched): whether a spelling of an entity was found at all."""
    spelled = roster.select(key, "entity", F.explode("aliases").alias("alias")).distinct()
    hits = mentions.select(key, "entity", F.col("text").alias("alias")).unionByName(
        utterances.select(key, "entity", F.col("text").alias("alias"))).distinct().withColumn("_hit", F.lit(True))
    return spelled.join(hits, [key, "entity", "alias"], "left").select(
        key, "entity", "alias", F.coalesce("_hit", F.lit(False)).alias("matched"))


def match_totals(report: DataFrame) -> DataFrame:
    """One row for the corpus: entities, those with mentions and those with utterances, and the counts of both."""
    return report.agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n_mentions") > 0).alias("with_mentions"),
        F.count_if(F.col("n_utterances") > 0).alias("with_utterances"), F.sum("n_mentions").alias("n_mentions"),
        F.sum("n_utterances").alias("n_utterances"))
