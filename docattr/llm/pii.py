r"""Personal data: base patterns, and terms that disclose what the patterns protect.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. Protected entities are the
values found. How strongly a term t gives away an entity c is measured as in information-theoretic
sanitisation: PMI(c; t) = log(p(c, t) / (p(c) p(t))) against the information content IC(c) = -log p(c). Documents
are what is counted: N of them, n_c hold the entity, n_t the term, n_ct both, anywhere in their whole texts. As few
documents prove little, the term is counted in ``PRIOR`` more documents that lack the entity:
PMI = log(N n_ct / (n_c (n_t + PRIOR))). A share PMI / IC of 1 means that whoever reads t knows c; it
is approached as more documents show it. A term whose highest share over all entities reaches ``REMOVE`` is removed, one that reaches
``GENERALISE`` is replaced by its kind, wherever it stands in any text, near an entity or not. A word of one single document that holds an
entity reaches ``GENERALISE`` from 1024 documents on: it names that document, hence the entity.
Only built-in expressions, joins and grouped counts are used.

Entities of the same documents tell the same of every term, so they are counted as one class (known by the number and
the exclusive or of its documents' keys), and terms in too many documents to reach a share are dropped before terms
meet classes: n_t + PRIOR can be at most N (n_c / N) ** GENERALISE.

Patterns are written so that time stays linear in the text: a run of letters is entered at its start
only (or where the last match ended), and loops are possessive where backing up cannot help.

Defined cases: a null text is empty; rows are documents, so copies count as often as they occur;
equal rows get equal spans; null ids are kept; a base span that fails its check is dropped and its
text is not searched again; spans of different kinds may overlap, ``redact`` then replaces their union by the kind of the one
that starts first, the longer one on a tie; terms hold a letter, no digit and no ``@``, stand free between
blanks (any of the six ASCII ones), are compared in lower case and never touch a base span; an entity of all documents has
no information content and protects nothing; an empty table gives an empty result; other columns are kept by
``redact`` and ignored by ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.llm.urls import probed
from docattr.llm.words import row_keys, unpacked, whole_row
from docattr.operators.ordered import bind
from docattr.session import cut

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BLANK = r"[\x20\x09-\x0D]"
#: Documents without the entity that every term is counted in besides its own.
PRIOR = 1.0
GENERALISE = 0.9
REMOVE = 0.95
#: Shares are compared up to this.
NEARLY = 1e-9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            short = F.regexp_replace(part, "^0+", "")
            return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    d = _digits(m)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))


_FOUND = "array<struct<kind:int,value:string,start:int,stop:int>>"


def _find(text: Column, number: int) -> Column:
    """Valid matches of one kind and where they stand.

    The pieces between the matches give the positions: a match starts where the pieces and
    matches ahead of it end.
    """
    kind = KINDS[number]
    pattern = PATTERNS[kind]

    def placed(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            ends = F.aggregate(
                F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))),
                F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")),
                lambda s, x: F.struct(F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts"),
                                      (s["at"] + x["g"] + x["h"]).alias("at")),
                lambda s: s["starts"])

            def of(starts: Column) -> Column:
                def row(i: Column) -> Column:
                    hit, start = F.get(hits, i), F.get(starts, i)
                    return F.struct(
                        F.lit(number).alias("kind"), hit.alias("value"), start.alias("start"),
                        (start + F.length(hit)).alias("stop"))

                rows = F.transform(F.sequence(F.lit(0), F.size(hits) - 1), row)
                return F.filter(rows, lambda r: _valid(kind, r["value"]))

            return bind(ends, of)

        none = F.array().cast(_FOUND)
        return F.when(F.size(hits) > 0, bind(F.split(text, pattern, -1), with_gaps)).otherwise(none)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_FOUND)
    if NEEDS[kind]:
        return F.when(F.contains(text, F.lit(NEEDS[kind])), bind(hits, placed)).otherwise(none)
    return bind(hits, placed)


def base_spans(text: Column) -> Column:
    """All valid base matches, by start, then kind."""
    found = F.concat(*[_find(text, n) for n in range(len(KINDS))])
    return F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def _is_term(word: Column) -> Column:
    return word.rlike(r"\p{L}") & ~word.rlike("[0-9@]")


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), BLANK, -1))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.filter(_distinct_words(text), _is_term)


def found_in(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, its key k1, k2 (equal for equal rows), base spans, and the terms of the text if there are any."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), *row_keys("doc_id", "text"), text.alias("text"),
                       bind(base_spans(text), lambda s: s).alias("found"))
    return rows.withColumn("terms", F.when(F.size("found") > 0, _terms(F.col("text")))).drop("text")


def _classes(found: DataFrame) -> DataFrame:
    """(k1, k2, classes, most): what classes of entities (n_c, x1, x2) a document holds, and their largest n_c."""
    holds = F.array_distinct(F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    each = cut(found.select("k1", "k2", F.explode(holds).alias("e")).groupBy("e.kind", "e.value", "k1", "k2").agg(
        F.count(F.lit(1)).alias("copies")))
    entities = each.groupBy("kind", "value").agg(
        F.sum("copies").alias("n_c"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    return each.join(entities, ["kind", "value"]).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("n_c", "x1", "x2")).alias("classes"), F.max("n_c").alias("most"))


def disclosing(docs: DataFrame, found: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE) -> DataFrame:
    """(term, share): terms whose PMI with an entity reaches ``generalise`` of its information content, and the highest such share."""
    total = float(found.count())
    holders = found.filter(F.size("found") > 0)
    asked = cut(holders.select(F.explode("terms").alias("term")).distinct())
    if asked.isEmpty():
        return asked.withColumn("share", F.lit(None).cast("double"))
    classes = cut(_classes(holders))

    def most_documents(n_c: Column) -> Column:
        return F.lit(total) * F.pow(n_c / F.lit(total), F.lit(generalise)) * (1 + NEARLY) - prior

    # document frequencies of the holders' terms, counted map-side first; the filter knows terms only, so no other word is asked for
    everywhere = docs.select(F.explode(_distinct_words(F.coalesce("text", F.lit("")))).alias("term"))
    seen = probed(everywhere, "term", asked).filter("maybe").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    limit = classes.agg(most_documents(F.max("most")).alias("n")).scalar()
    rare = cut(seen.filter(F.col("n_t") <= limit))
    terms = probed(holders.select("k1", "k2", F.explode("terms").alias("term")), "term", rare).filter("maybe").join(rare, "term")
    met = terms.join(classes, ["k1", "k2"]).filter(F.col("n_t") <= most_documents(F.col("most")))
    pairs = met.select("term", "n_t", F.explode("classes").alias("c")).select("term", "n_t", "c.*")
    counted = pairs.filter((F.col("n_t") <= most_documents(F.col("n_c"))) & (F.col("n_c") < total)).groupBy(
        "term", "n_t", "n_c", "x1", "x2").agg(F.count(F.lit(1)).alias("n_ct"))
    share = F.log2(total * F.col("n_ct") / (F.col("n_c") * (F.col("n_t") + prior))) / F.log2(total / F.col("n_c"))
    return counted.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= generalise - NEARLY)


def _placed(text: Column, hits: Column) -> Column:
    """(start, stop, action) of the words with the given numbers: from one to the next the lengths between them are added up."""
    def over(pieces: Column) -> Column:
        def step(s: Column, h: Column) -> Column:
            between = F.slice(pieces, s["place"] + 1, h["place"] - s["place"])
            start = F.aggregate(between, s["at"], lambda n, w: n + F.length(w) + 1)
            span = F.struct(start.alias("start"), (start + h["size"]).alias("stop"), h["action"].alias("action"))
            return F.struct(F.concat(s["out"], F.array(span)).alias("out"), start.alias("at"), h["place"].alias("place"))

        none = F.array().cast(_SPANS)
        return F.aggregate(hits, F.struct(none.alias("out"), F.lit(0).alias("at"), F.lit(0).alias("place")), step, lambda s: s["out"])

    return bind(F.split(text, BLANK, -1), over)


_SPANS = "array<struct<start:int,stop:int,action:string>>"


def occurrences(docs: DataFrame, told: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(k1, k2, terms): every place of the ``told`` terms in the texts that hold any; equal rows once.

    Words are filtered where they are read; only those that may be told are moved, and only texts with one.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = docs.select(*row_keys("doc_id", "text"), F.posexplode(F.split(text, BLANK, -1)).alias("place", "word")).withColumn("term", F.lower("word"))
    action = F.when(F.col("share") >= remove - NEARLY, "remove").otherwise("generalise").alias("action")
    hits = probed(pieces, "term", told.select("term")).filter("maybe").join(told, "term")
    hits = cut(hits.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("place", F.length("word").alias("size"), action))).alias("hits")))
    texts = probed(docs.select(*row_keys("doc_id", "text"), text.alias("text")), "k1", hits.select("k1")).filter("maybe").drop("maybe")
    return texts.join(hits, ["k1", "k2"]).select("k1", "k2", _placed(F.col("text"), F.col("hits")).alias("terms")).dropDuplicates(["k1", "k2"])


def spans(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, k1, k2, base, terms): base spans, and the spans of disclosing terms with what becomes of them."""
    found = cut(found_in(docs))
    told = cut(disclosing(docs, found, prior, generalise))
    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    rows, none = found.select("doc_id", "k1", "k2", base.alias("base")), F.array().cast(_SPANS)
    if told.isEmpty():
        return rows.withColumn("terms", none)
    return rows.join(occurrences(docs, told, remove), ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", none))


def described(found: Column) -> Column:
    """kind:start:end of (kind, start, stop) structs, joined by commas; kinds by number, terms last."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Counts per kind, a digest of the base spans and all spans of every row."""
    rows = spans(docs, prior, generalise, remove)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    added = F.transform("terms", lambda t: F.struct(F.lit(len(KINDS)).alias("kind"), t["start"].alias("start"), t["stop"].alias("stop")))
    every = F.array_sort(F.concat("base", added), lambda a, b: F.when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return rows.select("doc_id", *counts, F.sha2(described(F.col("base")), 256).alias("base_sha256"),
                       described(every).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def redact(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with base spans replaced by ``[KIND]``, disclosing terms by ``[TERM]`` or nothing.

    Only documents that may hold spans, by a filter of their keys, are moved and joined with them; the others pass as they are.
    """
    rows = spans(docs, prior, generalise, remove).filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["k1", "k2"])
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cuts = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), F.get(labels, s["kind"]).alias("by"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["stop"]).alias("less"), F.when(
            t["action"] == "remove", "").otherwise(f"[{TERM.upper()}]").alias("by"))))
    rows = cut(rows.select("k1", "k2", F.array_sort(cuts).alias("_cuts")))
    # texts without a span need not move
    marked = probed(docs.select(*row_keys("doc_id", "text"), whole_row(docs)), "k1", rows.select("k1"))
    joined = marked.filter("maybe").join(rows, ["k1", "k2"], "left")
    text = F.col("row.text")

    def step(s: Column, c: Column) -> Column:
        fits = c["start"] >= s["at"]
        piece = F.concat(F.substring(text, s["at"] + 1, c["start"] - s["at"]), c["by"])
        return F.struct(F.when(fits, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"),
                        F.greatest(s["at"], -c["less"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("_cuts", start, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    done = joined.select(*unpacked(docs, text=F.when(F.col("_cuts").isNull(), text).otherwise(clean)))
    return marked.filter("NOT maybe").select(*unpacked(docs)).unionByName(done)
