"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffled order, served ``epochs`` times
over. A document's virtual finish time is the number of words its source has served when the
document ends, divided by the source's target. Served in the order of finish times, all
sources advance in proportion to their targets at any moment of the stream; the stream ends
where the total budget is used up. Running sums are taken over ranges of the order, so a
source with a third of all rows is spread over many tasks. No Python runs on the executors.

Defined cases: a null text has size 0; a null source is a source of its own, after all others;
documents of size 0 and null ids take part and take 0 words; rows are documents, so repeated
rows are queued as often as they occur; ties of finish time go by source and queue position;
an empty table gives an empty result; other columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions.draws import key_hash
from docattr.llm.words import GAP, WORD, row_keys, unpacked, whole_row, word_count
from docattr.operators.ordered import global_index, running_totals
from docattr.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 17


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, rank): words each source gives.

    ``weights`` go to the sources in code point order, repeating. The budget is ``share`` of all
    words; no target exceeds ``epochs`` times its source, and what is above is reshared by
    weight among the others. With the sources ordered by cap over weight, the capped ones are
    a prefix, so one pass of running sums finds the common level of the rest.
    """
    by_source = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = global_index(by_source, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).scalar()
    weight_sum = ranked.agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("n")).scalar()
    summed = running_totals(ranked, ["_ratio", "rank"], {"_caps": F.col("_cap"), "_ws": F.col("_w")})
    level = (total * F.lit(share) - (F.col("_caps") - F.col("_cap"))) / (weight_sum - (F.col("_ws") - F.col("_w")))
    levels = summed.withColumn("_level", level).filter("_level < _ratio")
    first = levels.agg(F.min(F.struct("_ratio", "rank", "_level"))["_level"].alias("level")).scalar()
    return summed.select("source", "source_size", F.least("_cap", F.col("_w") * first).alias("target"), "rank")


def _queued(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with the words their source has served when the row's first service ends (``_hi``)."""
    keyed = rows.withColumn("_h", key_hash(seed, "doc_id"))
    queue = running_totals(keyed, ["_h", F.col("doc_id"), F.col("size")], {"_hi": F.col("size")}, ["source"])
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "rank")
    return queue.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _stream(queue: DataFrame, share: float, epochs: int) -> DataFrame:
    """One row per document and epoch with the words it gives and where they start in the mix."""
    served = F.col("_hi") + F.col("epoch") * F.col("source_size")
    quota = F.ceil("target")
    each = queue.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)]))).withColumn(
        "_words", F.greatest(F.lit(0), F.least(F.col("size"), quota - (served - F.col("size"))))
    )
    # the last document of a source ends where its quota ends
    finish = F.when(F.col("target") > 0, F.least(served, quota) / F.col("target")).otherwise(F.lit(0.0))
    each = each.withColumn("_finish", finish)
    order = ["_finish", "rank", "epoch", "_hi", "_h", "size"]
    budget = F.floor(queue.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).scalar() * F.lit(share))
    timed = running_totals(each, order, {"_end": F.col("_words")})
    start = F.col("_end") - F.col("_words")
    return timed.withColumn("position", start).withColumn(
        "words", F.greatest(F.lit(0), F.least(F.col("_words"), budget - start)).cast("long"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
         seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Per document (row): doc_id, source, size, source_size, target, taken, position and ``keep``.

    ``taken`` counts the words the mix takes from it, repeats included; ``position`` is the
    number of words ahead of its first one in the mix (null where nothing is taken).
    """
    keep = [c for c in keep if c not in ("doc_id", "source", "size")]
    rows = cut(docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size")))
    targets = cut(source_targets(rows, weights, share, epochs))
    stream = _stream(_queued(rows, targets, seed), share, epochs)
    one = ["doc_id", "source", *keep, "size", "source_size", "target", "_hi"]
    taken = F.sum("words").alias("taken")
    position = F.min(F.when(F.col("words") > 0, F.col("position"))).alias("position")
    copies = F.count(F.when(F.col("epoch") == 0, 1)).alias("_n")  # over 1 only for repeated rows of size 0
    out = stream.groupBy(*one).agg(taken, position, copies)
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.drop("_n", "_hi")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: int = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` that the mix serves, once per epoch served.

    A document that its source's quota or the budget cuts ends after its last served word.
    Documents without words are not served. The columns are those of ``docs``; equal rows
    share what the mix takes from them together.
    """
    keys = row_keys("doc_id", "source", "text")
    shares = plan(docs.select("doc_id", "source", "text", *keys), weights, share, epochs, seed, keep=["k1", "k2"]).filter("taken > 0")
    shares = shares.groupBy("k1", "k2").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    # equal rows are merged where they lie, and the texts are moved once: the join keeps the aggregate's partitioning
    rows = docs.select(*keys, whole_row(docs)).dropDuplicates(["k1", "k2"]).join(shares, ["k1", "k2"])
    whole = F.array_repeat(F.lit(0).cast("long"), (F.col("taken") / F.col("size")).cast("int"))
    rest = F.col("taken") % F.col("size")
    rows = rows.withColumn("cut", F.explode(F.concat(whole, F.when(rest > 0, F.array(rest)).otherwise(F.array()))))
    text = F.col("row.text")
    return rows.select(*unpacked(docs, text=F.when(F.col("cut") > 0, first_words(text, F.col("cut"))).otherwise(text)))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word; the possessive loop does not recurse."""
    pattern = F.concat(F.lit(f"^(?:(?:{GAP})?+{WORD}+){{"), n.cast("string"), F.lit("}+"))
    return F.regexp_substr(text, pattern)
