"""Documents and a roster -> budgeted contexts. Only the packed roster is written on the way, when the plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.operators import spans as sp
from docattr.operators.ordered import budget_totals, order_for


def entity_segments(docs: DataFrame, roster: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity, text, spans): all paragraphs in which an entity is mentioned."""
    return sp.entity_segments(sp.entity_rows(docs, roster, key, text))


def entity_contexts(
    docs: DataFrame, roster: DataFrame, budget: int, min_words: int = 25, strategy: str = "first",
    key: str = "doc_id", text: str = "text", seed: int = 2050,
) -> DataFrame:
    """(key, entity, text, spans, taken, excluded) within ``budget`` words."""
    return sp.contexts(entity_segments(docs, roster, key, text), key, min_words, budget, strategy, seed)


def context_lengths(
    segments: DataFrame, strategies: list[str], budgets: list[int], min_words: int = 25, key: str = "doc_id", seed: int = 2050,
) -> DataFrame:
    """(key, entity, strategy, budget, words): the words of every context, without building a text.

    The paragraphs of an entity are cut once, and a strategy's running sum answers all budgets.
    """
    parts = segments.select(key, "entity", sp.split_paragraphs(F.col("text"), F.col("spans"), min_words)["words"].alias("sizes"))

    def profile(strategy: str) -> Column:
        order = order_for(strategy, F.size("sizes"), F.concat_ws("|", F.col(key).cast("string"), "entity"), seed)
        used = budget_totals(F.transform(order, lambda i: F.get(F.col("sizes"), i)), budgets)
        each = F.arrays_zip(F.array(*[F.lit(b) for b in budgets]).alias("budget"), used.alias("words"))
        return F.transform(each, lambda e: F.struct(F.lit(strategy).alias("strategy"), e["budget"].alias("budget"), e["words"].alias("words")))

    rows = parts.select(key, "entity", F.explode(F.concat(*[profile(s) for s in strategies])).alias("_p"))
    return rows.select(key, "entity", "_p.strategy", "_p.budget", "_p.words")


def similarity_contexts(
    segments: DataFrame, similarities: DataFrame, budget: int, min_words: int, low: float, high: float, key: str = "doc_id"
) -> DataFrame:
    """Contexts per (key, entity, attribute) from paragraph similarities.

    ``similarities`` holds (key, entity, attribute, sims) with one value per paragraph.
    Values strictly inside (low, high) exclude their paragraph; the rest go by absolute value.
    """
    parts = segments.withColumn("_parts", sp.split_paragraphs(F.col("text"), F.col("spans"), min_words))
    joined = parts.drop("text", "spans").join(similarities, [key, "entity"])

    def usable(s: Column) -> Column:
        return (s <= low) | (s >= high)

    keyed = F.transform("sims", lambda s, i: F.struct((-F.abs(s)).alias("h"), i.alias("i"), usable(s).alias("ok")))
    order = F.transform(F.filter(F.array_sort(keyed), lambda k: k["ok"]), lambda k: k["i"])
    picked = joined.withColumn("_c", sp.build_context(F.col("_parts"), order, budget))
    return picked.select(key, "entity", "attribute", "_c.text", "_c.spans", "_c.taken")
