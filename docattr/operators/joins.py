"""Joins. Plain equi-joins without hints: the optimizer broadcasts a side only when its
measured size is below the threshold, and adaptive execution splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner_distinct(a: DataFrame, b: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    return a.join(b, on, "inner").select(*cols).distinct()


def join_suffixed(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns present on both sides get a suffix."""
    shared = [c for c in a.columns if c in b.columns and c not in on]
    left = a.select([F.col(c).alias(c + suffixes[0] if c in shared else c) for c in a.columns])
    right = b.select([F.col(c).alias(c + suffixes[1] if c in shared else c) for c in b.columns])
    return left.join(right, on, "inner")


def left_chain(df: DataFrame, steps: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    for dim, on in steps:
        df = df.join(dim, on, "left")
    return df


def lookup(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    return facts.join(dim, on, "left")


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def division(bridge: DataFrame, entity: str, document: str, allowed: DataFrame) -> DataFrame:
    """Entities all of whose documents are in ``allowed``."""
    outside = bridge.join(allowed.select(document), document, "left_anti").select(entity)
    return bridge.select(entity).distinct().join(outside, entity, "left_anti")


def expand_by_document(labels: DataFrame, bridge: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(one row per label and document of its entity, one-row count of labels without any)."""
    rows = labels.join(bridge, entity, "inner")
    missing = labels.join(bridge.select(entity), entity, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return rows, missing


def antonym_pairs(facts: DataFrame, relation: DataFrame, entity: str, attribute: str) -> DataFrame:
    """Unordered pairs of related attributes held by one entity, with their number of entities.

    Pairs come from the relation, never from all pairs of an entity's attributes.
    """
    held = facts.select(entity, attribute).distinct()
    pairs = relation.select(
        F.least("attribute", "antonym").alias("first"), F.greatest("attribute", "antonym").alias("second")
    ).filter("first <> second").distinct()
    half = held.join(pairs, F.col(attribute) == F.col("first"), "inner").select(entity, "first", "second")
    both = half.join(held.withColumnRenamed(attribute, "second"), [entity, "second"], "left_semi")
    return both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("entities"))


def pair_total(facts: DataFrame, entity: str, attribute: str) -> DataFrame:
    """One row: number of unordered attribute pairs over all entities, from counts alone."""
    sizes = facts.select(entity, attribute).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).cast("long").alias("pairs"))


def first_match(
    df: DataFrame, key: str, nested: str, matches, value, default: str, name: str
) -> DataFrame:
    """First element of a nested array that satisfies ``matches``, mapped by ``value``."""
    hits = F.filter(F.col(nested), matches)
    picked: Column = F.get(F.transform(hits, value), F.lit(0))
    return df.withColumn(name, F.coalesce(picked, F.lit(default)))
