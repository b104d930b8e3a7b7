"""Sorting, top-k, unions and set algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, *cols) -> DataFrame:
    return df.orderBy(*cols)


def frequency(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Value counts, optionally the k most common; ties by value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        return counts
    return counts.orderBy(F.col("n").desc(), F.col(col)).limit(k)


def keep_top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent."""
    return df.join(frequency(df, col, k).select(col), col, "left_semi")


def top_k_coverage(df: DataFrame, col: str, k: int) -> DataFrame:
    """Share of rows covered by the k most frequent values, and the smallest frequency kept."""
    top = frequency(df, col, k).agg(F.sum("n").alias("covered"), F.min("n").alias("min_frequency"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return top.select("covered", "min_frequency", (F.lit(100.0) * F.col("covered") / total).alias("pct"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def union_tagged(parts: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Union by name after adding literal tag columns to every part."""
    tagged = [df.withColumns({k: F.lit(v) for k, v in tags.items()}) for df, tags in parts]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def dedupe(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.select(*subset).distinct() if subset else df.distinct()


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of a, b, a - b and a & b, whether a contains b, and coverage of b by a in %."""
    key = a.columns[0]
    both = (
        a.select(key).distinct().withColumn("_a", F.lit(1))
        .join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    )
    return both.agg(
        F.count("_a").alias("n_a"),
        F.count("_b").alias("n_b"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"),
        (F.count_if(F.col("_a").isNull()) == 0).alias("a_contains_b"),
        (F.lit(100.0) * F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
         / F.count("_b")).alias("coverage"),
    )


def explode_list(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    """One row per element of a joined list."""
    return df.withColumn(col, F.explode(F.split(F.col(col), sep))).filter(F.col(col) != "")
