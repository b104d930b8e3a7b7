"""Row filters, key-set filters and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.operators.ordered import keep_where


def exclude_containing(df: DataFrame, col: str, needles: list[str]) -> DataFrame:
    return df.filter(reduce(lambda c, n: c & ~F.col(col).contains(n), needles, F.lit(True)))


def in_set(df: DataFrame, keys: DataFrame, on: list[str], negate: bool = False) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti" if negate else "left_semi")


def drop_null(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions))


def quality_gate(docs: DataFrame, text: str, min_unique_lines: int) -> DataFrame:
    """Documents with enough distinct non-blank lines; counted inside the row."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return keep_where(docs, "n_unique_lines", F.size(F.array_distinct(lines)), lambda n: n >= min_unique_lines)


def outside_dead_zone(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Drop values strictly between ``low`` and ``high``."""
    return df.filter((F.col(col) <= low) | (F.col(col) >= high))


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) with one row per named frame of violations."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        for name, df in checks.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicates_within(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that map to more than one value (violations of a function key -> value)."""
    return df.groupBy(*key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a <> _b").select(*key)


def not_one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """(side, value) of values that map to more than one value of the other column, either way."""
    def side(x, y):
        return duplicates_within(df, [x], y).select(F.lit(x).alias("side"), F.col(x).cast("string").alias("value"))

    return side(a, b).unionByName(side(b, a))


def leaks(df: DataFrame, shared: str, partition: str, apart: list[str]) -> DataFrame:
    """Values of ``shared``, such as documents, that occur in more than one of the partitions that must stay apart."""
    return duplicates_within(df.filter(F.col(partition).isin(apart)), [shared], partition)
