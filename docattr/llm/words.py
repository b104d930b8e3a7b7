"""The word rule that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8, for code in tasks: ``bytes.split`` cuts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def row_key(*columns: Column | str) -> Column:
    """128-bit key that equal rows share; it keeps rows apart that have one id."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def row_keys(*columns: Column | str) -> list[Column]:
    """The same key as two plain columns ``k1`` and ``k2``, on which aggregates and joins share one partitioning."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def whole_row(docs: DataFrame) -> Column:
    """All columns as the struct ``row``, in which no name can clash with a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, some of them ``changed``."""
    return [changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
