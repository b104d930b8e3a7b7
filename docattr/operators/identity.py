"""Identity of entities by their attribute set, and numbered ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions.text import id_width, padded_id
from docattr.operators.ordered import global_index


def set_signature(df: DataFrame, member: list[str], attribute: str) -> DataFrame:
    """Order-free signature of each member's distinct attribute set.

    The set itself is never gathered: its size and two 64-bit xor sums of independent
    hashes are merged map-side, so a member with very many attributes is no hot spot.
    """
    distinct = df.select(*member, attribute).distinct()
    return distinct.groupBy(*member).agg(
        F.concat_ws(
            "-",
            F.count(F.lit(1)).cast("string"),
            F.hex(F.bit_xor(F.xxhash64(F.col(attribute)))),
            F.hex(F.bit_xor(F.xxhash64(F.lit("second"), F.col(attribute), F.lit("family")))),
        ).alias("signature")
    )


def numbered(df: DataFrame, order: list, prefix: str, name: str) -> DataFrame:
    """Zero-padded ids along a total order; width = digits of the number of rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    indexed = global_index(df, order, "_index")
    return indexed.withColumn(name, padded_id(prefix, F.col("_index"), id_width(total))).drop("_index")


def canonical_id(df: DataFrame, member: str, attribute: str, name: str | Column, prefix: str = "C") -> DataFrame:
    """Members with equal attribute sets and equal names share an id.

    Ids follow the smallest member of each group.
    """
    named = df.withColumn("_name", F.col(name) if isinstance(name, str) else name)
    names = named.groupBy(member).agg(F.min("_name").alias("_name"))
    signed = set_signature(df, [member], attribute).join(names, member)
    groups = signed.groupBy("signature", "_name").agg(F.min(member).alias("_first"))
    ids = numbered(groups, ["_first"], prefix, "id")
    return signed.join(ids, ["signature", "_name"]).select(member, "id")
