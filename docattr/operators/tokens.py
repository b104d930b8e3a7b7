"""Batch padding over token id columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.functions import tokens as tk


def pad_batches(df: DataFrame, batch: str, ids: str, pad: int, side: str = "right", mask: str | None = None) -> DataFrame:
    """Pad the ids of every batch to its longest row; right padding also gives the attention mask.

    The batch length is pre-aggregated and joined back, rows of a batch are not gathered.
    """
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    out = df.join(longest, batch)
    size = F.col("_longest")
    padded = tk.pad_right if side == "right" else tk.pad_left
    out = out.withColumn("attention_mask", tk.attention_mask(F.col(ids), size)).withColumn(ids, padded(F.col(ids), size, pad))
    if side == "left":
        out = out.withColumn("attention_mask", F.reverse("attention_mask"))
    if mask:
        out = out.withColumn(mask, padded(F.col(mask), size, 0))
    return out.drop("_longest")
