"""Similarity joins, pooling and candidate choice over vector columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions import vectors as vx


def cosine_join(a: DataFrame, b: DataFrame, on: list[str], left: str, right: str, name: str = "similarity") -> DataFrame:
    """Cosine similarity of every left and right vector of the same key.

    Vectors are normalised once per row before the join, not once per pair.
    """
    na = a.withColumn(left, vx.l2_normalize(F.col(left)))
    nb = b.withColumn(right, vx.l2_normalize(F.col(right)))
    return na.join(nb, on).withColumn(name, vx.dot(F.col(left), F.col(right))).drop(left, right)


def _weighted_mean(df: DataFrame, key: str, vec: str, weight: Column | None, name: str) -> DataFrame:
    """Dimension-wise (weighted) mean per group; whole vectors are merged map-side."""
    w = weight if weight is not None else F.lit(1.0)
    rows = df.filter(F.col(vec).isNotNull()).select(key, w.cast("double").alias("_w"), array_to_vector(vx.as_double(F.col(vec))).alias("_v"))
    means = rows.groupBy(key).agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
    return means.select(key, vector_to_array("_m").alias(name))


def mean_pool(df: DataFrame, key: str, vec: str, mask: Column | None = None, name: str = "pooled") -> DataFrame:
    kept = df if mask is None else df.filter(mask)
    return _weighted_mean(kept, key, vec, None, name)


def attention_pool(df: DataFrame, key: str, vec: str, score: Column, mask: Column | None = None, name: str = "pooled") -> DataFrame:
    """Mean weighted by the softmax of the scores of unmasked rows."""
    kept = (df if mask is None else df.filter(mask)).withColumn("_s", score.cast("double"))
    top = kept.groupBy(key).agg(F.max("_s").alias("_top"))
    return _weighted_mean(kept.join(top, key), key, vec, F.exp(F.col("_s") - F.col("_top")), name)


def mix(entity: Column, document: Column, alpha: float) -> Column:
    """alpha * entity + (1 - alpha) * document."""
    return F.zip_with(entity, document, lambda e, d: F.lit(alpha) * e + F.lit(1 - alpha) * d)


def candidate_scores(df: DataFrame, key: str, vec: str, ids: str, candidates: DataFrame, cid: str, cvec: str) -> DataFrame:
    """(key, pos, candidate, similarity) for the candidates each row lists by id."""
    rows = df.withColumn(vec, vx.l2_normalize(F.col(vec))).select(key, vec, F.posexplode(ids).alias("pos", cid))
    cands = candidates.withColumn(cvec, vx.l2_normalize(F.col(cvec)))
    return rows.join(cands, cid).select(key, "pos", F.col(cid).alias("candidate"), vx.dot(F.col(vec), F.col(cvec)).alias("similarity"))


def best_candidate(scores: DataFrame, key: str) -> DataFrame:
    """Most similar candidate per row, the first listed on a tie."""
    best = scores.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("pos")).alias("p"), "candidate")).alias("_b"))
    return best.select(key, F.col("_b.candidate").alias("candidate"), F.col("_b.similarity").alias("similarity"))
