"""Distribution summaries and frequency reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docattr.operators.ordered import quantiles

SUMMARY_QUANTILES = {"q80": 0.8, "q90": 0.9, "q95": 0.95, "q98": 0.98, "q99": 0.99}


def partition_summary(df: DataFrame, partition: str, distinct: dict[str, str], positive: Column) -> DataFrame:
    """Per partition and for the whole: distinct counts, rows, +/- rows, and each as % of the whole."""
    aggs = [F.count_distinct(F.col(c)).alias(f"n_{name}") for name, c in distinct.items()]
    aggs += [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(positive).alias("n_pos"),
        F.count_if(~positive).alias("n_neg"),
    ]
    parts = df.groupingSets([[F.col(partition)], []], F.col(partition)).agg(*aggs, F.grouping(partition).alias("_all"))
    parts = parts.withColumn("partition", F.when(F.col("_all") == 1, "full").otherwise(F.col(partition)))
    # one row per partition plus the total row
    whole = Window.partitionBy(F.lit(0))
    names = [f"n_{name}" for name in distinct] + ["n_rows"]
    for name in names:
        total = F.max(F.when(F.col("_all") == 1, F.col(name))).over(whole)
        parts = parts.withColumn("pct_" + name[2:], F.lit(100.0) * F.col(name) / total)
    return parts.select("partition", *names, "n_pos", "n_neg", *["pct_" + n[2:] for n in names])


def summary(df: DataFrame, col: str, key: str) -> DataFrame:
    """One row: mean, population std, median, min and max with their keys, upper quantiles."""
    value = F.col(col).cast("double")
    base = df.agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(F.struct(F.col(col).alias("v"), F.col(key).alias("k"))).alias("_lo"),
        F.max(F.struct(F.col(col).alias("v"), (-F.col(key)).alias("k"))).alias("_hi"),
    ).select(
        "mean", "std",
        F.col("_lo.v").alias("min"), F.col("_lo.k").alias("min_key"),
        F.col("_hi.v").alias("max"), (-F.col("_hi.k")).alias("max_key"),
    )
    qs = quantiles(df, col, {"median": 0.5, **SUMMARY_QUANTILES}).withColumn("_j", F.lit(1))
    return base.withColumn("_j", F.lit(1)).join(qs, "_j").drop("_j")


def histogram(df: DataFrame, col: str, bins: int, upper_q: float | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (optionally only values below a quantile); the last bin is closed.

    Every bin has a row, with its count and density.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL")
    if upper_q is not None:
        values = values.filter(F.col("v") < quantiles(df, col, {"q": upper_q}).select("q").scalar())
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("size"))
    lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
    bucket = F.least(F.floor((F.col("v") - lo) * F.lit(bins) / (hi - lo)) + 1, F.lit(bins))
    counts = values.groupBy(F.coalesce(bucket, F.lit(1)).cast("int").alias("bin")).agg(F.count("v").alias("n"))
    frame = edges.select("lo", "hi", "size", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    n = F.coalesce("n", F.lit(0))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
        n.cast("long").alias("n"),
        F.try_divide(n.cast("double"), F.col("size") * width).alias("density"),
    )


def describe_nunique(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Distinct values per group, then count/mean/sample std/min/quartiles/max, cut to integers."""
    per_group = df.groupBy(key).agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])
    rows = []
    for c in cols:
        base = per_group.agg(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ).withColumn("column", F.lit(c))
        qs = quantiles(per_group, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumn("column", F.lit(c))
        rows.append(base.join(qs, "column"))
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    merged = reduce(lambda a, b: a.unionByName(b), rows)
    return merged.select("column", *[F.col(s).cast("int").alias(s) for s in stats])


def conditional_rates(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group the number and share (%) of rows for which each condition holds."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(c).alias(f"n_{name}") for name, c in conditions.items()]
    out = df.groupBy(key).agg(*aggs)
    for name in conditions:
        out = out.withColumn(f"pct_{name}", F.lit(100.0) * F.col(f"n_{name}") / F.col("n"))
    return out


def joined_set(df: DataFrame, key: str, col: str, sep: str = ";") -> DataFrame:
    """Sorted distinct values of each group as one joined string."""
    distinct = df.select(key, col).distinct()
    return distinct.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(col).cast("string"))), sep).alias("items")
    )


def drop_ambiguous(df: DataFrame, key: list[str], mapped: str) -> DataFrame:
    """Rows of groups that map to a single value."""
    bounds = df.groupBy(*key).agg(F.min(mapped).alias("_a"), F.max(mapped).alias("_b"))
    return df.join(bounds.filter("_a = _b").select(*key), key, "left_semi")


def prefer_primary(df: DataFrame, key: list[str], rank: str, primary: str, identity: list[str]) -> DataFrame:
    """Where a group has exactly one distinct primary member, keep only primary rows."""
    members = df.filter(F.col(rank) == primary).select(*key, *identity).distinct()
    single = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(*key, F.lit(True).alias("_one"))
    kept = df.join(single, key, "left").filter(F.col("_one").isNull() | (F.col(rank) == primary))
    return kept.drop("_one")


def longest(df: DataFrame, key: str, col: str, pos: str) -> DataFrame:
    """Longest value per group, the first one on a tie."""
    return df.groupBy(key).agg(F.max_by(col, F.struct(F.length(col), -F.col(pos))).alias(col))


def group_min(df: DataFrame, key: str, col: str, name: str) -> DataFrame:
    """Minimum of the group on every row: pre-aggregated and joined back, so no group is gathered."""
    return df.join(df.groupBy(key).agg(F.min(col).alias(name)), key, "left")


def length_profile(df: DataFrame, by: list[str], col: str, ps: dict[str, float]) -> DataFrame:
    """Quantiles and maximum of a length per configuration."""
    top = df.groupBy(*by).agg(F.max(col).alias("max"), F.count(col).alias("n"))
    return quantiles(df, col, ps, by).join(top, by)


def token_budget(prompts: DataFrame, text: str, max_output: int) -> DataFrame:
    """One row: prompts, input tokens and the most output tokens that can be produced."""
    tokens = F.regexp_count(F.col(text), F.lit(r"\S+"))
    return prompts.agg(
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum(tokens).alias("input_tokens"),
        (F.count(F.lit(1)) * max_output).alias("max_output_tokens"),
    )


def to_wide(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """One row per category with aligned ``;``-joined lists."""
    packed = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, *[F.col(c).cast("string").alias(f"_{c}") for c in cols]))).alias("_r")
    )
    # field access on an array of structs yields the array of that field
    return packed.select(key, *[F.array_join(F.col("_r")[f"_{c}"], ";").alias(c) for c in cols])


def compact_log(log: DataFrame, metric: str) -> DataFrame:
    """Interleaved training log -> (step, partition, loss, metric); records without a loss drop out."""
    train = F.col("loss").isNotNull()
    return log.filter(train | F.col("eval_loss").isNotNull()).select(
        "step",
        F.when(train, "train").otherwise("dev").alias("partition"),
        F.coalesce("loss", "eval_loss").alias("loss"),
        F.when(~train, F.col(metric)).alias(metric),
    )


def catalogue(df: DataFrame, name: str, definition: str, pos: str) -> DataFrame:
    """Distinct names with the definition seen last."""
    return df.groupBy(name).agg(F.max_by(definition, pos).alias(definition))
