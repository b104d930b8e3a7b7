"""Aggregation of annotator votes and inter-rater agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.functions import answers
from docattr.operators.ordered import quantiles


def one_vote_per_worker(votes: DataFrame, unit: list[str], worker: str, order: str) -> DataFrame:
    """Least ambiguous vote of each worker on each unit, the earliest on a tie."""
    rank = F.struct(answers.ambiguity(F.col("answer")).alias("a"), F.col(order).alias("o"))
    rest = [c for c in votes.columns if c not in (*unit, worker)]
    best = votes.groupBy(*unit, worker).agg(F.min_by(F.struct(*rest), rank).alias("_v"))
    return best.select(*unit, worker, "_v.*")


def vote_table(votes: DataFrame, unit: list[str], reliable: str) -> DataFrame:
    """Per unit: unreliable and unsure votes, then counts of the definite ones and their code."""
    good = F.col(reliable)

    def count(answer):
        return F.count_if(good & (F.col("answer") == answer)).alias(answer)

    out = votes.groupBy(*unit).agg(
        F.count_if(~good).alias("unreliable"),
        F.count_if(good & (F.col("answer") == "notsure")).alias("notsure"),
        *[count(a) for a in answers.DEFINITE],
    )
    n = F.col("yes") + F.col("maybeyes") + F.col("maybeno") + F.col("no")
    code = F.concat(*[F.col(a).cast("string") for a in answers.DEFINITE])
    return out.withColumn("n", n).withColumn("combination", code)


def combination_distribution(table: DataFrame, most: int = 3) -> DataFrame:
    """Every multiset of up to ``most`` definite answers with its number and share of units."""
    names = answers.DEFINITE
    combos = table.sparkSession.range(1).select(F.lit(0).alias("n"))
    for name in names:
        counts = F.sequence(F.lit(0), F.lit(most) - F.col("n"))
        combos = combos.withColumn(name, F.explode(counts)).withColumn("n", F.col("n") + F.col(name))
    combos = combos.select(
        F.col("n").cast("long").alias("n"), *[F.col(c).cast("long").alias(c) for c in names],
        F.concat(*[F.col(c).cast("string") for c in names]).alias("combination"),
    )
    seen = table.groupBy(*names).agg(F.count(F.lit(1)).alias("samples"))
    total = table.agg(F.count(F.lit(1))).scalar()
    joined = combos.join(seen, names, "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return joined.withColumn("percentage", F.lit(100.0) * F.col("samples") / total)


def krippendorff_ordinal(votes: DataFrame, unit: list[str], values: list[str]) -> DataFrame:
    """Krippendorff's alpha for an ordinal scale, one row.

    Each unit contributes n_c (n_k - [c = k]) / (m - 1) to the coincidence of c and k, so
    value counts per unit are enough and votes are never paired up.
    """
    pairable = votes.filter(F.col("answer").isin(values))
    counts = pairable.groupBy(*unit).agg(
        *[F.count_if(F.col("answer") == v).alias(f"c{i}") for i, v in enumerate(values)]
    )
    k = len(values)
    m = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    counts = counts.withColumn("m", m).filter("m > 1")
    cells = [
        F.sum(F.col(f"c{i}") * (F.col(f"c{j}") - (1 if i == j else 0)) / (F.col("m") - 1)).alias(f"o{i}_{j}")
        for i in range(k) for j in range(k)
    ]
    one = counts.agg(*cells)

    def plus(cols):
        cols = list(cols)
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    marginal = [plus(F.col(f"o{i}_{j}") for j in range(k)) for i in range(k)]
    one = one.select("*", *[c.alias(f"n{i}") for i, c in enumerate(marginal)])

    def delta(i, j):
        lo, hi = min(i, j), max(i, j)
        span = plus(F.col(f"n{g}") for g in range(lo, hi + 1)) - (F.col(f"n{lo}") + F.col(f"n{hi}")) / F.lit(2.0)
        return span * span

    pairs = [(i, j) for i in range(k) for j in range(k) if i != j]
    n = plus(F.col(f"n{i}") for i in range(k))
    observed = plus(F.col(f"o{i}_{j}") * delta(i, j) for i, j in pairs)
    expected = plus(F.col(f"n{i}") * F.col(f"n{j}") * delta(i, j) for i, j in pairs) / (n - 1)
    return one.select((F.lit(1.0) - F.try_divide(observed, expected)).alias("alpha"), n.alias("pairable"))


def worker_report(votes: DataFrame, worker: str, label: str, seconds: str) -> DataFrame:
    """Per worker: agreement with the labels, working time in minutes, share per answer."""
    minutes = F.col(seconds) / F.lit(60.0)
    pos, neg = F.col(label) == 1, F.col(label) == 0
    agree_pos = pos & F.col("answer").isin("yes", "maybeyes")
    agree_neg = neg & F.col("answer").isin("no", "maybeno")
    out = votes.groupBy(worker).agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.count_if(pos).alias("n_positive"),
        F.count_if(neg).alias("n_negative"),
        F.count_if(agree_pos).alias("_ap"),
        F.count_if(agree_neg).alias("_an"),
        F.avg(minutes).alias("mean_minutes"),
        F.stddev_pop(minutes).alias("std_minutes"),
        *[F.count_if(F.col("answer") == a).alias(f"n_{a}") for a in answers.ANSWERS],
    )
    hundred = F.lit(100.0)
    out = out.select(
        "*",
        F.try_divide(hundred * F.col("_ap"), F.col("n_positive")).alias("perf_positive"),
        F.try_divide(hundred * F.col("_an"), F.col("n_negative")).alias("perf_negative"),
        F.try_divide(hundred * (F.col("_ap") + F.col("_an")), F.col("n_positive") + F.col("n_negative")).alias("perf"),
        *[(hundred * F.col(f"n_{a}") / F.col("n_ratings")).alias(f"pct_{a}") for a in answers.ANSWERS],
    ).drop("_ap", "_an")
    middle = quantiles(votes.withColumn("_minutes", minutes), "_minutes", {"median_minutes": 0.5}, [worker])
    return out.join(middle, worker, "left")


def reliable_units(table: DataFrame, min_confidence: int = 4, min_votes: int = 2) -> DataFrame:
    """Units with a confident majority, their label and weight."""
    conf = answers.confidence(F.col("yes"), F.col("maybeyes"), F.col("maybeno"), F.col("no"))
    return (
        table.withColumn("conf", conf)
        .filter((F.abs("conf") >= min_confidence) & (F.col("n") >= min_votes))
        .withColumn("label", answers.confidence_label(F.col("conf")))
        .withColumn("weight", answers.confidence_weight(F.col("conf")))
    )
