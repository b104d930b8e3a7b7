"""Evaluation metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docattr.functions.draws import key_hash
from docattr.operators.ordered import global_index
from docattr.session import cut


def keyed_predictions(preds: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: any positive prediction wins, label of the first row; unparsed rows drop out."""
    return preds.filter(F.col("pred").isNotNull()).groupBy(*keys).agg(
        F.max("pred").alias("pred"), F.min_by("label", order).alias("label")
    )


def _confusion(weight: Column) -> list[Column]:
    def cell(label, pred, name):
        hit = (F.col("label") == label) & (F.col("pred") == pred)
        return F.sum(F.when(hit, weight).otherwise(F.lit(0.0))).alias(name)

    return [cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
    }


def binary_metrics(keyed: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    counts = keyed.groupBy(*(by or [])).agg(*_confusion(w), F.count(F.lit(1)).alias("n"))
    return counts.select(*(by or []), "n", *[c.alias(n) for n, c in _scores().items()])


def evaluate(preds: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Binary metrics with the number of all and of scored keys."""
    scored = binary_metrics(keyed_predictions(preds, keys, order)).withColumnRenamed("n", "scored_keys")
    total = preds.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    return scored.withColumn("total_keys", total)


def run_metrics(preds: DataFrame, run: str, keys: list[str], order: str) -> DataFrame:
    """Mean and population std of every metric across runs."""
    per_run = binary_metrics(keyed_predictions(preds, [run, *keys], order), [run])
    aggs = []
    for name in ("accuracy", "precision", "recall", "f1"):
        aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return per_run.agg(F.count(F.lit(1)).alias("runs"), *aggs)


def weighted_f1(preds: DataFrame, weight: str) -> DataFrame:
    return binary_metrics(preds.filter(F.col("pred").isNotNull()), weight=weight)


def accuracy_at_k(df: DataFrame, key: str, prob: str, label: str, k: int, answer: str, order: str) -> DataFrame:
    """Share of keys whose first positive ``yes`` row ranks among the k most probable ``yes`` rows.

    The rank of that row is the number of ``yes`` rows ahead of it, counted by a grouped
    join on the key: one positive row per key against its rows.
    """
    yes = df.filter(F.col(answer) == "yes")
    gold = yes.filter(F.col(label) == 1).groupBy(key).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(prob).alias("p"))).alias("g")
    )
    ahead = (F.col(prob) > F.col("g.p")) | ((F.col(prob) == F.col("g.p")) & (F.col(order) < F.col("g.o")))
    hits = yes.join(gold, key).groupBy(key).agg(F.count_if(ahead).alias("rank")).filter(F.col("rank") < k)
    total = df.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    return hits.agg(F.count(F.lit(1)).alias("hits")).select(
        F.lit(k).alias("k"), "hits", (F.col("hits") / total).alias("accuracy")
    )


def multiclass_accuracy(preds: DataFrame) -> DataFrame:
    correct = F.count_if(F.col("pred") == F.col("label"))
    return preds.agg(
        F.try_divide(correct.cast("double"), F.count("pred")).alias("accuracy"),
        F.count("pred").alias("scored"),
        F.count(F.lit(1)).alias("total"),
    )


def _difference(metric: str) -> Column:
    """Metric of side x less that of side y, of the counts ``x_tp`` to ``y_tn``."""
    scores = []
    for side in ("x", "y"):
        tp, fp, fn, tn = (F.col(f"{side}_{c}") for c in ("tp", "fp", "fn", "tn"))
        scores.append({
            "accuracy": _ratio((tp + tn).cast("double"), tp + fp + fn + tn),
            "precision": _ratio(tp.cast("double"), tp + fp),
            "recall": _ratio(tp.cast("double"), tp + fn),
            "f1": _ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
        }[metric])
    return scores[0] - scores[1]


def permutation_test(
    a: DataFrame, b: DataFrame, keys: list[str], metric: str, seed: int, resamples: int = 1000, factor: int = 1,
    method: str = "resample",
) -> DataFrame:
    """Paired two-sided permutation test of a metric difference between two systems.

    Only rows on which the systems disagree change under a swap, so only those are
    repeated per resample; partial aggregation leaves a few counts per resample and
    task before the shuffle. ``method`` says how swaps are chosen: ``resample`` draws ``resamples``
    patterns, ``exact`` uses every pattern of at most 20 rows once.
    """
    if method not in ("resample", "exact"):
        raise ValueError(f"unknown method {method!r}")
    exact = method == "exact"
    pairs = (
        a.select(*keys, F.col("label"), F.col("pred").alias("x"))
        .join(b.select(*keys, F.col("pred").alias("y")), keys)
    )
    rounds = resamples
    if exact:
        n = pairs.count()
        if n > 20:
            raise ValueError(f"{n} rows have too many swap patterns; use method='resample'")
        rounds = 2 ** n
        pairs = global_index(pairs, keys, "_spot")

    def cells(x, y):
        out = []
        for side, col in (("x", x), ("y", y)):
            for name, label, pred in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)):
                hit = (F.col("label") == label) & (col == pred)
                out.append(F.count_if(hit).alias(f"{side}_{name}"))
        return out

    names = [f"{s}_{c}" for s in ("x", "y") for c in ("tp", "fp", "fn", "tn")]

    agree = pairs.filter("x = y").agg(*cells(F.col("x"), F.col("y")))
    differ = pairs.filter("x <> y")
    numbered = differ.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    if exact:
        swap = F.floor(F.col("_r") / F.pow(F.lit(2.0), F.col("_spot"))) % 2 == 1
    else:
        swap = F.substring(key_hash(seed, F.col("_r"), *keys), 1, 1) >= "8"
    swapped = numbered.select(
        "_r", "label",
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"),
    )
    per_round = swapped.groupBy("_r").agg(*cells(F.col("x"), F.col("y")))
    fixed = [agree.select(c).scalar() for c in names]
    stats = per_round.select(*[(F.col(c) + f).alias(c) for c, f in zip(names, fixed)]).select(
        _difference(metric).alias("d")
    )
    observed = pairs.agg(*cells(F.col("x"), F.col("y"))).select(_difference(metric).alias("d"))
    d0 = observed.scalar()
    tails = stats.agg(
        F.count_if(F.col("d") <= d0 + 1e-12).alias("low"),
        F.count_if(F.col("d") >= d0 - 1e-12).alias("high"),
        F.count(F.lit(1)).alias("rounds"),
    )
    extra = 0 if exact else 1

    # without any disagreement every resample equals the observation
    def tail(col):
        r = F.when(F.col("rounds") == 0, F.lit(1.0)).otherwise((F.col(col) + extra) / (F.col("rounds") + extra))
        return r

    p = F.least(F.lit(1.0), F.lit(2.0) * F.least(tail("low"), tail("high")))
    return tails.select(
        d0.alias("statistic"), p.alias("p"), F.least(F.lit(1.0), p * factor).alias("p_corrected")
    )


def compare_systems(
    predictions: DataFrame, system: str, run: str, keys: list[str], metric: str, seed: int, run_pairs: int = 3,
    resamples: int = 1000,
) -> DataFrame:
    """Permutation tests over all pairs of systems and up to ``run_pairs`` sampled pairs of their runs, in one job.

    ``predictions`` has (system, run, keys, label, pred); rows without a prediction take no part. Pairs are rows that meet the
    predictions by joins. A resample needs no rows: of the rows with one label on which two runs differ in one way, it swaps as
    many as there are ones among as many hashed bits, 32 a draw. With k systems, p is corrected by the k(k-1) ordered comparisons.
    """
    pair = ["system_a", "run_a", "system_b", "run_b"]
    rows = predictions.select(F.col(system).alias("system"), F.col(run).alias("run"), *keys, "label", "pred")
    listed = F.array_sort(F.collect_set(F.struct("system", "run")))
    # systems and runs are configurations, a handful: one row lists them all
    both = rows.agg(listed.alias("all"), F.count_distinct("system").alias("k")).withColumn("a", F.explode("all"))
    both = both.withColumn("b", F.explode("all")).filter("a.system < b.system").select(
        F.col("a.system").alias("system_a"), F.col("a.run").alias("run_a"), F.col("b.system").alias("system_b"), F.col("b.run").alias("run_b"),
        (F.col("k") * (F.col("k") - 1)).alias("factor"))
    order = Window.partitionBy("system_a", "system_b").orderBy(key_hash(seed, "system_a", "system_b", "run_a", "run_b"), "run_a", "run_b")
    drawn = cut(both.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= run_pairs).drop("_n"))
    if drawn.isEmpty():
        raise ValueError("a comparison needs two systems")
    known = rows.filter("pred IS NOT NULL")
    left = known.withColumnsRenamed({"system": "system_a", "run": "run_a", "pred": "x"})
    right = known.drop("label").withColumnsRenamed({"system": "system_b", "run": "run_b", "pred": "y"})
    met = drawn.join(left, ["system_a", "run_a"]).join(right, ["system_b", "run_b", *keys])
    cells = cut(met.groupBy(*pair, "factor", "label", "x", "y").agg(F.count(F.lit(1)).alias("n")))

    def confusion(swapped: Column) -> list[Column]:
        out = []
        for side, own, other in (("x", "x", "y"), ("y", "y", "x")):
            for name, label, pred in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)):
                hits = F.when(F.col(own) == pred, F.col("n") - swapped).otherwise(0) + F.when(F.col(other) == pred, swapped).otherwise(0)
                out.append(F.sum(F.when(F.col("label") == label, hits).otherwise(0)).alias(f"{side}_{name}"))
        return out

    names = [f"{s}_{c}" for s in ("x", "y") for c in ("tp", "fp", "fn", "tn")]
    observed = cells.groupBy(*pair, "factor").agg(*confusion(F.lit(0))).select(*pair, "factor", _difference(metric).alias("statistic"))
    fixed = cells.filter("x = y").groupBy(*pair).agg(*confusion(F.lit(0))).withColumnsRenamed({c: f"_{c}" for c in names})
    draws = cells.filter("x <> y").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 32))))
    bits = F.conv(F.substring(key_hash(seed, *pair, "label", "x", "y", "_r", "_chunk"), 1, 8), 16, 10).cast("long")
    spare = F.greatest(F.lit(0), (F.col("_chunk") + 1) * 32 - F.col("n")).cast("int")
    ones = F.bit_count(F.call_function("shiftright", bits, spare))
    swaps = draws.groupBy(*pair, "_r", "label", "x", "y", "n").agg(F.sum(ones).alias("_swapped"))
    resampled = swaps.groupBy(*pair, "_r").agg(*confusion(F.col("_swapped"))).join(fixed, pair, "left").select(
        *pair, *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in names]).select(*pair, _difference(metric).alias("d"))
    tails = resampled.join(observed, pair).groupBy(*pair).agg(
        F.count_if(F.col("d") <= F.col("statistic") + 1e-12).alias("low"), F.count_if(F.col("d") >= F.col("statistic") - 1e-12).alias("high"))
    smaller = (F.least("low", "high") + 1) / F.lit(resamples + 1.0)
    # without any disagreement every resample equals the observation
    p = F.when(F.col("low").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * smaller))
    return observed.join(tails, pair, "left").select(
        *pair, "statistic", p.alias("p"), F.least(F.lit(1.0), p * F.col("factor")).alias("p_corrected"))
