"""Order-dependent operators that stay distributed when one group holds most rows.

A window partitioned by a hot key runs in one task. The operators here cut the total
order into ranges instead, work inside each range and carry the range totals forward;
the carried table has at most one row per range and group crossing it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docattr.functions.draws import key_hash
from docattr.session import cut


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _ranged(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Copy of ``df`` in range partitions of (by, order), numbered by ``_part``.

    The copy is cut so that the ranges stay fixed for every reader, also after a loss.
    ``order`` must be total inside ``by``, else equal keys share one range.
    """
    keys = _cols(by) + _cols(order)
    return cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def _with_offsets(ranged: DataFrame, by: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    inside = Window.partitionBy("_part", *by).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_total_{n}") for n, v in values.items()])
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # only groups that cross into a further range keep a row: fewer rows than ranges
    carried = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_carried_part"),
        F.count(F.lit(1)).over(before).alias("_crossed"),
        *[F.sum(f"_total_{n}").over(before).alias(f"_carry_{n}") for n in values],
    ).filter("_crossed > 0").drop("_crossed")
    # null is a group of its own
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_carried_part"))
    return (
        ranged.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})
        .join(F.broadcast(carried), same, "left")
        .withColumns({n: F.col(n) + F.coalesce(f"_carry_{n}", F.lit(0)) for n in values})
        .drop(*carried.columns, "_part")
    )


def running_totals(df: DataFrame, order: list, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Inclusive running sums, one column per entry of ``values``, within ``by`` along a total order."""
    by = list(by or [])
    return _with_offsets(_ranged(df, by, order), by, order, values)


def running_total(df: DataFrame, order: list, value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within ``by`` along a total order."""
    return running_totals(df, order, {name: value}, by)


def global_index(df: DataFrame, order: list, name: str, by: list[str] | None = None) -> DataFrame:
    """0-based position along a total order (within ``by``)."""
    return running_total(df, order, F.lit(1), name, by).withColumn(name, (F.col(name) - 1).cast("long"))


def quantiles(df: DataFrame, col: str, ps: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles from a value-frequency table, one row per group.

    Equal values are counted before anything is ordered, and no task ever holds all
    values of a group.
    """
    by = list(by or [])
    freq = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    cum = running_total(freq, ["_v"], F.col("_n"), "_hi", by)
    sizes = cum.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if by:
        sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_size")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        cum = cum.join(sizes, same).drop(*[f"_by_{c}" for c in by])
    else:
        cum = cum.withColumn("_size", sizes.scalar())
    picks = []
    for name, p in ps.items():
        pos = (F.col("_size") - 1) * F.lit(float(p))
        for tag, at in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            here = (F.col("_hi") - F.col("_n") <= at) & (at < F.col("_hi"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}_{name}"))
    wide = cum.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for name, p in ps.items():
        pos = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_l_{name}"), F.col(f"_h_{name}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return wide.select(*by, *out)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first along a total order.

    The rank filter is applied per map task before the shuffle, so a hot key ships
    one row per task.
    """
    return first_k(df, keys, order, 1)


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def cumulative_share(freq: DataFrame, key: str, count: str) -> DataFrame:
    """Percentage of all rows covered by the most frequent keys so far."""
    total = freq.agg(F.sum(count)).scalar()
    ordered = running_total(freq, [F.col(count).desc(), F.col(key)], F.col(count), "running")
    return ordered.withColumn("share", F.lit(100.0) * F.col("running") / total)


def trip_after(df: DataFrame, key: str, order: str, failed: Column, n: int) -> DataFrame:
    """Per source, the first position at which ``n`` consecutive rows have failed.

    Failures between two successes share the running success count; the n-th failure
    of such a run trips the breaker.
    """
    marked = df.select(key, order, failed.alias("_bad"))
    runs = running_total(marked, [order], F.when(F.col("_bad"), 0).otherwise(1), "_run", [key])
    w = Window.partitionBy(key, "_run").orderBy(order)
    ranked = runs.filter("_bad").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return ranked.filter(F.col("_rn") == n).groupBy(key).agg(F.min(order).alias("tripped_at"))


def rank_abs(df: DataFrame, keys: list[str], value: str, position: str, name: str = "rank") -> DataFrame:
    """Rank by absolute value, largest first, ties by position."""
    order = [F.abs(F.col(value)).desc(), F.col(position)]
    return global_index(df, order, name, keys).withColumn(name, F.col(name) + 1)


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once: a lambda body is evaluated per element, so
    whatever it only refers to has to be bound outside."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def keep_where(df: DataFrame, name: str, value: Column, keep) -> DataFrame:
    """Add a costly column and keep the rows where ``keep(value)`` holds.

    A filter on a computed column makes Spark compute it for the filter and again for the
    output; a generator computes it once.
    """
    return df.select("*", F.explode(F.filter(F.array(value), keep)).alias(name))


# --- operators on the ordered parts of one document, held as an array in its row ----------


#: Parts folded at a time. A list that grows part by part is copied at every step, so it only grows to this length.
PIECE = 256


def _scan(sizes: Column, state: dict[str, Column], emit: Callable, advance: Callable) -> Column:
    """What ``emit(state, size)`` gives for every part, while ``advance(state, size)`` moves the state along.

    Pieces of ``PIECE`` parts are folded one after the other and their lists are appended whole, so a document of n
    parts copies n * PIECE / 2 values and one pointer per pair of pieces instead of n * n / 2 values.
    """
    names = list(state)

    def step(s, n):
        n = n.cast("int")
        moved = advance(s, n)
        return F.struct(F.concat(s["_out"], F.array(emit(s, n))).alias("_out"), *[moved[k].alias(k) for k in names])

    def build(parts):
        def piece(s, start):
            zero = F.struct(F.array().cast("array<int>").alias("_out"), *[s[k].alias(k) for k in names])
            # parts are looked up by place, as a slice would copy the whole list first
            places = F.sequence(start, F.least(start + F.lit(PIECE), F.size(parts)) - 1)
            return F.aggregate(places, zero, lambda r, i: step(r, F.get(parts, i)), lambda r: F.struct(
                F.concat(s["_lists"], F.array(r["_out"])).alias("_lists"), *[r[k].alias(k) for k in names]))

        starts = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / F.lit(PIECE)).cast("int")), lambda i: i * PIECE)
        zero = F.struct(F.array().cast("array<array<int>>").alias("_lists"), *[v.alias(k) for k, v in state.items()])
        return F.aggregate(F.filter(starts, lambda i: i < F.size(parts)), zero, piece, lambda s: F.flatten(s["_lists"]))

    return bind(sizes, build)


def offsets(sizes: Column, delimiter: int = 1) -> Column:
    """Start offset of every part when parts of these sizes are joined by a delimiter."""
    return _scan(sizes, {"at": F.lit(0)}, lambda s, n: s["at"], lambda s, n: {"at": s["at"] + n + F.lit(delimiter)})


def pack_min(sizes: Column, minimum: int) -> Column:
    """Greedy group number of every part: a group grows while it stays below ``minimum``."""

    def extend(s, n):
        return (s["group"] >= 0) & (s["running"] + n < F.lit(minimum))

    def group(s, n):
        return F.when(extend(s, n), s["group"]).otherwise(s["group"] + 1)

    def advance(s, n):
        return {"group": group(s, n), "running": F.when(extend(s, n), s["running"] + n).otherwise(n)}

    return _scan(sizes, {"group": F.lit(-1), "running": F.lit(0)}, group, advance)


def islands(flags: Column) -> Column:
    """Maximal runs of true flags as array<struct(lo, hi)> of 0-based inclusive positions."""

    def build(fs):
        def edges(step):
            at = F.transform(fs, lambda f, i: F.when(f & ~F.coalesce(F.get(fs, i + step), F.lit(False)), i))
            return F.filter(at, lambda i: i.isNotNull())

        # a run begins where the flag before is not set and ends where the next is not
        return F.zip_with(edges(-1), edges(1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))

    return bind(flags, build)


def budget_prefix(sizes: Column, budget: int) -> Column:
    """How many leading parts fit the budget (sizes are not negative)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(s, n):
        fits = s["open"] & (s["total"] + n <= F.lit(budget))
        return F.struct(
            (s["total"] + n).cast("long").alias("total"),
            F.when(fits, s["taken"] + 1).otherwise(s["taken"]).alias("taken"),
            fits.alias("open"),
        )

    return F.aggregate(sizes, start, step, lambda s: s["taken"])


def budget_totals(sizes: Column, budgets: list[int]) -> Column:
    """What the leading parts that fit come to, for every budget, from one running sum (sizes are not negative)."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array(*[F.lit(0).cast("long") for _ in budgets]).alias("used"))
    limits = F.array(*[F.lit(b).cast("long") for b in budgets])

    def step(s, n):
        total = (s["total"] + n).cast("long")
        used = F.zip_with(s["used"], limits, lambda u, b: F.when(total <= b, total).otherwise(u))
        return F.struct(total.alias("total"), used.alias("used"))

    return F.aggregate(sizes, start, step, lambda s: s["used"])


def order_for(strategy: str, count: Column, key: Column, seed: int = 2050, similarity: Column | None = None) -> Column:
    """Part positions (0-based) in the order a strategy looks at them."""
    positions = F.sequence(F.lit(0), count - 1)
    positions = F.when(count > 0, positions).otherwise(F.array().cast("array<int>"))
    if strategy == "first":
        return positions
    if strategy == "last":
        return F.reverse(positions)
    if strategy == "random":
        keyed = F.transform(positions, lambda i: F.struct(key_hash(seed, key, i).alias("h"), i.alias("i")))
    elif strategy == "similarity":
        keyed = F.transform(
            positions, lambda i: F.struct((-F.abs(F.get(similarity, i))).alias("h"), i.alias("i"))
        )
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def gold_index(options: Column, gold: Column, seed: int, key: Column) -> tuple[Column, Column]:
    """Options in a seeded order, and the 1-based position of the gold one."""
    shuffled = F.transform(
        F.array_sort(F.transform(options, lambda o: F.struct(key_hash(seed, key, o).alias("h"), o.alias("o")))),
        lambda s: s["o"],
    )
    return shuffled, F.array_position(shuffled, gold).cast("int")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
