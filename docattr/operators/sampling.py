"""Seeded samples. Draws are functions of row keys, so results do not depend on partitioning."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docattr.functions.draws import key_hash, uniform
from docattr.operators.ordered import bind, first_k, global_index, gold_index, running_total, union_all
from docattr.session import cut


def sample_n(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement: the n smallest key hashes (a top-n, not a full sort)."""
    return df.orderBy(key_hash(seed, *key), *key).limit(n)


def shuffle(df: DataFrame, key: list[str], seed: int, name: str = "position") -> DataFrame:
    """Position of every row in a seeded random order."""
    hashed = df.withColumn("_h", key_hash(seed, *key))
    return global_index(hashed, ["_h", *key], name).drop("_h")


def repeat_runs(df: DataFrame, runs: int) -> DataFrame:
    return df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def pick_n(df: DataFrame, key: str, item: str, n: int, seed: int) -> DataFrame:
    """Up to n random distinct items per key as a list, in random order."""
    distinct = df.select(key, item).distinct().withColumn("_h", key_hash(seed, key, item))
    few = first_k(distinct, [key], ["_h", item], n)
    ordered = F.array_sort(F.collect_list(F.struct("_h", F.col(item).cast("string").alias("i"))))
    return few.groupBy(key).agg(ordered.alias("_l")).select(key, F.col("_l.i").alias("items"))


#: Facts of one entity that are gathered in one row.
IN_ENTITY = 1000
#: Attributes of one entity that its rows carry as an array; entities that hold more are spread over tasks.
IN_ROW = 256

# --- negatives ------------------------------------------------------------------------------


def _kth_missing(requests: DataFrame, held: DataFrame, vocab: DataFrame, entity: str, attribute: str) -> DataFrame:
    """Vocabulary entry with exactly ``r`` unheld entries before it, per request (entity, r).

    The i-th held entry at vocabulary position h has h - i unheld entries before it, so the
    answer lies at r plus the held entries with h - i <= r: a running count over requests
    and held entries in one order. No entity's unheld vocabulary is ever listed.
    """
    ranked = held.join(vocab, attribute)
    ranked = global_index(ranked.select(entity, "_pos"), ["_pos"], "_i", [entity])
    marks = ranked.select(entity, (F.col("_pos") - F.col("_i")).alias("_at"), F.lit(0).alias("_kind"), F.col("_pos").alias("_tie"))
    asks = requests.select(entity, F.col("_r").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_tie"))
    merged = running_total(marks.unionByName(asks), ["_at", "_kind", "_tie"], 1 - F.col("_kind"), "_before", [entity])
    found = merged.filter("_kind = 1").select(entity, F.col("_at").alias("_r"), (F.col("_at") + F.col("_before")).alias("_pos"))
    return found.join(vocab, "_pos").select(entity, "_r", F.col(attribute).alias("_other"))


def inject_negatives(
    facts: DataFrame, key: list[str], entity: str, attribute: str, relation: DataFrame, seed: int, p: float = 0.5,
    vocab: DataFrame | None = None, blank: list[str] | None = None,
) -> DataFrame:
    """Positives with label 1 plus one distinct negative per (key without attribute) draw with label 0.

    A negative is, with probability ``p``, an unheld antonym of the row's attribute if there
    is one, otherwise any attribute of the vocabulary that the entity does not hold. Draws are uniform.
    The vocabulary is ``vocab`` (a column ``attribute``), or the attributes that occur. An entity that holds
    all of it gets an unheld antonym where there is one, else no negative. Columns in
    ``blank``, such as an explanation of the label, are kept on positives and empty on negatives.

    Facts are shuffled once: those of an entity are one array, from which its rows and what it holds are read.
    Entities with over ``IN_ENTITY`` facts, and facts without an entity, are spread over tasks instead.
    """
    facts = cut(facts.select(*key, *[c for c in blank or [] if c not in key]))
    listed = (facts if vocab is None else vocab).select(attribute).filter(F.col(attribute).isNotNull()).distinct()
    vocab = cut(global_index(listed, [attribute], "_pos"))
    size = vocab.count()
    large = facts.groupBy(F.col(entity).alias("_large")).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(large.filter((F.col("_n") > IN_ENTITY) | F.col("_large").isNull()).select("_large"))
    if large.isEmpty():
        return _negatives_in_rows(facts, key, entity, attribute, relation, seed, p, vocab, size, blank)
    same = F.col(entity).eqNullSafe(F.col("_large"))
    few, many = facts.join(large, same, "left_anti"), cut(facts.join(large, same, "left_semi"))
    return _negatives_in_rows(few, key, entity, attribute, relation, seed, p, vocab, size, blank).unionByName(
        _negatives_in_ranges(many, key, entity, attribute, relation, seed, p, vocab, size, blank))


def _negatives_in_rows(
    facts: DataFrame, key: list[str], entity: str, attribute: str, relation: DataFrame, seed: int, p: float, vocab: DataFrame,
    size: int, blank: list[str] | None,
) -> DataFrame:
    others = [c for c in key if c != entity]
    each = [*others, *[c for c in blank or [] if c not in key]]
    grouped = facts.join(vocab, attribute, "left").groupBy(entity).agg(F.collect_set(F.struct(*each, "_pos")).alias("_all"))

    positives = grouped.select(entity, F.explode("_all").alias("_k"))
    positives = positives.select(entity, *[F.col("_k")[c].alias(c) for c in each]).select(*key, *(blank or []), F.lit(1).alias("label"))

    # the i-th held entry at position h of the vocabulary has h - i unheld entries before it
    places = F.sort_array(F.array_distinct(F.filter(F.transform("_all", lambda a: a["_pos"]), lambda h: h.isNotNull())))
    held = F.array_distinct(F.filter(F.transform("_all", lambda a: a[attribute]), lambda t: t.isNotNull()))
    rows = grouped.select(
        entity, F.array_distinct(F.transform("_all", lambda a: F.struct(*[a[c].alias(c) for c in others]))).alias("_rows"),
        F.transform(places, lambda h, i: h - i).alias("_before"), held.alias("_held"))
    rows = rows.select(entity, F.explode("_rows").alias("_k"), "_before", "_held", (F.lit(size) - F.size("_before")).alias("_free"))
    rows = rows.select(entity, *[F.col("_k")[c].alias(c) for c in others], "_before", "_held", "_free")

    # unheld antonym with the smallest hash; antonyms per attribute are few, and those outside the vocabulary are attributes as well
    near = relation.select(attribute, "antonym").filter(F.col("antonym") != F.col(attribute))
    near = cut(near.groupBy(attribute).agg(F.collect_set("antonym").alias("_near")))
    options = F.filter("_near", lambda o: ~F.array_contains("_held", o))
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key])
    best = F.array_min(F.transform(options, lambda o: F.struct(key_hash(seed + 1, *key, o).alias("h"), o.alias("o"))))
    rows = rows.join(near, attribute, "left").select(*key, "_before", "_free", F.when(whole, best["o"]).alias("_anto"))
    use = F.col("_anto").isNotNull() & ((uniform(seed, *key) < p) | (F.col("_free") == 0))
    rows = rows.filter("_free > 0 OR _anto IS NOT NULL").withColumn("_r", F.when(~use, F.floor(uniform(seed + 2, *key) * F.col("_free"))))
    at = F.col("_r") + F.size(F.filter("_before", lambda b: b <= F.col("_r")))
    rows = rows.select(*key, "_anto", "_r", at.alias("_pos"))
    listed = vocab.select(F.col(attribute).alias("_other"), "_pos")
    negative = F.when(F.col("_r").isNull(), F.col("_anto")).otherwise(F.col("_other"))
    negatives = rows.join(listed, "_pos", "left").select(*[c for c in key if c != attribute], negative.alias(attribute)).distinct()
    empty = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in blank or []]
    return positives.unionByName(negatives.select(*key, *empty, F.lit(0).alias("label")))


def _negatives_in_ranges(
    facts: DataFrame, key: list[str], entity: str, attribute: str, relation: DataFrame, seed: int, p: float, vocab: DataFrame,
    size: int, blank: list[str] | None,
) -> DataFrame:
    # read by six branches below
    held = cut(facts.select(entity, attribute).distinct())
    holds = held.join(vocab.select(attribute), attribute, "left_semi").groupBy(entity).agg(F.count(F.lit(1)).alias("_n_held"))
    rows = facts.select(*key).distinct().join(holds, entity, "left")
    rows = rows.withColumn("_free", size - F.coalesce("_n_held", F.lit(0))).drop("_n_held")

    # unheld antonym with the smallest hash per (entity, attribute) row; antonyms per attribute are few
    options = rows.select(*key).join(relation.select(attribute, F.col("antonym").alias("_anto")), attribute)
    options = options.filter(F.col("_anto") != F.col(attribute))
    options = options.join(held.select(entity, F.col(attribute).alias("_anto")), [entity, "_anto"], "left_anti")
    # antonyms outside the vocabulary stay eligible: they are attributes as well
    best = options.groupBy(*key).agg(F.min(F.struct(key_hash(seed + 1, *key, "_anto").alias("h"), "_anto")).alias("_b"))
    rows = rows.join(best.select(*key, F.col("_b._anto").alias("_anto")), key, "left")

    use_antonym = F.col("_anto").isNotNull() & ((uniform(seed, *key) < p) | (F.col("_free") == 0))
    rows = rows.filter("_free > 0 OR _anto IS NOT NULL").withColumn("_use", use_antonym).withColumn("_r", F.floor(uniform(seed + 2, *key) * F.col("_free")).cast("long"))
    # requests and the final pick read the same rows
    rows = cut(rows.select(*key, "_anto", "_use", "_r"))
    requests = rows.filter(~F.col("_use")).select(entity, "_r").distinct()
    others = _kth_missing(requests, held, vocab, entity, attribute)
    picked = rows.join(others, [entity, "_r"], "left").withColumn(
        "_negative", F.when(F.col("_use"), F.col("_anto")).otherwise(F.col("_other")))
    outer = [c for c in key if c != attribute]
    negatives = picked.select(*outer, F.col("_negative").alias(attribute)).distinct().withColumn("label", F.lit(0))
    kept = [F.col(c) for c in blank or []]
    empty = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in blank or []]
    positives = facts.select(*key, *kept).distinct().withColumn("label", F.lit(1))
    return positives.unionByName(negatives.select(*key, *empty, "label"))


# --- five-way samples -----------------------------------------------------------------------


def multiclass_samples(
    facts: DataFrame, entity: str, attribute: str, relation: DataFrame, seed: int, options: int = 5, antonyms: int = 2,
    keep: list[str] | None = None,
) -> DataFrame:
    """(entity, attribute, options, label) with up to ``antonyms`` unheld antonyms and frequency-weighted others.

    Others are drawn one after the other without replacement from the attributes that the entity neither holds nor has as
    an antonym, with odds by frequency, so the set is short only when that vocabulary is. Facts without an entity or
    an attribute are no samples. Columns in ``keep``, such as a sample's weight and partition, are those of the
    row's facts (of differing ones the smallest).

    Attributes lie on an axis as intervals as long as their frequency. What an entity may not draw is cut out of the axis,
    a draw is a point on what is left, and a running sum of the cut lengths before it gives its place on the whole axis.
    There are as many rounds as options to draw, and no entity's free vocabulary is ever listed. The cuts of an
    entity that holds up to ``IN_ROW`` attributes are an array in its rows; those of others are ordered in ranges.
    """
    held = cut(facts.select(entity, attribute).dropna().distinct())
    near = relation.select(attribute, F.col("antonym").alias("_o")).filter(F.col(attribute) != F.col("_o")).distinct()

    freq = held.groupBy(F.col(attribute).alias("_o")).agg(F.count(F.lit(1)).alias("_w"))
    weights = cut(running_total(freq, ["_o"], F.col("_w"), "_hi").withColumn("_lo", F.col("_hi") - F.col("_w")))
    total = weights.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    # a cell of the axis holds the attributes that overlap it: at most attributes + cells rows
    cells = 1024
    cell = lambda at: F.floor(at * F.lit(cells) / max(total, 1))
    axis = cut(weights.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi") - 1)))))

    few, many = held, None
    if weights.count() > IN_ROW:
        large = cut(held.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > IN_ROW).select(entity))
        if not large.isEmpty():
            few, many = held.join(large, entity, "left_anti"), cut(held.join(large, entity, "left_semi"))
    draw = (entity, attribute, near, weights, axis, cell, total, seed, options, antonyms)
    full = _draws_in_rows(few, *draw)
    if many is not None:
        full = full.unionByName(_draws_in_ranges(many, *draw))

    drawn = F.transform(F.array_sort(F.transform("_picks", lambda p: F.struct(p["round"].alias("r"), p["o"].alias("o")))), lambda p: p["o"])
    every = F.concat(F.array(F.col(attribute).cast("string")), "_antos", drawn)
    shuffled, gold = gold_index(every, F.col(attribute).cast("string"), seed + 3, F.col(entity))
    out = full.select(entity, attribute, shuffled.alias("options"), gold.alias("label"))
    if not keep:
        return out
    return out.join(facts.groupBy(entity, attribute).agg(*[F.min(c).alias(c) for c in keep]), [entity, attribute])


PICKS = "array<struct<at:bigint,w:bigint,o:string,round:int>>"


def _start(seed: int, entity: str, attribute: str, round_: int) -> Column:
    """A point on what the row may draw."""
    return F.floor(uniform(seed + 1, entity, attribute, F.lit(round_)) * F.col("_free"))


def _past_picks(point: Column) -> Column:
    """What the row has drawn before is cut out as well; picks are sorted by place."""
    return F.aggregate("_picks", point, lambda at, p: at + F.when(at >= p["at"], p["w"]).otherwise(0))


def _draws_in_rows(
    held: DataFrame, entity: str, attribute: str, near: DataFrame, weights: DataFrame, axis: DataFrame, cell, total: int,
    seed: int, options: int, antonyms: int,
) -> DataFrame:
    """(entity, attribute, _antos, _picks): each round meets the axis only, and the cuts of an entity are an array in its rows."""
    # antonyms per attribute are few; those that nobody holds have no place on the axis
    placed = near.join(weights.select("_o", F.col("_w").alias("_ow"), F.col("_lo").alias("_olo")), "_o", "left")
    placed = placed.groupBy(attribute).agg(F.collect_list(F.struct("_o", F.col("_olo").alias("lo"), F.col("_ow").alias("w"))).alias("_near"))
    known = weights.select(F.col("_o").alias(attribute), "_lo", "_w").join(placed, attribute, "left")
    each = F.struct(F.col(attribute).alias("t"), F.col("_lo").alias("lo"), F.col("_w").alias("w"), F.col("_near").alias("near"))
    rows = held.join(cut(known), attribute).groupBy(entity).agg(F.collect_list(each).alias("_all"))
    own = bind(F.transform("_all", lambda a: a["t"]), lambda ts: F.transform("_all", lambda a: F.struct(
        a["t"].alias("t"), F.filter(F.coalesce(a["near"], F.array()), lambda o: ~F.array_contains(ts, o["_o"])).alias("near"))))
    rows = rows.withColumn("_own", own)
    place = lambda x: F.struct(x["lo"].alias("lo"), x["w"].alias("w"))
    cuts = F.sort_array(F.array_distinct(F.concat(
        F.transform("_all", place),
        F.flatten(F.transform("_own", lambda a: F.transform(F.filter(a["near"], lambda o: o["lo"].isNotNull()), place))))))
    # a cut has the place it takes on the axis without the cuts ahead of it
    none = F.array().cast("array<struct<at:bigint,gap:bigint>>")
    marks = F.aggregate(cuts, F.struct(none.alias("m"), F.lit(0).cast("long").alias("sum")), lambda acc, c: F.struct(
        F.concat(acc["m"], F.array(F.struct((c["lo"] - acc["sum"]).alias("at"), c["w"].alias("gap")))).alias("m"), (acc["sum"] + c["w"]).alias("sum")))
    rows = rows.select(entity, "_own", marks.alias("_marks")).select(entity, F.explode("_own").alias("_a"), "_marks")
    rows = rows.select(
        entity, F.col("_a.t").alias(attribute), F.col("_a.near._o").alias("_near"), F.col("_marks.m").alias("_marks"),
        (F.lit(total) - F.col("_marks.sum")).alias("_free"), F.array().cast(PICKS).alias("_picks"))
    hashed = F.sort_array(F.transform("_near", lambda o: F.struct(key_hash(seed, entity, attribute, o).alias("h"), o.alias("o"))))
    antos = F.sort_array(F.transform(F.slice(hashed, 1, antonyms), lambda x: x["o"])).cast("array<string>")
    rows = rows.select(entity, attribute, antos.alias("_antos"), "_marks", "_free", "_picks")

    more = (F.size("_antos") + F.size("_picks") < options - 1) & (F.col("_free") > 0)
    fields = [entity, attribute, "_antos", "_marks", "_free", "_picks"]
    for round_ in range(1, options):
        # columns one after the other, each of them read twice, are compiled; in a lambda they would be interpreted
        asks = rows.select(*fields, F.when(more, _start(seed, entity, attribute, round_)).alias("_start"))
        asks = asks.select(*fields, F.when(F.size("_picks") == 0, F.col("_start")).otherwise(_past_picks(F.col("_start"))).alias("_at"))
        gone = F.aggregate("_marks", F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(m["at"] <= F.col("_at"), m["gap"]).otherwise(0))
        asks = asks.select(*fields, "_at", gone.alias("_before")).select(*fields, "_before", (F.col("_at") + F.col("_before")).alias("_t"))
        asks = asks.withColumn("_cell", cell(F.col("_t")))
        on = (F.col("_cell") == F.col("_axis")) & (F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_hi"))
        hit = asks.join(axis.withColumnRenamed("_cell", "_axis"), on, "left")
        pick = F.struct((F.col("_lo") - F.col("_before")).alias("at"), F.col("_w").alias("w"), F.col("_o").cast("string").alias("o"), F.lit(round_).alias("round"))
        picks = F.when(F.col("_w").isNotNull(), F.sort_array(F.concat("_picks", F.array(pick)))).otherwise(F.col("_picks"))
        rows = hit.select(*fields[:4], (F.col("_free") - F.coalesce("_w", F.lit(0))).alias("_free"), picks.alias("_picks"))
    return rows.select(entity, attribute, "_antos", "_picks")


def _draws_in_ranges(
    held: DataFrame, entity: str, attribute: str, near: DataFrame, weights: DataFrame, axis: DataFrame, cell, total: int,
    seed: int, options: int, antonyms: int,
) -> DataFrame:
    """The same, with the cuts of an entity in ranges over tasks and a running sum per round."""
    held_o = held.withColumnRenamed(attribute, "_o")
    own = cut(held.join(near, attribute).join(held_o, [entity, "_o"], "left_anti"))
    chosen = first_k(own.withColumn("_h", key_hash(seed, entity, attribute, "_o")), [entity, attribute], ["_h", "_o"], antonyms)
    # a cut has the place it takes on the axis without the cuts ahead of it
    cuts = held_o.unionByName(own.select(entity, "_o")).distinct().join(weights.select("_o", "_w", "_lo"), "_o")
    cuts = running_total(cuts.select(entity, "_w", "_lo"), ["_lo"], F.col("_w"), "_sum", [entity])
    marks = cut(cuts.select(entity, (F.col("_lo") - F.col("_sum") + F.col("_w")).alias("_at"), F.col("_w").alias("_gap")))
    barred = marks.groupBy(entity).agg(F.sum("_gap").alias("_barred"))

    antos = chosen.groupBy(entity, attribute).agg(F.array_sort(F.collect_list("_o")).alias("_antos"))
    no_names, no_picks = F.array().cast("array<string>"), F.array().cast(PICKS)
    # each round's rows are written once: the range sort reads its input twice, and finished rows come from them as well
    rows = cut(held.join(antos, [entity, attribute], "left").join(barred, entity, "left").select(
        entity, attribute, F.coalesce("_antos", no_names).alias("_antos"),
        (F.lit(total) - F.coalesce("_barred", F.lit(0))).alias("_free"), no_picks.alias("_picks")))

    done, round_ = [], 0
    more = (F.size("_antos") + F.size("_picks") < options - 1) & (F.col("_free") > 0)
    while round_ < options - 1:
        round_ += 1
        done.append(rows.filter(~more))
        point = _past_picks(_start(seed, entity, attribute, round_))
        asks = rows.filter(more).select("*", point.alias("_at"), F.lit(0).cast("long").alias("_gap"), F.lit(1).alias("_kind"))
        both = asks.unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        placed = running_total(both, ["_at", "_kind"], F.col("_gap"), "_before", [entity]).filter("_kind = 1")
        placed = placed.withColumn("_t", F.col("_at") + F.col("_before")).withColumn("_cell", cell(F.col("_t")))
        hit = placed.join(axis, "_cell").filter("_t >= _lo AND _t < _hi")
        pick = F.struct((F.col("_lo") - F.col("_before")).alias("at"), F.col("_w").alias("w"), F.col("_o").cast("string").alias("o"), F.lit(round_).alias("round"))
        rows = cut(hit.select(
            entity, attribute, "_antos", (F.col("_free") - F.col("_w")).alias("_free"),
            F.array_sort(F.concat("_picks", F.array(pick))).alias("_picks")))
    return union_all([*done, rows]).select(entity, attribute, "_antos", "_picks")


# --- divergence-minimising split ------------------------------------------------------------


def best_split(
    members: DataFrame, component: str, attribute: str, train: float, dev: float, q: int, trials: int, seed: int
) -> DataFrame:
    """(component, partition, divergence) of the random split whose dev and test attribute
    distributions diverge least from train, over the q most frequent attributes.

    ``members`` has one row per (component, entity, attribute). All trials run in one job: a trial is its two
    thresholds in the seeded order of the components, so only components are ranked, and members
    meet one row per component that names its partition in every trial.
    """
    counts = cut(members.filter(F.col(component).isNotNull()).groupBy(component, attribute).agg(F.count(F.lit(1)).alias("_n")))
    comps = cut(counts.select(component).distinct())
    n = comps.count()
    n_train, n_dev = math.floor(n * train), math.floor(n * dev)
    every = F.sequence(F.lit(0), F.lit(trials - 1))
    tried = comps.withColumn("_trial", F.explode(every)).withColumn("_h", key_hash(seed, "_trial", component))
    ranked = global_index(tried, ["_h", component], "_rank", ["_trial"])

    kind = members.schema[component].dataType
    # two rows per trial, the first components of dev and test, come to the plan as constants; none where nothing is left
    firsts = {(r["_trial"], r["_rank"]): r for r in ranked.filter(F.col("_rank").isin(n_train, n_train + n_dev)).collect()}

    def ahead(place, trial, rank):
        if rank >= n:
            return F.lit(True)
        marks = [firsts[(t, rank)] for t in range(trials)]
        typed = [F.struct(F.lit(m["_h"]).alias("_h"), F.lit(m[component]).cast(kind).alias(component)) for m in marks]
        return place < F.get(F.array(*typed), trial)

    def part(trial):
        place = F.struct(key_hash(seed, trial, component).alias("_h"), F.col(component))
        return F.when(ahead(place, trial, n_train), "train").when(ahead(place, trial, n_train + n_dev), "dev").otherwise("test")

    parts = comps.withColumn("_parts", F.transform(every, part))
    split = counts.join(parts, component).select(attribute, "_n", F.posexplode("_parts").alias("_trial", "partition"))

    # attribute counts per trial and partition; the total of a partition counts every attribute
    sums = split.groupBy("_trial", attribute).pivot("partition", ["train", "dev", "test"]).agg(F.sum("_n"))
    # one row per trial and attribute, read for the totals and for the shares
    sums = cut(sums.na.fill(0, ["train", "dev", "test"]))
    totals = sums.groupBy("_trial").agg(*[F.sum(c).alias(f"_{c}") for c in ("train", "dev", "test")])
    top = counts.groupBy(attribute).agg(F.sum("_n").alias("_n")).orderBy(F.col("_n").desc(), attribute).limit(q)
    dist = sums.join(top.select(attribute), attribute, "left_semi").join(totals, "_trial")

    def rel_entr(x: Column, y: Column) -> Column:
        return F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(math.inf)).otherwise(x * F.ln(x / y))

    def share(c):
        return F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_{c}")), F.lit(0.0))

    kl = rel_entr(share("dev"), share("train")) + rel_entr(share("test"), share("train"))
    scores = dist.groupBy("_trial").agg(F.sum(kl).alias("divergence"))
    best = scores.agg(F.min(F.struct("divergence", "_trial")).alias("b")).select("b.divergence", "b._trial").first()
    if best is None or best["_trial"] is None:
        return comps.limit(0).select(component, F.lit("").alias("partition"), F.lit(0.0).alias("divergence"))
    return comps.select(component, part(F.lit(best["_trial"])).alias("partition"), F.lit(best["divergence"]).alias("divergence"))


# --- few-shot examples ----------------------------------------------------------------------


def few_shot(
    rows: DataFrame, key: str, label: str, k: int, seed: int, group: str | None = None
) -> DataFrame:
    """(key, examples): ids of ceil(k/2) positive and the remaining negative examples, never the row itself.

    With ``group`` the examples share the row's group where it has enough of them, else they
    come from all rows. Each pool is a seeded ring: a row starts at a random place and takes
    the next members, so no row is compared with every other one.
    """
    base = rows.select(key, label, *([group] if group else []))
    picks = []
    for value, want in ((1, math.ceil(k / 2)), (0, k - math.ceil(k / 2))):
        if want == 0:
            continue
        pool = base.filter(F.col(label) == value).withColumn("_h", key_hash(seed, key))
        pools = [(None, shuffle_index(pool, key, None))]
        if group:
            pools.append((group, shuffle_index(pool, key, group)))
        got = None
        for by, ring in pools:
            sizes = ring.groupBy(by).agg(F.count(F.lit(1)).alias("_size")) if by else None
            asking = base.join(sizes, by) if by else base.withColumn("_size", ring.agg(F.count(F.lit(1))).scalar())
            start = F.floor(uniform(f"{seed}-{by or 'all'}-{value}", key) * F.col("_size"))
            steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(want), (F.col("_size") - 1).cast("int")))).alias("_step")
            asking = asking.filter("_size > 0").select(key, *([by] if by else []), start.alias("_start"), "_size", steps)
            asking = asking.withColumn("_i", (F.col("_start") + F.col("_step")) % F.col("_size"))
            on = ["_i", by] if by else ["_i"]
            hit = asking.join(ring.select(*on, F.col(key).alias("_example")), on).filter(F.col(key) != F.col("_example"))
            lists = hit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_step", "_example"))).alias("_l"))
            lists = lists.select(key, F.slice(F.col("_l._example"), 1, want).alias("_e"))
            if got is None:
                got = lists
            else:
                enough = lists.filter(F.size("_e") >= want).withColumnRenamed("_e", "_own")
                got = got.join(enough, key, "left").select(key, F.coalesce("_own", "_e").alias("_e"))
        picks.append(got.withColumnRenamed("_e", f"_e{value}"))
    out = base.select(key)
    for p in picks:
        out = out.join(p, key, "left")
    none = F.array().cast(T.ArrayType(rows.schema[key].dataType))
    every = F.concat(*[F.coalesce(c, none) for c in out.columns if c != key])
    mixed = F.array_sort(F.transform(every, lambda e: F.struct(key_hash(seed + 9, key, e).alias("h"), e.alias("e"))))
    return out.select(key, F.transform(mixed, lambda s: s["e"]).alias("examples"))


def shuffle_index(pool: DataFrame, key: str, by: str | None) -> DataFrame:
    return global_index(pool, ["_h", key], "_i", [by] if by else [])
