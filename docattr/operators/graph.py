"""Components, leakage-safe splits and greedy cover. Iterations cut their lineage with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docattr.operators.identity import numbered
from docattr.session import cut, discard


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between two nodes, root = smallest node of its component.

    Alternating large-star and small-star rounds: every node's greater neighbours, then its smaller ones, move to
    the smallest neighbour. Smallest neighbours are plain aggregates, reduced map-side, so a hub ships one row
    a task. Each round writes one table and deletes the one before; the loop ends when a round changes nothing.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        state = links.agg(F.count(F.lit(1)).alias("n"), mark.alias("h")).first()
        if state == before or not state["n"]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        last, links = links, cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): connected components of an undirected graph, root = smallest node; a node may be alone."""
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).distinct()
    return nodes.join(star_components(edges, a, b), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def bipartite_components(bridge: DataFrame, entity: str, document: str) -> DataFrame:
    """(kind, id, root): components of an entity-document bridge with typed vertices.

    Documents sort before entities, so a root is the smallest document of its component.
    """
    pairs = bridge.select(F.col(document).cast("string").alias("d"), F.col(entity).cast("string").alias("e")).distinct()
    # an entity of one document adds no connection: it takes that document's root afterwards
    degree = pairs.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("only"))
    held = cut(degree)
    edges = pairs.join(held.filter("n > 1").select("e"), "e", "left_semi")
    # the first document stands for its entity, so nodes are documents only
    linked = edges.join(held.filter("n > 1").select("e", "only"), "e").select("d", "only")
    roots = cut(star_components(linked, "d", "only"))
    documents = pairs.select("d").distinct().join(roots.withColumnRenamed("node", "d"), "d", "left").select(
        "d", F.coalesce("root", "d").alias("root"))
    entities = held.join(roots.withColumnRenamed("node", "only"), "only", "left").select(
        "e", F.coalesce("root", "only").alias("root"))
    return documents.select(F.lit("d").alias("kind"), F.col("d").alias("id"), "root").unionByName(
        entities.select(F.lit("e").alias("kind"), F.col("e").alias("id"), "root"))


def number_components(nodes: DataFrame, order, prefix: str = "N") -> DataFrame:
    """(root, component): ids in the order of the components' smallest documents."""
    roots = nodes.select("root").distinct()
    return numbered(roots, [order], prefix, "component")


def tag_bridge(bridge: DataFrame, document: str, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Bridge rows with the component id of their document."""
    docs = nodes.filter("kind = 'd'").select(F.col("id").alias("_d"), "root")
    return bridge.join(docs, F.col(document).cast("string") == F.col("_d")).drop("_d").join(ids, "root").drop("root")


def leakage_safe_split(
    bridge: DataFrame, entity: str, document: str, test: DataFrame, rows: DataFrame, attribute: str, label: str = "label"
) -> DataFrame:
    """(entity, attribute, partition) of labelled and unlabelled rows, from a test set of entities.

    Documents of test entities are reserved. Rows of entities wholly inside them are ``dev``, rows of entities that
    touch none are ``train``, rows of boundary entities get no partition; a row with a label is ``test``
    whatever its entity. ``rows`` has (entity, attribute, label) with a null label where there is none.
    """
    pairs = bridge.select(entity, document).distinct()
    reserved = pairs.join(test.select(entity), entity, "left_semi").select(document).distinct()
    touching = pairs.join(reserved, document, "left_semi").select(entity).distinct()
    leaking = pairs.join(reserved, document, "left_anti").select(entity).distinct()
    flags = (
        pairs.select(entity).distinct()
        .join(touching.withColumn("_t", F.lit(True)), entity, "left")
        .join(leaking.withColumn("_l", F.lit(True)), entity, "left")
        .withColumn("_known", F.lit(True))
    )
    each = rows.groupBy(entity, attribute).agg(F.max(F.col(label).isNotNull()).alias("_labelled"))
    part = (
        F.when(F.col("_labelled"), "test")
        .when(F.col("_t") & F.col("_l").isNull(), "dev")
        .when(F.col("_known") & F.col("_t").isNull(), "train")
    )
    return each.join(flags, entity, "left").select(entity, attribute, part.alias("partition"))


def greedy_cover(bridge: DataFrame, document: str, sample: str, ahead: int = 16, pairs: int = 4_000_000) -> DataFrame:
    """(document, step, gain, coverage): documents in greedy order until every sample is covered, ties by document.

    Gains never grow, hence the greedy order is by gain, ties by document, and documents may be found in any order as
    long as each has the gain it has when its turn comes. Two kinds of rounds find them:

    * A document that is the best choice for each of its open samples keeps its gain until its turn, so all such
      documents are taken at once. This takes many where documents overlap little, and goes on while a round covers a quarter.
    * Else the documents of highest gain are looked at together, as many as have ``pairs`` open pairs, ``ahead`` at least.
      One task makes every choice among them that comes before the gain that the next document still had. Its
      input has ``pairs`` entries at most, or 2 ** ahead counts of samples by which of the documents hold them.

    Rows without a document or a sample are left out.
    """
    from docattr.operators.ordered import global_index, running_total

    if not 1 <= ahead <= 16:
        raise ValueError("between 1 and 16 documents can be looked at together")
    open_pairs = cut(bridge.select(F.col(document).alias("d"), F.col(sample).alias("s")).dropna().distinct())
    rounds, before = [], None
    while True:
        gains = cut(open_pairs.groupBy("d").agg(F.count(F.lit(1)).alias("gain")))
        levels = sorted(((r["gain"], r["n"]) for r in gains.groupBy("gain").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        left = sum(gain * n for gain, n in levels)
        if not left:
            break
        if left > pairs and (before is None or 4 * left <= 3 * before):
            before = left
            ranked = open_pairs.join(gains, "d")
            best = ranked.groupBy("s").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("d").alias("d"))).alias("b"))
            wins = best.groupBy(F.col("b.d").alias("d"), (-F.col("b.g")).alias("gain")).agg(F.count(F.lit(1)).alias("won"))
            chosen = cut(wins.filter("won = gain").select("d", "gain"))
        else:
            before = 0
            chosen = _look_ahead(open_pairs, *_highest(gains, levels, ahead, pairs))
        rounds.append(chosen)
        if left <= pairs:
            break  # every document was looked at
        covered = open_pairs.join(chosen.select("d"), "d", "left_semi").select("s").distinct()
        last, open_pairs = open_pairs, cut(open_pairs.join(covered, "s", "left_anti"))
        discard(last, gains)
    out = rounds[0] if rounds else open_pairs.select("d", F.lit(0).cast("long").alias("gain"))
    for more in rounds[1:]:
        out = out.unionByName(more)
    total = out.agg(F.coalesce(F.sum("gain"), F.lit(0))).first()[0]  # every sample is covered once
    order = [F.col("gain").desc(), F.col("d")]
    steps = global_index(out, order, "step").withColumn("step", F.col("step") + 1)
    covered = running_total(steps, ["step"], F.col("gain"), "_sum")
    return covered.select(
        F.col("d").alias(document), "step", "gain", (F.lit(100.0) * F.col("_sum") / F.lit(total)).alias("coverage"))


def _highest(gains: DataFrame, levels: list[tuple[int, int]], ahead: int, pairs: int) -> tuple[DataFrame, int, int, bool]:
    """Documents of highest gain, ties by document, as (d, i) with ``i`` in the order of the documents, and a bound.

    The bound is a gain and a number: other documents have that gain at most, and those that have it come after the
    documents below that number. The last value says whether these may have more than ``pairs`` open pairs.
    ``levels`` has the number of documents of each gain, the highest first.
    """
    from docattr.operators.ordered import global_index

    n = size = bound = some = 0
    for gain, count in levels:
        fits = max((pairs - size) // gain, ahead - n, 0)
        if fits < count:
            bound, some = gain, fits
            break
        n, size = n + count, size + gain * count
    ahead_of_others = F.lit(False)
    if some:
        level = gains.filter(F.col("gain") == bound).select("d")
        if some <= 1000:
            last = level.orderBy("d").limit(some).agg(F.max("d")).first()[0]
        else:
            last = global_index(level, ["d"], "_i").filter(F.col("_i") == some - 1).first()["d"]
        ahead_of_others = F.col("d") <= F.lit(last).cast(gains.schema["d"].dataType)
    top = gains.filter((F.col("gain") > bound) | ((F.col("gain") == bound) & ahead_of_others))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")) - 1
    looked = cut(top.select("d", at.alias("i")))
    return looked, bound, looked.filter(ahead_of_others).count() if some else 0, size + some * bound > pairs


def _look_ahead(open_pairs: DataFrame, looked: DataFrame, bound: int, below: int, counted: bool) -> DataFrame:
    """(d, gain) of the next choices that can be made among the documents looked at, at least one."""
    sets = open_pairs.join(looked, "d").groupBy("s").agg(F.collect_list("i").alias("held"))
    if counted:
        sets = sets.groupBy(F.array_sort("held").alias("held")).agg(F.count(F.lit(1)).alias("n"))
    else:
        sets = sets.select("held", F.lit(1).cast("long").alias("n"))
    picks = sets.repartition(1).mapInArrow(lambda batches: _choices(batches, bound, below), "i int, gain long")
    return cut(picks.join(looked, "i").select("d", "gain"))


def _choices(batches, bound: int, below: int):
    """Greedy choices over sets of document numbers, level by level of gain: inside a level by number, as a gain only falls."""
    import numpy as np
    import pyarrow as pa

    parts = [(b["held"].flatten().to_numpy(), b["held"].value_lengths().to_numpy(), b["n"].to_numpy()) for b in batches]
    if not parts:
        return
    members, lengths, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    starts = np.concatenate([[0], np.cumsum(lengths)])
    weights = np.repeat(counts, lengths)
    gain = np.bincount(members, weights).astype(np.int64)
    by_document = np.argsort(members, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(members))])
    holders = np.repeat(np.arange(len(lengths)), lengths)[by_document]
    is_open = np.ones(len(lengths), bool)
    picked, gains = [], []
    level = gain.max()
    while level and level >= bound:
        for i in np.flatnonzero(gain == level).tolist():
            if gain[i] < level:
                continue
            if level == bound and i >= below:
                level = 0
                break
            picked.append(i)
            gains.append(level)
            mine = holders[begins[i]:begins[i + 1]]
            mine = mine[is_open[mine]]
            is_open[mine] = False
            sizes = lengths[mine]
            at = np.arange(sizes.sum()) + np.repeat(starts[mine] - np.cumsum(sizes) + sizes, sizes)
            np.subtract.at(gain, members[at], weights[at])
        level = level and gain.max()
    yield pa.RecordBatch.from_arrays([pa.array(picked, pa.int32()), pa.array(gains, pa.int64())], ["i", "gain"])
