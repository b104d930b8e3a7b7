"""Merkle manifest of a corpus: a tree per language over its documents, and a tree over those.

Levels are built in blocks of ``2 ** BLOCK`` nodes. What is stored is one row per entry node of a block, linked to its
parent (the block's top, which is an entry node of the next round) and holding the siblings between the two. A recursive query
starts at the leaves, joins the parent's row once per block, appends its siblings (as a row of the step, put together
at the end) and folds the digest on the way, so a leaf of n needs log2(n) / BLOCK steps. The rows of a node that many leaves pass are repeated once per
``2 ** BLOCK`` leaves below it, and leaves are dealt over the copies, so no step of the climb has a hot key and
the copies of a round are never more than a block's share of the leaves.

Defined cases: a null field is ``-``; leaves without an id come last, ties of an id go by leaf digest; equal rows are
leaves of their own; a language with one document has its leaf as subroot, a corpus with one language its subroot as
root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docattr.operators.ordered import global_index, union_all
from docattr.session import cut, discard

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels per block.
BLOCK = 10
#: The tree over the languages' roots.
TOP = -1

LIMIT = "spark.sql.cteRecursionRowLimit"

CLIMB = """
    WITH RECURSIVE climb (tree, pos, step, to_tree, to_round, to_pos, to_copy, doc_id, leaf, siblings, folded) AS (
      SELECT tree, pos, 0, to_tree, to_round, to_pos, pmod(pos, to_copies), doc_id, digest, {add}, {fold}
      FROM (SELECT *, coalesce(claimed, digest) AS folded FROM {leaves})
      UNION ALL
      SELECT c.tree, c.pos, c.step + 1, n.to_tree, n.to_round, n.to_pos, pmod(c.pos, n.to_copies), NULL, NULL, {add}, {fold}
      FROM climb c JOIN {nodes} n ON n.tree = c.to_tree AND n.round = c.to_round AND n.pos = c.to_pos AND n.copy = c.to_copy)
    SELECT tree, pos, max(doc_id) AS doc_id, max(leaf) AS leaf, max_by(folded, step) AS folded,
           array_join(transform(array_sort(collect_list(struct(step, siblings))), s -> hex(s.siblings)), '') AS siblings
    FROM climb GROUP BY tree, pos
"""
ADD = "aggregate(path, X'', (a, s) -> a || coalesce(s.digest, X''))"
FOLD = ("aggregate(path, folded, (h, s) -> unhex(sha2(CASE WHEN s.digest IS NULL THEN lower(hex(h)) WHEN s.left THEN lower(hex(s.digest)) || lower(hex(h)) "
        "ELSE lower(hex(h)) || lower(hex(s.digest)) END, 256)))")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, digest, claimed, draw): the digest of every row, and that of the row with some fields ``changed``.

    ``changed`` maps fields to their new values, null where they stay; ``claimed`` is null where all stay.
    """
    own = {c: F.col(c) for c in fields}
    new = {c: F.coalesce(v, F.col(c)) for c, v in (changed or {}).items()}
    differs = reduce(lambda x, y: x | y, [v.isNotNull() for v in (changed or {}).values()], F.lit(False))
    plain, other = (_hash(*[_field(v) for v in values.values()]) for values in (own, own | new))
    # equal rows are told apart by a draw, so that any number of them can be cut into ranges
    return docs.select("doc_id", "lang", plain.alias("digest"), F.when(differs, other).alias("claimed"), F.rand(5).alias("draw"))


def tampered() -> dict[str, Column]:
    """One more character where 7 divides the CRC-32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(38,0)") + 1)}


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def _above(level: Column) -> Column:
    """The next level: the digest of every two neighbours, of the last one alone where their number is odd."""
    def pair(i):
        left, right = F.get(level, 2 * i), F.get(level, 2 * i + 1)
        return _hash(_hex(left), F.coalesce(_hex(right), F.lit("")))

    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(level) + 1, 1) - 1), pair)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (tree, round, pos, digest, n, under, claimed, doc_id) with all their levels as columns ``l0`` to ``l<BLOCK>``.

    ``n`` is the number of nodes of the tree in this round, ``under`` the leaves below a node; the last two are of leaves only.
    """
    here = F.array_sort(F.collect_list(F.struct("pos", "digest", "under", "claimed", "doc_id")))
    blocks = nodes.groupBy("tree", "round", "n", F.shiftright("pos", BLOCK).alias("block")).agg(here.alias("nodes"))
    blocks = blocks.select(
        "tree", "round", "n", "block", F.least(F.lit(BLOCK), _height(F.col("n"))).alias("steps"),
        F.col("nodes.digest").alias("l0"), *[F.col(f"nodes.{c}").alias(f"{c}s") for c in ("under", "claimed", "doc_id")])
    for j in range(BLOCK):
        blocks = blocks.withColumn(f"l{j + 1}", F.when(F.col("steps") > j, _above(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
    return blocks


def _copies(under: Column) -> Column:
    """How often the row of a node with so many leaves below it is repeated."""
    return F.greatest(F.lit(1), F.shiftright(under + (1 << BLOCK) - 1, BLOCK)).cast("long")


def _under() -> Column:
    return F.aggregate("unders", F.lit(0).cast("long"), lambda a, u: a + u)


def _entries(blocks: DataFrame) -> DataFrame:
    """One row per entry node of a block: its parent and the siblings on the way there."""
    more = F.col("n") > F.lit(1 << BLOCK)
    each = blocks.withColumn("all", _under()).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("l0") - 1)))

    def sibling(j: int) -> Column:
        at = F.shiftright("at", j)
        found = F.get(F.col(f"l{j}"), at.bitwiseXOR(F.lit(1)))
        return F.struct((at % 2 == 1).alias("left"), found.alias("digest"))

    path = F.slice(F.array(*[sibling(j) for j in range(BLOCK)]), F.lit(1), F.col("steps"))
    return each.select(
        "tree", "round", (F.shiftleft("block", BLOCK) + F.col("at")).alias("pos"),
        _copies(F.get("unders", F.col("at"))).alias("copies"),
        # the last block of a language's tree hangs below the tree of the languages, whose last block has no parent
        F.when(more, F.col("tree")).when(F.col("tree") != TOP, F.lit(TOP)).cast("long").alias("to_tree"),
        F.when(more, F.col("round") + 1).otherwise(F.lit(0)).alias("to_round"),
        F.when(more, F.col("block")).otherwise(F.col("tree")).alias("to_pos"),
        _copies(F.col("all")).alias("to_copies"), path.alias("path"), F.get("l0", F.col("at")).alias("digest"),
        F.get("claimeds", F.col("at")).alias("claimed"), F.get("doc_ids", F.col("at")).alias("doc_id"))


def _tops(blocks: DataFrame) -> DataFrame:
    """The blocks' tops as nodes of the next round."""
    return blocks.select(
        "tree", (F.col("round") + 1).alias("round"), F.col("block").alias("pos"), F.get(F.col(f"l{BLOCK}"), F.lit(0)).alias("digest"),
        F.shiftright(F.col("n") + (1 << BLOCK) - 1, BLOCK).alias("n"), _under().alias("under"),
        F.get("claimeds", F.lit(-1)).alias("claimed"), F.get("doc_ids", F.lit(-1)).alias("doc_id"))


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Entry rows of every round, the trees' roots as nodes, and the tables that hold both."""
    entries, roots, tables = [], [], []
    while True:
        blocks = cut(_blocks(nodes))
        tables.append(blocks)
        entries.append(_entries(blocks))
        tops = _tops(blocks)
        roots.append(tops.filter("n = 1"))
        if not blocks.filter(F.col("n") > F.lit(1 << BLOCK)).head(1):
            return entries, union_all(roots), tables
        nodes = tops.filter("n > 1")


def _climb(spark: SparkSession, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The recursive query, written out: every leaf is in it once per step, which Spark limits for accidents by default."""
    before = spark.conf.get(LIMIT, None)
    spark.conf.set(LIMIT, "-1")
    try:
        return cut(spark.sql(CLIMB.replace("{add}", ADD).replace("{fold}", FOLD), leaves=starts, nodes=nodes))
    finally:
        spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, position, leaf, subroot, root, siblings, folded_root) per row, digests as lower-case hex.

    ``siblings`` is the proof, from the leaf's level to the root's; ``folded_root`` is what it leads to from the row with
    its fields ``changed``, so it equals ``root`` only where nothing was.
    """
    hashed = cut(leaves(docs, fields, changed))
    sizes = hashed.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("n"))
    trees = cut(global_index(sizes, [F.col("_lang").asc_nulls_first()], "tree"))
    placed = global_index(hashed, [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("draw")], "pos", ["lang"])
    first = placed.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).withColumns(
        {"round": F.lit(0), "under": F.lit(1).cast("long")})
    entries, roots, tables = _grow(first)
    subroots = cut(roots)
    above = subroots.withColumns({
        "pos": F.col("tree"), "tree": F.lit(TOP).cast("long"), "round": F.lit(0),
        "n": subroots.agg(F.count(F.lit(1)).alias("n")).scalar()})
    top_entries, top, _ = _grow(above)
    nodes = union_all(entries[1:] + top_entries).drop("digest", "claimed", "doc_id")
    nodes = cut(nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies"))
    climbed = _climb(docs.sparkSession, entries[0], nodes)
    discard(hashed, nodes, *tables)
    named = trees.select("tree", F.col("_lang").alias("lang")).join(subroots.select("tree", _hex(F.col("digest")).alias("subroot")), "tree")
    root = top.select(_hex(F.col("digest"))).scalar()
    return climbed.join(named, "tree").select(
        "doc_id", "lang", F.col("pos").alias("position"), _hex(F.col("leaf")).alias("leaf"), "subroot", root.alias("root"),
        F.lower("siblings").alias("siblings"), _hex(F.col("folded")).alias("folded_root"))


def report(docs: DataFrame) -> DataFrame:
    """Every row's place in the manifest, its proof's digest, and whether the row with ``tampered`` fields still verifies."""
    found = manifest(docs, changed=tampered())
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
