"""Fuzzy matching of names inside blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.operators.graph import components
from docattr.operators.ordered import bind, keep_where
from docattr.session import cut, discard


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


BLOCK = 60
#: Members of a block that may share a token before names are no longer joined on it.
COMMON = 32


def _lcs(a: Column, b: Column) -> Column:
    """Bit-parallel length: a machine word is ``BLOCK`` cells of a table row, and a row is as many words as needed.

    Per character of ``b`` every word adds its matching cells, the carry goes on to the next word.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def compute(x):
        steps = F.sequence(F.lit(0), F.floor((F.size(x["a"]) - 1) / BLOCK).cast("int"))
        blocks = F.transform(steps, lambda i: F.slice(x["a"], i * BLOCK + 1, F.lit(BLOCK)))

        def row(words, ch):
            def word(s, w):
                part, v = w["p"], w["v"]
                full = F.call_function("shiftleft", one, F.size(part)) - 1
                at = F.transform(part, lambda c, i: F.when(c == ch, F.call_function("shiftleft", one, i)).otherwise(zero))
                hit = v.bitwiseAND(F.aggregate(at, zero, lambda t, m: t + m))
                total = v + hit + s["carry"]
                new = total.bitwiseOR(v - hit).bitwiseAND(full)
                return F.struct(
                    F.concat(s["out"], F.array(F.struct(part.alias("p"), new.alias("v")))).alias("out"),
                    F.call_function("shiftright", total, F.size(part)).alias("carry"))

            begin = F.struct(F.slice(words, 1, 0).alias("out"), zero.alias("carry"))
            return F.aggregate(words, begin, word, lambda s: s["out"])

        first = F.transform(blocks, lambda p: F.struct(p.alias("p"), (F.call_function("shiftleft", one, F.size(p)) - 1).alias("v")))
        left = F.aggregate(F.aggregate(x["b"], first, row), F.lit(0), lambda n, w: n + F.bit_count(w["v"]))
        return F.when(F.size(x["a"]) == 0, F.lit(0)).otherwise(F.size(x["a"]) - left)

    return bind(F.struct(a.alias("a"), b.alias("b")), compute)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two names."""
    return _lcs(_chars(a), _chars(b))


def lcs_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(lcs_length(a, b).cast("double"), F.length(a))


def name_tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), 0)))


def blank_tokens(name: Column) -> Column:
    """Distinct lower-case pieces between blanks; signs inside a name, as in O'Brien, stay."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda t: t != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best similarity (0..1, two digits) of common tokens and common-plus-own tokens of both names."""
    def compute(x):
        sect = F.array_join(F.array_sort(F.array_intersect(x["a"], x["b"])), " ")
        left = F.array_join(F.array_sort(F.array_except(x["a"], x["b"])), " ")
        right = F.array_join(F.array_sort(F.array_except(x["b"], x["a"])), " ")
        return bind(F.struct(sect.alias("s"), left.alias("l"), right.alias("r")), score)

    def score(x):
        s, left, right = F.length(x["s"]), F.length(x["l"]), F.length(x["r"])
        sep = F.when(s > 0, 1).otherwise(0)
        own_left, own_right = s + sep + left, s + sep + right
        distance = left + right - 2 * lcs_length(x["l"], x["r"])

        def ratio(d, total):
            return F.when(total > 0, F.lit(1.0) - d / total).otherwise(F.lit(0.0))

        both = ratio(distance, own_left + own_right)
        with_common = F.greatest(ratio(sep + left, s + own_left), ratio(sep + right, s + own_right))
        contained = (s > 0) & ((left == 0) | (right == 0))
        best = F.when(contained, F.lit(1.0)).when(s > 0, F.greatest(both, with_common)).otherwise(both)
        return F.round(best, 2)

    tokens = F.struct(name_tokens(a).alias("a"), name_tokens(b).alias("b"))
    empty = (F.size(name_tokens(a)) == 0) | (F.size(name_tokens(b)) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(bind(tokens, compute))


def shared_tokens(a: DataFrame, b: DataFrame, block: str, left: str, right: str, tokens=name_tokens) -> DataFrame:
    """(block, left, right, shared, left_size, right_size) of name pairs of a block with a common token.

    Names are deduplicated first and joined on (block, token); pairs without a common
    token are never formed.
    """
    def exploded(df, name, size):
        distinct = df.select(block, name).distinct().withColumn("_t", tokens(F.col(name)))
        return distinct.select(block, name, F.size("_t").alias(size), F.explode("_t").alias("_token"))

    pairs = exploded(a, left, "left_size").join(exploded(b, right, "right_size"), [block, "_token"])
    return pairs.groupBy(block, left, right).agg(
        F.count(F.lit(1)).alias("shared"), F.first("left_size").alias("left_size"), F.first("right_size").alias("right_size"))


def contained_pairs(a: DataFrame, b: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """(block, left, right) of name pairs of a block where one token set contains the other.

    Containment needs only one token to meet on: the smaller set's rarest one in the other table. Each name asks
    with that token, and a token that many names have is asked for only by names that have no rarer one.
    """
    def asking(df, name, other, by):
        names = df.select(block, name).distinct().withColumn("_ts", name_tokens(F.col(name)))
        each = names.select(block, name, "_ts", F.explode("_ts").alias("_token"))
        known = other.select(block, by).distinct().select(block, by, name_tokens(F.col(by)).alias("_os"))
        held = known.select(block, by, "_os", F.explode("_os").alias("_token"))
        counts = held.groupBy(block, "_token").agg(F.count(F.lit(1)).alias("_n"))
        # a token that the other side lacks rules the name out
        rarest = each.join(counts, [block, "_token"], "left").groupBy(block, name, "_ts").agg(
            F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token")).alias("_r")).filter("_r.n > 0")
        asked = rarest.select(block, name, "_ts", F.col("_r._token").alias("_token"))
        return asked.join(held, [block, "_token"]).filter(
            F.size(F.array_except("_ts", "_os")) == 0).select(block, left, right)

    return asking(a, left, b, right).unionByName(asking(b, right, a, left)).distinct()


def fuzzy_pairs(
    a: DataFrame, b: DataFrame, block: str, left: str, right: str, min_lcs: float = 0.5, min_tok: float = 1.0
) -> DataFrame:
    """Scored name pairs of a block whose LCS and token-set ratios are high enough.

    A ratio of 1 means that one token set contains the other; below that, pairs need a common token.
    """
    score = lcs_ratio(F.lower(F.col(left)), F.lower(F.col(right)))
    if min_tok >= 1:
        scored = contained_pairs(a, b, block, left, right).withColumn("tok", F.lit(1.0))
    else:
        pairs = shared_tokens(a, b, block, left, right).select(block, left, right)
        scored = keep_where(pairs, "tok", token_set_ratio(F.col(left), F.col(right)), lambda x: x >= min_tok)
    return keep_where(scored, "lcs", score, lambda x: x >= min_lcs).select(block, left, right, "lcs", "tok")


def greedy_matching(
    pairs: DataFrame, block: str, left: str, right: str, scores: list[str], rounds: int = 2, group_pairs: int = 1_000_000,
) -> DataFrame:
    """One-to-one pairs taken by descending scores, ties by name. A pair without a block or a name is none.

    A pair that is best for both its sides would be taken before any rival, so all such
    pairs are taken in one round; pairs sharing a side with them drop out. The order is
    total, so the outcome equals the sequential scan. Both bests are plain aggregates.

    A chain of pairs, each dominated by the one before, would take a round per link. What is left after ``rounds``
    rounds is therefore split into connected groups, found in logarithmically many rounds, and a task walks its groups in
    order, one batch at a time, keeping the names of the group at hand. Only a group of more than ``group_pairs`` pairs
    goes on in rounds, until it falls apart or is small enough.
    """
    rank = F.struct(*[(-F.col(s)).alias(f"_{s}") for s in scores], F.col(left).alias("_l"), F.col(right).alias("_r"))
    open_pairs = cut(pairs.dropna(subset=[block, left, right]).withColumn("_rank", rank))
    taken, round_ = [], 0
    while not open_pairs.isEmpty():
        last, round_ = open_pairs, round_ + 1
        if round_ % (rounds + 1):
            best_left = open_pairs.groupBy(block, left).agg(F.min("_rank").alias("_rank"))
            best_right = open_pairs.groupBy(block, right).agg(F.min("_rank").alias("_rank"))
            mutual = best_left.join(best_right, [block, "_rank"])
            won = cut(open_pairs.join(mutual.select(block, left, right), [block, left, right], "left_semi"))
            rest = open_pairs.join(won.select(block, left), [block, left], "left_anti")
            open_pairs = cut(rest.join(won.select(block, right), [block, right], "left_anti"))
            taken.append(won.drop("_rank"))
        else:
            grouped = cut(_connected(open_pairs, block, left, right))
            large = cut(grouped.groupBy("_root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > group_pairs).select("_root"))
            taken.append(cut(_walk(grouped.join(large, "_root", "left_anti"), block, left, right)))
            open_pairs = cut(grouped.join(large, "_root", "left_semi").drop("_root"))
            discard(grouped, large)
        discard(last)
    out = taken[0] if taken else open_pairs.drop("_rank")
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def _connected(pairs: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """Pairs with the ``_root`` of their connected group. Nodes are hashes; two that agree only put groups together."""
    named = pairs.withColumn("_node", F.xxhash64(block, left))
    first = named.groupBy(block, right).agg(F.min("_node").alias("_first"))
    roots = components(named.join(first, [block, right]), "_node", "_first")
    return named.join(roots.withColumnsRenamed({"node": "_node", "root": "_root"}), "_node").drop("_node")


def _walk(grouped: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """The pairs that a scan of each group in order takes."""

    def scan(batches):
        import pyarrow as pa

        root, of_left, of_right = None, {}, {}
        for batch in batches:
            keep = []
            for at, *pair in zip(*[batch.column(c).to_pylist() for c in ("_root", block, left, right)]):
                if at != root:
                    root, of_left, of_right = at, {}, {}
                a, b = (pair[0], pair[1]), (pair[0], pair[2])
                # a repeated row of a pair that was taken is taken, too
                fits = of_left.get(a, b) == b and of_right.get(b, a) == a
                if fits:
                    of_left[a], of_right[b] = b, a
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = grouped.repartition("_root").sortWithinPartitions("_root", "_rank").drop("_rank")
    return ordered.mapInArrow(scan, ordered.schema).drop("_root")


def best_unique_match(names: DataFrame, cast: DataFrame, block: str, name: str, member: str, common: int = COMMON) -> DataFrame:
    """Cast member sharing most tokens with a name, only where that maximum is not tied.

    Tokens that more than ``common`` members of a block hold, such as a title, are not joined on. Members are met over
    their other tokens, at most ``common`` per token; all that share only common tokens with a name are counted by the set of
    common tokens they hold: per name and number of shared ones it takes how many there are and the exclusive or of their
    ids, less those already met. Where one is left, that is its id.
    """
    def exploded(df, column):
        distinct = df.select(block, column).distinct().withColumn("_ts", blank_tokens(F.col(column)))
        return distinct.select(block, column, "_ts", F.explode("_ts").alias("_token"))

    def held(each, column):
        """Names with their common tokens; the rows of the others."""
        marked = each.join(often, [block, "_token"], "left")
        sets = marked.groupBy(block, column).agg(F.array_sort(F.collect_set(F.when(F.col("_often"), F.col("_token")))).alias("_common"))
        return sets, marked.filter("_often IS NULL").select(block, column, "_ts", "_token")

    of_cast = exploded(cast, member)
    often = cut(of_cast.groupBy(block, "_token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > common).select(
        block, "_token", F.lit(True).alias("_often")))
    asking, few = held(exploded(names, name), name)
    members, few_members = held(of_cast, member)
    members = members.withColumn("_id", F.xxhash64(member))
    met = few.join(few_members.withColumnRenamed("_ts", "_other"), [block, "_token"]).select(
        block, name, member, F.size(F.array_intersect("_ts", "_other")).alias("shared")).distinct()
    met = cut(met.join(members, [block, member]).select(block, name, "shared", "_id", F.col("_common").alias("_of")))

    def overlap(x, y):
        return F.size(F.array_intersect(x, y)).alias("shared")

    groups = members.filter(F.size("_common") > 0).groupBy(block, F.col("_common").alias("_of")).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor("_id").alias("_id"))
    asked = asking.filter(F.size("_common") > 0)
    sets = asked.select(block, "_common").distinct().withColumn("_token", F.explode("_common"))
    pairs = sets.join(groups.withColumn("_token", F.explode("_of")), [block, "_token"]).drop("_token").distinct()
    levels = pairs.groupBy(block, "_common", overlap("_common", "_of")).agg(F.sum("_n").alias("_n"), F.bit_xor("_id").alias("_id"))
    known = met.join(asked, [block, name]).groupBy(block, name, overlap("_common", "_of")).agg(
        F.count(F.lit(1)).alias("_less"), F.bit_xor("_id").alias("_without"))
    left = asked.join(levels, [block, "_common"]).join(known, [block, name, "shared"], "left").select(
        block, name, "shared", (F.col("_n") - F.coalesce("_less", F.lit(0))).alias("_n"),
        F.col("_id").bitwiseXOR(F.coalesce("_without", F.lit(0).cast("long"))).alias("_id"))
    every = met.select(block, name, "shared", F.lit(1).cast("long").alias("_n"), "_id").unionByName(left.filter("_n > 0"))
    counted = every.groupBy(block, name, "shared").agg(F.sum("_n").alias("_n"), F.bit_xor("_id").alias("_id"))
    top = counted.groupBy(block, name).agg(F.max(F.struct("shared", "_n", "_id")).alias("_b")).filter("_b._n = 1")
    return top.select(block, name, F.col("_b._id").alias("_id"), F.col("_b.shared").alias("shared")).join(
        members.select(block, member, "_id"), [block, "_id"]).select(block, name, member, F.col("shared").cast("long").alias("shared"))
