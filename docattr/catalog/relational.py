"""Filters, joins, set operations and ordered operators on the given tables."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.registry import query, table
from docattr.functions import text as tx
from docattr.functions.answers import partition_label
from docattr.operators import filters, joins, ordered, setops

# --- predicates ---------------------------------------------------------------------------


@query("F01_not_contains", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'red') AND NOT contains(p_name, 'ring')")
def f01(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return filters.exclude_containing(part, "p_name", ["red", "ring"])


@query("F02_in_set", """
  SELECT c_custkey, c_mktsegment, true AS has_order FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL
  SELECT c_custkey, c_mktsegment, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def f02(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return setops.union_tagged([
        (filters.in_set(cust, keys, ["c_custkey"]), {"has_order": True}),
        (filters.in_set(cust, keys, ["c_custkey"], negate=True), {"has_order": False}),
    ])


@query("F03_drop_null", """
  SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def f03(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return filters.drop_null(docs.join(table(spark, d, "labels"), "doc_id", "left"), ["quality"]).select("doc_id", "quality")


@query("F04_threshold_conjunction", """
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'P' AND o_orderpriority >= '3'""")
def f04(spark, d):
    return filters.where_all(
        table(spark, d, "orders"), F.col("o_totalprice") >= 200000, F.col("o_orderstatus") != "P",
        F.col("o_orderpriority") >= "3",
    ).select("o_orderkey", "o_totalprice")


@query("F05_quality_gate", """
  SELECT doc_id, len(list_distinct(list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x <> '')))::INT AS n_unique_lines
  FROM documents
  WHERE len(list_distinct(list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x <> ''))) >= 3""")
def f05(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return filters.quality_gate(docs, "text", 3).select("doc_id", "n_unique_lines")


@query("F07_constraint_checks", f"""
  WITH {v.votes_sql()}, {v.ONE_VOTE}
  SELECT 'at_most_three_votes' AS "check", count(*) AS violations FROM (SELECT unit FROM one_vote GROUP BY unit HAVING count(*) > 3)
  UNION ALL SELECT 'one_name_per_brand', count(*) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1)
  UNION ALL SELECT 'parts_are_known', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'labels_have_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'total_status', count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F','O','P')
  UNION ALL SELECT 'titles_one_to_one', (SELECT count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1))
    + (SELECT count(*) FROM (SELECT n_name FROM nation GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1))
  UNION ALL SELECT 'no_leakage', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)
  UNION ALL SELECT 'length_matches_text', count(*) FROM documents WHERE length(text) <> n_chars""")
def f07(spark, d):
    from docattr.operators.votes import one_vote_per_worker

    t = lambda name: table(spark, d, name)
    one = one_vote_per_worker(v.votes(spark, d), ["unit"], "worker", "event_id")
    return filters.run_checks({
        "at_most_three_votes": one.groupBy("unit").count().filter("count > 3"),
        "one_name_per_brand": filters.duplicates_within(t("part"), ["p_brand"], "p_type"),
        "parts_are_known": joins.anti(
            t("lineitem").select("l_partkey"), t("part").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]),
        "labels_have_documents": joins.anti(t("labels"), t("documents"), ["doc_id"]),
        "total_status": t("orders").filter("o_orderstatus IS NULL OR o_orderstatus NOT IN ('F','O','P')"),
        "titles_one_to_one": filters.not_one_to_one(t("nation"), "n_regionkey", "n_name"),
        "no_leakage": filters.leaks(t("orders"), "o_custkey", "o_orderstatus", ["F", "P"]),
        "length_matches_text": t("documents").filter("length(text) <> n_chars"),
    })


# --- joins --------------------------------------------------------------------------------


@query("J01_inner_distinct", """
  SELECT DISTINCT o_custkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey""")
def j01(spark, d):
    cust = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.inner_distinct(table(spark, d, "orders"), cust, ["o_custkey"], ["o_custkey", "c_mktsegment", "o_orderstatus"])


@query("J02_composite_key_suffixes", """
  SELECT l_orderkey, l_partkey, a.q AS n_a, b.p AS n_b
  FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) a
  JOIN (SELECT l_orderkey, l_partkey, sum(l_quantity) AS p FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) b
  USING (l_orderkey, l_partkey)""")
def j02(spark, d):
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_partkey"]
    a = li.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.sum("l_quantity").alias("n"))
    b = li.filter("l_returnflag <> 'A'").groupBy(*keys).agg(F.sum("l_quantity").alias("n"))
    return joins.join_suffixed(a, b, keys, ("_a", "_b"))


@query("J03_left_chain", """
  SELECT c_custkey, n_name, r_name, o_orderkey FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN orders ON c_custkey = o_custkey""")
def j03(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.left_chain(
        table(spark, d, "customer"), [(nation, ["c_nationkey"]), (region, ["n_regionkey"]), (orders, ["c_custkey"])]
    ).select("c_custkey", "n_name", "r_name", "o_orderkey")


@query("J04_dictionary_lookup", """
  SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""")
def j04(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    named = joins.lookup(table(spark, d, "supplier"), nation, ["s_nationkey"])
    return joins.lookup(named, region, ["n_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("J05_semi_by_derived_set", """
  SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (
    SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)""")
def j05(spark, d):
    big = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("q")).filter("q > 200")
    return joins.semi(table(spark, d, "orders").select("o_orderkey", "o_custkey"), big, ["o_orderkey"])


@query("J06_anti", """
  SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09)""")
def j06(spark, d):
    hit = table(spark, d, "lineitem").filter("l_discount >= 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return joins.anti(table(spark, d, "part").select("p_partkey", "p_name"), hit, ["p_partkey"])


@query("J07_relational_division", """
  SELECT DISTINCT l_orderkey AS entity FROM lineitem WHERE l_orderkey NOT IN (
    SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40))""")
def j07(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("document"))
    allowed = table(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("document"))
    return joins.division(bridge, "entity", "document", allowed)


@query("J08_expand_by_document", """
  WITH lab AS (SELECT c_custkey AS entity, c_mktsegment AS attribute FROM customer),
       bridge AS (SELECT o_custkey AS entity, o_orderkey AS document FROM orders)
  SELECT entity, attribute, document, (SELECT count(*) FROM lab WHERE entity NOT IN (SELECT entity FROM bridge)) AS missing
  FROM lab JOIN bridge USING (entity)""")
def j08(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("attribute"))
    bridge = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("document"))
    rows, missing = joins.expand_by_document(labels, bridge, "entity")
    return rows.withColumn("missing", missing.scalar())


@query("J14_related_pairs_in_group", f"""
  WITH {v.FACTS}, {v.RELATION}, held AS (SELECT DISTINCT entity, attribute FROM facts),
  sym AS (SELECT attribute AS x, antonym AS y FROM relation UNION SELECT antonym, attribute FROM relation),
  pairs AS (SELECT a.attribute AS "first", b.attribute AS "second", count(*) AS entities
    FROM held a JOIN held b USING (entity) JOIN sym ON a.attribute = sym.x AND b.attribute = sym.y
    WHERE a.attribute < b.attribute GROUP BY ALL),
  total AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM held GROUP BY entity))
  SELECT "first", "second", entities, round(100.0 * entities / (SELECT t FROM total), 6) AS pct FROM pairs""")
def j14(spark, d):
    f = v.facts(spark, d)
    pairs = joins.antonym_pairs(f, v.relation(spark, d), "entity", "attribute")
    total = joins.pair_total(f, "entity", "attribute").scalar()
    return pairs.withColumn("pct", F.round(F.lit(100.0) * F.col("entities") / total, 6))


@query("J16_first_match_with_default", """
  WITH c AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations)
  SELECT conv_id, turn, coalesce('m/' || length(list_filter(ls, lambda x: length(x) > 60)[1])::VARCHAR, '') AS link FROM c""")
def j16(spark, d):
    conv = table(spark, d, "conversations")
    cast = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("name"), F.length(x).alias("person")))
    rows = conv.select("conv_id", "turn", cast.alias("cast"))
    return joins.first_match(
        rows, "conv_id", "cast", lambda c: c["person"] > 60,
        lambda c: F.concat(F.lit("m/"), c["person"].cast("string")), "", "link",
    ).select("conv_id", "turn", "link")


# --- ordered operators --------------------------------------------------------------------


@query("W01_cumulative_share", """
  WITH f AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT part, n, (sum(n) OVER w)::BIGINT AS running, round(100.0 * sum(n) OVER w / (SELECT count(*) FROM lineitem), 6) AS share
  FROM f WINDOW w AS (ORDER BY n DESC, part ROWS UNBOUNDED PRECEDING)""")
def w01(spark, d):
    freq = setops.frequency(table(spark, d, "lineitem").select(F.col("l_partkey").alias("part")), "part")
    return ordered.cumulative_share(freq, "part", "n").withColumn("share", F.round("share", 6))


@query("W02_keep_first", f"""
  WITH {v.votes_sql(True)}, {v.ONE_VOTE} SELECT unit, worker, answer, event_id FROM one_vote""")
def w02(spark, d):
    from docattr.functions.answers import ambiguity

    votes = v.votes(spark, d, dense=True)
    return ordered.keep_first(votes, ["unit", "worker"], [ambiguity(F.col("answer")), "event_id"]).select(
        "unit", "worker", "answer", "event_id")


@query("W03_first_k", """
  SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 3""")
def w03(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    return ordered.first_k(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3).drop("l_suppkey")


@query("W04_islands", """
  WITH s AS (SELECT doc_id, seg_no, contains(text, 'the') OR contains(text, 'de') AS flag FROM (
         SELECT doc_id, generate_subscripts(ls, 1) - 1 AS seg_no, unnest(ls) AS text
         FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
  g AS (SELECT doc_id, seg_no, seg_no - row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS grp FROM s WHERE flag)
  SELECT doc_id, min(seg_no)::INT AS lo, max(seg_no)::INT AS hi FROM g GROUP BY doc_id, grp""")
def w04(spark, d):
    flags = F.transform(F.split("text", "\n"), lambda x: x.contains("the") | x.contains("de"))
    return table(spark, d, "documents").select("doc_id", F.explode(ordered.islands(flags)).alias("r")).select(
        "doc_id", "r.lo", "r.hi")


LINE_SIZES = """ls AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query("W05_prefix_offsets", f"""
  WITH {LINE_SIZES}
  SELECT doc_id, pos::INT AS pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM ls""")
def w05(spark, d):
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    return table(spark, d, "documents").select("doc_id", F.posexplode(ordered.offsets(sizes)).alias("pos", "start"))


PACK = f"""{LINE_SIZES},
  sz AS (SELECT doc_id, list({v.wc_sql('line')} ORDER BY pos) AS w FROM ls GROUP BY doc_id),
  rec AS (
    SELECT doc_id, w, 1 AS i, 0 AS grp, w[1] AS running FROM sz
    UNION ALL
    SELECT doc_id, w, i + 1, CASE WHEN running + w[i + 1] < 25 THEN grp ELSE grp + 1 END,
           CASE WHEN running + w[i + 1] < 25 THEN running + w[i + 1] ELSE w[i + 1] END
    FROM rec WHERE i < len(w)),
  packed AS (SELECT doc_id, i - 1 AS pos, grp FROM rec)"""


@query("W06_greedy_packing", f"""
  WITH RECURSIVE {PACK}
  SELECT doc_id, pos::INT AS pos, grp::INT AS grp FROM packed""")
def w06(spark, d):
    sizes = F.transform(F.split("text", "\n"), lambda x: tx.word_count(x))
    return table(spark, d, "documents").select("doc_id", F.posexplode(ordered.pack_min(sizes, 25)).alias("pos", "grp"))


@query("W07_budget_prefix", f"""
  WITH {LINE_SIZES}, c AS (
    SELECT doc_id, sum({v.wc_sql('line')}) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM ls)
  SELECT doc_id, count(*) FILTER (total <= 250)::INT AS taken FROM c GROUP BY doc_id""")
def w07(spark, d):
    sizes = F.transform(F.split("text", "\n"), lambda x: tx.word_count(x))
    return table(spark, d, "documents").select("doc_id", ordered.budget_prefix(sizes, 250).alias("taken"))


@query("W08_context_order", f"""
  WITH {LINE_SIZES}
  SELECT doc_id,
    array_to_string(list(pos ORDER BY pos), ',') AS "first",
    array_to_string(list(pos ORDER BY pos DESC), ',') AS "last",
    array_to_string(list(pos ORDER BY {v.h_sql(2050, 'doc_id', 'pos')}), ',') AS "random"
  FROM ls GROUP BY doc_id""")
def w08(spark, d):
    n = F.size(F.split("text", "\n"))
    return table(spark, d, "documents").select("doc_id", *[
        F.array_join(ordered.order_for(s, n, F.col("doc_id")).cast("array<string>"), ",").alias(s)
        for s in ("first", "last", "random")
    ])


TRIP_SQL = """
  WITH r AS (SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (
      PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING) AS bad FROM events)
  SELECT user_id, min(event_id) AS tripped_at FROM r WHERE bad = 3 GROUP BY user_id"""


@query("W09_failure_breaker", TRIP_SQL)
def w09(spark, d):
    return ordered.trip_after(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", 3)


@query("W10_gold_position", f"""
  WITH b AS (SELECT p_partkey, list_distinct([p_brand, 'Brand#1', 'Brand#7', 'Brand#13', 'Brand#21']) AS o, p_brand FROM part),
  s AS (SELECT p_partkey, p_brand, [x.o FOR x IN list_sort([{{'h': {v.h_sql(5, 'p_partkey', 'y')}, 'o': y}} FOR y IN o])] AS o FROM b)
  SELECT p_partkey, array_to_string(o, ',') AS options, list_position(o, p_brand)::INT AS gold FROM s""")
def w10(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    options = F.array_distinct(F.array("p_brand", *[F.lit(f"Brand#{i}") for i in (1, 7, 13, 21)]))
    shuffled, gold = ordered.gold_index(options, F.col("p_brand"), 5, F.col("p_partkey"))
    return part.select("p_partkey", F.array_join(shuffled, ",").alias("options"), gold.alias("gold"))


@query("W11_rank_by_absolute_similarity", """
  WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS sim FROM embeddings)
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY abs(sim) DESC, vec_id) AS rank FROM e""")
def w11(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("sim"))
    return ordered.rank_abs(e, ["label"], "sim", "vec_id").select("vec_id", "label", "rank")


# --- sort, top-k and sets -----------------------------------------------------------------


@query("O01_multi_key_sort", """
  SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, o_orderkey""")
def o01(spark, d):
    return setops.sort(
        table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"),
        "o_orderstatus", F.col("o_orderpriority").desc(), "o_orderkey",
    )


@query("O02_keep_top_k", """
  SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (
    SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 100)""")
def o02(spark, d):
    return setops.keep_top_k(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_partkey", 100)


@query("O03_sorted_distinct", "SELECT DISTINCT p_name FROM part ORDER BY p_name")
def o03(spark, d):
    return setops.distinct_sorted(table(spark, d, "part"), "p_name")


@query("U01_union_tagged", """
  SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, 1 AS label, 'customer' AS kind FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_nationkey, 0, 'supplier' FROM supplier""")
def u01(spark, d):
    def side(name, p, key):
        return table(spark, d, name).select(
            F.col(key).alias("key"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nation"))

    return setops.union_tagged([
        (side("customer", "c", "c_custkey"), {"label": 1, "kind": "customer"}),
        (side("supplier", "s", "s_suppkey"), {"label": 0, "kind": "supplier"}),
    ])


@query("U02_distinct_subset", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def u02(spark, d):
    return setops.dedupe(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"])


@query("U03_set_algebra", """
  WITH a AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 10),
       b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05)
  SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
    (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a,
    (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS common,
    NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS a_contains_b,
    round(100.0 * (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) / (SELECT count(*) FROM b), 6) AS coverage""")
def u03(spark, d):
    a = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("k"))
    b = table(spark, d, "lineitem").filter("l_discount > 0.05").select(F.col("l_partkey").alias("k"))
    return setops.set_algebra(a, b).withColumn("coverage", F.round("coverage", 6))


@query("P09_partition_label", """
  SELECT doc_id, source, CASE WHEN source IN ('src0','src1','src2') THEN quality ELSE toxic END AS label
  FROM labels JOIN documents USING (doc_id)""")
def p09(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    part = F.when(F.col("source").isin("src0", "src1", "src2"), "test").otherwise("train")
    return rows.select("doc_id", "source", partition_label(part, F.col("quality"), F.col("toxic")).alias("label"))
