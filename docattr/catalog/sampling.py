"""Seeded sampling on the given tables."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.registry import query, table
from docattr.functions import text as tx
from docattr.operators import sampling as sm


@query("R01_fixed_size_sample", f"""
  SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 100000 ORDER BY {v.h_sql(2024, 'o_orderkey')}, o_orderkey LIMIT 100""")
def r01(spark, d):
    orders = table(spark, d, "orders").filter("o_totalprice >= 100000").select("o_orderkey", "o_custkey")
    return sm.sample_n(orders, ["o_orderkey"], 100, 2024)


ROWS = f"""{v.FACTS}, {v.RELATION}, pos AS (SELECT DISTINCT entity, document, attribute FROM facts),
  held AS (SELECT DISTINCT entity, attribute FROM facts)"""


def negatives_sql(words, held="", none=""):
    return f"""
  WITH {ROWS},
  vocab AS (SELECT list(attribute ORDER BY attribute) AS vs FROM {words}),
  free AS (SELECT entity, list_filter(vs, lambda x: NOT list_contains(h, x)) AS f FROM (SELECT entity, list(attribute) AS h FROM held GROUP BY entity), vocab),
  anto AS (SELECT p.entity, p.document, p.attribute, arg_min(antonym, {v.h_sql(12, 'p.entity', 'p.document', 'p.attribute', 'antonym')}) AS anto
    FROM pos p JOIN relation r ON r.attribute = p.attribute AND r.antonym <> p.attribute
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.entity = p.entity AND h.attribute = r.antonym) GROUP BY ALL),
  pick AS (SELECT p.entity, p.document, CASE WHEN anto IS NOT NULL AND (len(f) = 0 OR {v.u_sql(11, 'p.entity', 'p.document', 'p.attribute')} < 0.5) THEN anto
      ELSE f[floor({v.u_sql(13, 'p.entity', 'p.document', 'p.attribute')} * len(f))::INT + 1] END AS attribute
    FROM pos p JOIN free USING (entity) LEFT JOIN anto a ON a.entity = p.entity AND a.document = p.document AND a.attribute = p.attribute WHERE len(f) > 0 OR anto IS NOT NULL)
  SELECT entity, document, attribute{held}, 1 AS label FROM pos UNION ALL SELECT DISTINCT entity, document, attribute{none}, 0 FROM pick"""


@query("R02_inject_negatives", negatives_sql("(SELECT DISTINCT attribute FROM facts)"))
def r02(spark, d):
    return sm.inject_negatives(
        v.facts(spark, d), ["entity", "document", "attribute"], "entity", "attribute", v.relation(spark, d), 11)


@query("R02_negatives_of_vocabulary", negatives_sql(
    "(SELECT p_brand AS attribute FROM part UNION SELECT p_type FROM part)", ", 'holds ' || attribute AS note", ", NULL"))
def r02b(spark, d):
    part = table(spark, d, "part")
    vocab = part.select(F.col("p_brand").alias("attribute")).unionByName(part.select(F.col("p_type").alias("attribute")))
    facts = v.facts(spark, d).withColumn("note", F.concat(F.lit("holds "), "attribute"))
    return sm.inject_negatives(
        facts, ["entity", "document", "attribute"], "entity", "attribute", v.relation(spark, d), 11, vocab=vocab, blank=["note"])


MULTI = f"""{v.FACTS}, {v.RELATION}, held AS (SELECT DISTINCT entity, attribute FROM facts),
  own AS (SELECT h.entity, h.attribute, r.antonym AS o FROM held h JOIN relation r ON r.attribute = h.attribute AND r.antonym <> h.attribute
    WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.entity = h.entity AND x.attribute = r.antonym)),
  chosen AS (SELECT entity, attribute, list(o ORDER BY o) AS antos FROM (
    SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY {v.h_sql(21, 'entity', 'attribute', 'o')}, o) <= 2) GROUP BY ALL),
  ex AS (SELECT DISTINCT entity, o FROM (SELECT entity, attribute AS o FROM held UNION ALL SELECT entity, o FROM own)),
  freq AS (SELECT attribute AS o, count(*) AS w FROM held GROUP BY 1),
  wts AS (SELECT o, w, sum(w) OVER (ORDER BY o) - w AS lo FROM freq),
  rws AS (SELECT h.entity, h.attribute, coalesce(antos, []) AS antos, 4 - coalesce(len(antos), 0) AS need
    FROM held h LEFT JOIN chosen c ON c.entity = h.entity AND c.attribute = h.attribute),
  free AS (SELECT e.entity, q.o, q.w, sum(q.w) OVER (PARTITION BY e.entity ORDER BY q.o) - q.w AS lo
    FROM (SELECT DISTINCT entity FROM held) e CROSS JOIN freq q LEFT JOIN ex ON ex.entity = e.entity AND ex.o = q.o WHERE ex.o IS NULL),
  sums AS (SELECT entity, sum(w) AS free FROM free GROUP BY entity),
  s0 AS (SELECT r.*, coalesce(free, 0)::BIGINT AS free, []::STRUCT(lo BIGINT, w BIGINT, o VARCHAR, rd INT)[] AS ps
    FROM rws r LEFT JOIN sums USING (entity)),"""

# one round: a point on what is left, moved past this row's earlier picks (sorted by place)
for _n in range(1, 5):
    MULTI += f"""
  t{_n} AS (SELECT *, floor({v.u_sql(22, 'entity', 'attribute', _n)} * free)::BIGINT AS t FROM s{_n - 1} WHERE len(ps) < need AND free > 0),
  a{_n} AS (SELECT * EXCLUDE (t), t + coalesce(list_sum([p.w FOR p, i IN ps
    IF p.lo - coalesce(list_sum([e.w FOR e IN ps[:i - 1]]), 0) <= t]), 0)::BIGINT AS t FROM t{_n}),
  s{_n} AS (SELECT a.entity, a.attribute, antos, need, free - f.w AS free,
      list_sort(list_append(ps, {{'lo': f.lo::BIGINT, 'w': f.w, 'o': f.o, 'rd': {_n}}})) AS ps
    FROM a{_n} a ASOF JOIN free f ON a.entity = f.entity AND a.t >= f.lo
    UNION ALL SELECT entity, attribute, antos, need, free, ps FROM s{_n - 1} WHERE NOT (len(ps) < need AND free > 0)),"""
MULTI += f"""
  filled AS (SELECT entity, attribute, [attribute] || antos || [x.o FOR x IN list_sort([{{'rd': p.rd, 'o': p.o}} FOR p IN ps])] AS opts FROM s4),
  mixed AS (SELECT entity, attribute, [s.o FOR s IN list_sort([{{'h': {v.h_sql(24, 'entity', 'y')}, 'o': y}} FOR y IN opts])] AS opts FROM filled)"""


@query("R03_multiclass_samples", f"""
  WITH {MULTI} SELECT entity, attribute, array_to_string(opts, ',') AS options, list_position(opts, attribute)::INT AS label FROM mixed""")
def r03(spark, d):
    out = sm.multiclass_samples(v.facts(spark, d), "entity", "attribute", v.relation(spark, d), 21)
    return out.withColumn("options", F.array_join("options", ","))


@query("R04_seeded_shuffle", f"""
  SELECT doc_id, row_number() OVER (ORDER BY {v.h_sql(3, 'doc_id')}, doc_id) - 1 AS position FROM documents""")
def r04(spark, d):
    return sm.shuffle(table(spark, d, "documents").select("doc_id"), ["doc_id"], 3)


@query("R05_best_split", f"""
  WITH {v.FACTS}, members AS (SELECT o_custkey AS comp, attribute FROM (SELECT DISTINCT entity, attribute FROM facts) JOIN orders ON o_orderkey = entity),
  cnt AS (SELECT comp, attribute, count(*) AS n FROM members GROUP BY ALL),
  comps AS (SELECT DISTINCT comp FROM cnt), nc AS (SELECT count(*) AS n FROM comps),
  rk AS (SELECT trial, comp, row_number() OVER (PARTITION BY trial ORDER BY {v.h_sql(9, 'trial', 'comp')}, comp) - 1 AS r FROM comps, (SELECT unnest(range(0, 20)) AS trial)),
  split AS (SELECT trial, comp, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.6) + floor(n * 0.2) THEN 'dev' ELSE 'test' END AS partition FROM rk, nc),
  sums AS (SELECT trial, partition, attribute, sum(n) AS n FROM split JOIN cnt USING (comp) GROUP BY ALL),
  dist AS (SELECT *, n / (sum(n) OVER (PARTITION BY trial, partition))::DOUBLE AS p FROM sums),
  top AS (SELECT attribute FROM cnt GROUP BY 1 ORDER BY sum(n) DESC, attribute LIMIT 10),
  kl AS (SELECT a.trial, sum(a.p * ln(a.p / b.p)) AS divergence FROM dist a JOIN dist b ON a.trial = b.trial AND a.attribute = b.attribute AND b.partition = 'train'
    WHERE a.partition <> 'train' AND a.attribute IN (SELECT attribute FROM top) GROUP BY a.trial),
  best AS (SELECT trial, divergence FROM kl ORDER BY divergence, trial LIMIT 1)
  SELECT comp, partition, round(divergence, 6) AS divergence FROM split JOIN best USING (trial)""")
def r05(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("comp"))
    members = v.facts(spark, d).select("entity", "attribute").distinct().join(orders, "entity")
    return sm.best_split(members, "comp", "attribute", 0.6, 0.2, 10, 20, 9).withColumn("divergence", F.round("divergence", 6))


def few_sql(group):
    """Ring picks: own group if large enough, else all rows."""
    def ring(name, part, seed_tag):
        over = f"PARTITION BY {part}, quality" if part else "PARTITION BY quality"
        return f"""
  {name}_r AS (SELECT *, row_number() OVER ({over} ORDER BY {v.h_sql(31, 'doc_id')}, doc_id) - 1 AS i, count(*) OVER ({over}) AS size FROM rws),
  {name}_s AS (SELECT DISTINCT {part + ',' if part else ''} quality, size FROM {name}_r),
  {name}_a AS (SELECT a.doc_id, s.quality AS want, s.size, {'a.' + part + ' AS grp,' if part else "'' AS grp,"}
      floor((('0x' || substr(md5('31-{seed_tag}-' || s.quality || '|' || a.doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * s.size)::BIGINT AS st
    FROM rws a JOIN {name}_s s ON {'s.' + part + ' = a.' + part if part else 'true'}),
  {name}_h AS (SELECT a.doc_id, a.want, k, r.doc_id AS ex FROM (SELECT *, unnest(range(0, least(CASE want WHEN 1 THEN 2 ELSE 1 END, size - 1) + 1)) AS k FROM {name}_a) a
    JOIN {name}_r r ON r.quality = a.want AND r.i = (a.st + a.k) % a.size {'AND r.' + part + ' = a.grp' if part else ''} WHERE r.doc_id <> a.doc_id),
  {name}_l AS (SELECT doc_id, want, list(ex ORDER BY k)[:CASE want WHEN 1 THEN 2 ELSE 1 END] AS l FROM {name}_h GROUP BY doc_id, want)"""

    rings = ring("f", None, "all") + ("," + ring("g", group, group) if group else "")
    if group:
        pick = """SELECT f.doc_id, f.want, CASE WHEN len(g.l) >= CASE f.want WHEN 1 THEN 2 ELSE 1 END THEN g.l ELSE f.l END AS l
      FROM f_l f LEFT JOIN g_l g ON g.doc_id = f.doc_id AND g.want = f.want"""
    else:
        pick = "SELECT * FROM f_l"
    return f"""
  WITH rws AS (SELECT doc_id, quality, source, lang FROM labels JOIN documents USING (doc_id)), {rings},
  pick AS ({pick}), both_ AS (SELECT doc_id, unnest(l) AS ex FROM pick)
  SELECT r.doc_id, coalesce(string_agg(ex::VARCHAR, ',' ORDER BY {v.h_sql(40, 'r.doc_id', 'ex')}), '') AS examples FROM rws r LEFT JOIN both_ b ON b.doc_id = r.doc_id GROUP BY r.doc_id"""


def few(spark, d, group):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    rows = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "quality", "source", "lang")
    out = sm.few_shot(rows, "doc_id", "quality", 3, 31, group)
    return out.select("doc_id", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("R06_few_shot_random", few_sql(None))
def r06(spark, d):
    return few(spark, d, None)


@query("R06_few_shot_entity", few_sql("source"))
def r06b(spark, d):
    return few(spark, d, "source")


@query("R06_few_shot_attribute", few_sql("lang"))
def r06c(spark, d):
    return few(spark, d, "lang")


@query("R07_pick_three", f"""
  WITH p AS (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY {v.h_sql(4, 'o_custkey', 'o_orderkey')})[:3] AS l FROM orders GROUP BY o_custkey)
  SELECT o_custkey, coalesce(l[1], '') AS first, coalesce(l[2], '') AS "second", coalesce(l[3], '') AS third FROM p""")
def r07(spark, d):
    picked = sm.pick_n(table(spark, d, "orders"), "o_custkey", "o_orderkey", 3, 4)
    return picked.select("o_custkey", *tx.pad_columns(F.col("items"), ["first", "second", "third"]))


@query("R08_repeated_runs", "SELECT conv_id, turn, run::INT AS run FROM conversations, (SELECT unnest([1, 2, 3]) AS run)")
def r08(spark, d):
    return sm.repeat_runs(table(spark, d, "conversations").select("conv_id", "turn"), 3)
