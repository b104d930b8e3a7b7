"""Components, splits and covers on the given tables."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.pages import ANCHOR
from docattr.catalog.registry import query, table
from docattr.functions.draws import uniform
from docattr.operators import graph, pages as pg

# Documents are linked through the lines they share: entity = line, document = text.
LINES = """lines AS (SELECT DISTINCT doc_id AS document, md5(l) AS entity FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))"""
COMPONENTS = f"""{LINES},
  ends AS (SELECT document AS d, 'e' || entity AS e FROM lines),
  links AS (SELECT 'd' || d AS u, e AS v FROM ends UNION ALL SELECT e, 'd' || d FROM ends),
  cc(n, r) USING KEY (n) AS (
    SELECT n, r FROM (SELECT 'd' || d AS n, min(d) AS r FROM ends GROUP BY d UNION ALL SELECT e, min(d) FROM ends GROUP BY e)
    UNION
    SELECT k.u AS n, min(c.r) AS r FROM cc c JOIN links k ON k.v = c.n JOIN recurring.cc cur ON cur.n = k.u WHERE c.r < cur.r GROUP BY k.u),
  roots AS (SELECT r, 'N' || lpad((row_number() OVER (ORDER BY r) - 1)::VARCHAR, length(count(*) OVER ()::VARCHAR)::INT, '0') AS component FROM (SELECT DISTINCT r FROM cc))"""


def bridge(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.explode(F.split("text", "\n")).alias("l"))
    return lines.select("document", F.md5("l").alias("entity")).distinct()


def found(spark, d):
    """Components with numeric documents padded so that their text order is their number order."""
    padded = bridge(spark, d).withColumn("document", F.lpad(F.col("document").cast("string"), 19, "0"))
    return graph.bipartite_components(padded, "entity", "document")


@query("G01_connected_components", f"""
  WITH RECURSIVE {COMPONENTS} SELECT CASE n[1] WHEN 'd' THEN 'd' ELSE 'e' END AS kind, n[2:] AS id, r AS root FROM cc""")
def g01(spark, d):
    out = found(spark, d)
    unpadded = F.when(F.col("kind") == "d", F.col("id").try_cast("long").cast("string")).otherwise(F.col("id"))
    return out.select("kind", unpadded.alias("id"), F.col("root").cast("long").alias("root"))


@query("G02_component_numbers", f"""
  WITH RECURSIVE {COMPONENTS} SELECT r AS root, component FROM roots""")
def g02(spark, d):
    ids = graph.number_components(found(spark, d), F.col("root"))
    return ids.select(F.col("root").cast("long").alias("root"), "component")


@query("G06_tagged_bridge", f"""
  WITH RECURSIVE {COMPONENTS} SELECT document, entity, component FROM lines JOIN cc ON n = 'd' || document JOIN roots USING (r)""")
def g06(spark, d):
    padded = bridge(spark, d).withColumn("document", F.lpad(F.col("document").cast("string"), 19, "0"))
    nodes = graph.bipartite_components(padded, "entity", "document")
    tagged = graph.tag_bridge(padded, "document", nodes, graph.number_components(nodes, F.col("root")))
    return tagged.select(F.col("document").cast("long").alias("document"), "entity", "component")


@query("G03_leakage_safe_split", f"""
  WITH b AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS document FROM lineitem),
  rws AS (SELECT DISTINCT l_orderkey AS entity, l_returnflag AS attribute FROM lineitem),
  t AS (SELECT DISTINCT entity FROM b WHERE {v.u_sql(6, 'entity')} < 0.01),
  res AS (SELECT DISTINCT document FROM b WHERE entity IN (SELECT entity FROM t)),
  e AS (SELECT entity, bool_or(document IN (SELECT document FROM res)) AS touch, bool_or(document NOT IN (SELECT document FROM res)) AS leak FROM b GROUP BY entity)
  SELECT entity, attribute, CASE WHEN entity IN (SELECT entity FROM t) AND {v.u_sql(8, 'entity', 'attribute')} < 0.6 THEN 'test'
    WHEN touch AND NOT leak THEN 'dev' WHEN NOT touch THEN 'train' END AS partition FROM rws JOIN e USING (entity)""")
def g03(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("document"), F.col("l_returnflag").alias("attribute"))
    test = lines.select("entity").distinct().filter(uniform(6, "entity") < 0.01)
    judged = (uniform(6, "entity") < 0.01) & (uniform(8, "entity", "attribute") < 0.6)
    rows = lines.select("entity", "attribute").distinct().withColumn("label", F.when(judged, 1))
    return graph.leakage_safe_split(lines, "entity", "document", test, rows, "attribute")


COVER = """
  WITH RECURSIVE b AS (SELECT DISTINCT s_nationkey AS d, l_partkey AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  lists AS (SELECT d, list(s) AS l FROM b GROUP BY d),
  walk AS (
    SELECT 0 AS step, NULL::INT AS d, 0::BIGINT AS gain, (SELECT list(DISTINCT s) FROM b) AS todo, [-1]::INT[] AS used
    UNION ALL
    (SELECT w.step + 1, x.d, len(list_intersect(x.l, w.todo))::BIGINT, list_filter(w.todo, lambda q: NOT list_contains(x.l, q)), list_append(w.used, x.d)
     FROM walk w, lists x WHERE len(w.todo) > 0 AND NOT list_contains(w.used, x.d)
     ORDER BY len(list_intersect(x.l, w.todo)) DESC, x.d LIMIT 1))
  SELECT d AS nation, step::BIGINT AS step, gain, round(100.0 * sum(gain) OVER (ORDER BY step) / (SELECT count(DISTINCT s) FROM b), 6) AS coverage FROM walk WHERE step > 0"""


@query("G04_greedy_cover", COVER)
def g04(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    covers = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(supplier, "l_suppkey")
    return graph.greedy_cover(covers, "nation", "l_partkey").withColumn("coverage", F.round("coverage", 6))


SCREEN = """
  WITH RECURSIVE b AS (SELECT DISTINCT o_custkey AS d, l_partkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  lists AS (SELECT d, list(s) AS l FROM b GROUP BY d),
  walk AS (
    SELECT 0 AS step, NULL::BIGINT AS d, 0::BIGINT AS gain, (SELECT list(DISTINCT s) FROM b) AS todo
    UNION ALL
    (SELECT w.step + 1, x.d, len(list_intersect(x.l, w.todo))::BIGINT AS g, list_filter(w.todo, lambda q: NOT list_contains(x.l, q))
     FROM walk w, lists x WHERE len(w.todo) > 0 ORDER BY g DESC, x.d LIMIT 1))
  SELECT d AS o_custkey, step::BIGINT AS step, gain, round(100.0 * sum(gain) OVER (ORDER BY step) / (SELECT count(DISTINCT s) FROM b), 6) AS coverage FROM walk WHERE step > 0"""


@query("G04_screening_cover", SCREEN)
def g04b(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey")
    return graph.greedy_cover(bought, "o_custkey", "l_partkey").withColumn("coverage", F.round("coverage", 6))


@query("G05_frontier_expansion", f"""
  WITH links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href FROM pages),
  edges AS (SELECT url, 'https://example.org' || href AS target FROM links WHERE contains(href, '/t'))
  SELECT page_id, url, 'main' AS rank FROM pages UNION
  SELECT p.page_id, target, 'link-1' FROM pages p JOIN edges e ON e.url = p.url""")
def g05(spark, d):
    from docattr.functions import html as h

    pages = table(spark, d, "pages")
    links = pg.links(pages, key="url").filter(F.col("href").contains("/t"))
    edges = links.select("url", h.absolute(F.col("href"), "https://example.org").alias("target"))
    return pg.expand_frontier(pages.select("page_id", "url"), edges, "page_id")
