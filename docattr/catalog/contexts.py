"""Paragraphs, contexts and masks on documents."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.mentions import MENTIONS, roster
from docattr.catalog.registry import query, table
from docattr.operators import ordered, spans as sp
from docattr.plans import contexts as plan

PARAS = f"""{MENTIONS},
  isl AS (SELECT doc_id, entity, seg_no, seg_no - row_number() OVER (PARTITION BY doc_id, entity ORDER BY seg_no) AS grp
    FROM (SELECT DISTINCT doc_id, entity, seg_no FROM mentions)),
  pseg AS (SELECT i.doc_id, i.entity, i.grp, i.seg_no, s.text,
      sum(length(s.text) + 1) OVER (PARTITION BY i.doc_id, i.entity, i.grp ORDER BY i.seg_no) - length(s.text) - 1 AS off
    FROM isl i JOIN segments s ON s.doc_id = i.doc_id AND s.seg_no = i.seg_no),
  para AS (SELECT doc_id, entity, grp, row_number() OVER (PARTITION BY doc_id, entity ORDER BY min(seg_no)) - 1 AS para_no,
      string_agg(text, ' ' ORDER BY seg_no) AS text FROM pseg GROUP BY doc_id, entity, grp),
  pspan AS (SELECT m.doc_id, m.entity, p.grp, ("start" + off)::BIGINT AS s, ("end" + off)::BIGINT AS e
    FROM mentions m JOIN pseg p ON p.doc_id = m.doc_id AND p.entity = m.entity AND p.seg_no = m.seg_no)"""

CLEAN = f"""{PARAS},
  gaps AS (SELECT p.doc_id, p.entity, p.grp, p.para_no, p.text, s, e, substr(p.text, s + 1, e - s) AS nm,
      regexp_replace(substr(p.text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)), '\\s+', ' ', 'g') AS gap
    FROM para p JOIN pspan x ON x.doc_id = p.doc_id AND x.entity = p.entity AND x.grp = p.grp
    WINDOW w AS (PARTITION BY p.doc_id, p.entity, p.grp ORDER BY s)),
  cpara AS (SELECT doc_id, entity, para_no, string_agg(gap || nm, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS text FROM gaps GROUP BY doc_id, entity, para_no),
  cspan AS (SELECT doc_id, entity, para_no, sum(length(gap) + length(nm)) OVER w - length(nm) AS s, sum(length(gap) + length(nm)) OVER w AS e
    FROM gaps WINDOW w AS (PARTITION BY doc_id, entity, para_no ORDER BY s))"""

JOINED = f"""{CLEAN},
  poff AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, entity ORDER BY para_no) - length(text) - 1 AS off FROM cpara),
  jtext AS (SELECT doc_id, entity, string_agg(text, chr(10) ORDER BY para_no) AS text FROM cpara GROUP BY doc_id, entity),
  jspan AS (SELECT c.doc_id, c.entity, (s + off)::INT AS s, (e + off)::INT AS e FROM cspan c
    JOIN poff o ON o.doc_id = c.doc_id AND o.entity = c.entity AND o.para_no = c.para_no)"""


def show(spans):
    """Spans as text ``start-end;...`` for comparison."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")


SHOW = "string_agg(s || '-' || e, ';' ORDER BY s)"


def rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sp.entity_rows(docs, roster(spark, d), "doc_id")


def segments(spark, d):
    return plan.entity_segments(table(spark, d, "documents").select("doc_id", "text"), roster(spark, d))


def _paragraph_rows(paras):
    return paras.select("doc_id", "entity", F.posexplode("paragraphs").alias("para_no", "p")).select(
        "doc_id", "entity", "para_no", "p.text", show(F.col("p.spans")).alias("spans"))


@query("M10_paragraphs", f"""
  WITH {PARAS} SELECT p.doc_id, p.entity, p.para_no::INT AS para_no, p.text, x.spans FROM para p
  JOIN (SELECT doc_id, entity, grp, {SHOW} AS spans FROM pspan GROUP BY ALL) x ON x.doc_id = p.doc_id AND x.entity = p.entity AND x.grp = p.grp""")
def m10(spark, d):
    return _paragraph_rows(sp.paragraphs(rows(spark, d), clean=False))


@query("M11_clean_between_spans", f"""
  WITH {CLEAN} SELECT p.doc_id, p.entity, p.para_no::INT AS para_no, p.text, x.spans FROM cpara p
  JOIN (SELECT doc_id, entity, para_no, {SHOW} AS spans FROM cspan GROUP BY ALL) x ON x.doc_id = p.doc_id AND x.entity = p.entity AND x.para_no = p.para_no""")
def m11(spark, d):
    return _paragraph_rows(sp.paragraphs(rows(spark, d)))


@query("M12_entity_segments", f"""
  WITH {JOINED} SELECT t.doc_id, t.entity, t.text, x.spans FROM jtext t
  JOIN (SELECT doc_id, entity, {SHOW} AS spans FROM jspan GROUP BY ALL) x ON x.doc_id = t.doc_id AND x.entity = t.entity""")
def m12(spark, d):
    return segments(spark, d).withColumn("spans", show(F.col("spans")))


PACKED = f"""{JOINED},
  jl AS (SELECT doc_id, entity, string_split(text, chr(10)) AS ls FROM jtext),
  jw AS (SELECT doc_id, entity, ls, [{v.wc_sql('x')} FOR x IN ls] AS w FROM jl),
  pk AS (
    SELECT doc_id, entity, ls, w, 1 AS i, 0 AS grp, w[1] AS running FROM jw
    UNION ALL
    SELECT doc_id, entity, ls, w, i + 1, CASE WHEN running + w[i + 1] < 25 THEN grp ELSE grp + 1 END,
      CASE WHEN running + w[i + 1] < 25 THEN running + w[i + 1] ELSE w[i + 1] END FROM pk WHERE i < len(w)),
  pl AS (SELECT doc_id, entity, grp, i, ls[i] AS line, sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id, entity ORDER BY i) - length(ls[i]) - 1 AS off FROM pk),
  pp AS (SELECT doc_id, entity, grp, string_agg(line, chr(10) ORDER BY i) AS text, min(off) AS lo FROM pl GROUP BY doc_id, entity, grp),
  pw AS (SELECT *, {v.wc_sql('text')} AS words FROM pp),
  ps AS (SELECT p.doc_id, p.entity, p.grp, s - lo AS s, e - lo AS e FROM jspan j JOIN pw p ON p.doc_id = j.doc_id AND p.entity = j.entity AND s >= lo AND e <= lo + length(text))"""


@query("J12_spans_in_paragraphs", f"""
  WITH RECURSIVE {PACKED} SELECT p.doc_id, p.entity, p.grp::INT AS para_no, p.words::INT AS words, p.text, coalesce(x.spans, '') AS spans FROM pw p
  LEFT JOIN (SELECT doc_id, entity, grp, {SHOW} AS spans FROM ps GROUP BY ALL) x ON x.doc_id = p.doc_id AND x.entity = p.entity AND x.grp = p.grp""")
def j12(spark, d):
    parts = segments(spark, d).select(
        "doc_id", "entity", F.posexplode(sp.split_paragraphs(F.col("text"), F.col("spans"), 25)).alias("para_no", "p"))
    return parts.select("doc_id", "entity", "para_no", "p.words", "p.text", show(F.col("p.spans")).alias("spans"))


def context_sql(order, budget):
    return f"""
  WITH RECURSIVE {PACKED},
  o AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, entity ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS total FROM pw),
  picked AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, entity ORDER BY grp) - length(text) - 1 AS base FROM o WHERE total <= {budget}),
  cs AS (SELECT ps.doc_id, ps.entity, s + base AS s, e + base AS e FROM ps JOIN picked k ON k.doc_id = ps.doc_id AND k.entity = ps.entity AND k.grp = ps.grp),
  n AS (SELECT doc_id, entity, count(*) AS n FROM pw GROUP BY ALL)
  SELECT n.doc_id, n.entity, coalesce(t.text, '') AS text, coalesce(x.spans, '') AS spans, coalesce(t.taken, 0)::INT AS taken, (n - coalesce(t.taken, 0))::INT AS excluded
  FROM n LEFT JOIN (SELECT doc_id, entity, string_agg(text, chr(10) ORDER BY grp) AS text, count(*) AS taken FROM picked GROUP BY ALL) t ON t.doc_id = n.doc_id AND t.entity = n.entity
  LEFT JOIN (SELECT doc_id, entity, {SHOW} AS spans FROM cs GROUP BY ALL) x ON x.doc_id = n.doc_id AND x.entity = n.entity"""


def _contexts(spark, d, strategy):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = plan.entity_contexts(docs, roster(spark, d), budget=100, strategy=strategy)
    return out.withColumn("spans", show(F.col("spans")))


@query("M13_contexts_first", context_sql("grp", 100))
def m13(spark, d):
    return _contexts(spark, d, "first")


@query("M13_contexts_last", context_sql("grp DESC", 100))
def m13b(spark, d):
    return _contexts(spark, d, "last")


@query("M13_contexts_random", context_sql(v.h_sql(2050, "doc_id || '|' || entity", "grp"), 100))
def m13c(spark, d):
    return _contexts(spark, d, "random")


BUDGETS = [25, 50, 100, 200, 400]
ORDERS = {"first": "grp", "last": "grp DESC", "random": v.h_sql(2050, "doc_id || '|' || entity", "grp")}
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995}


@query("A24_context_lengths", f"""
  WITH RECURSIVE {PACKED},
  t AS ({" UNION ALL ".join(
      f"SELECT doc_id, entity, '{s}' AS strategy, sum(words) OVER (PARTITION BY doc_id, entity ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS total FROM pw"
      for s, o in ORDERS.items())}),
  u AS (SELECT doc_id, entity, strategy, budget, coalesce(max(total) FILTER (total <= budget), 0) AS words
    FROM t, (SELECT unnest({BUDGETS}) AS budget) GROUP BY ALL)
  SELECT strategy, budget, count(*) AS n, max(words)::BIGINT AS max,
    {", ".join(f"round(quantile_cont(words, {q}), 6) AS {n}" for n, q in QUANTILES.items())} FROM u GROUP BY ALL""")
def a24b(spark, d):
    from docattr.operators import stats

    lengths = plan.context_lengths(segments(spark, d), list(ORDERS), BUDGETS)
    out = stats.length_profile(lengths, ["strategy", "budget"], "words", QUANTILES)
    return out.withColumns({n: F.round(n, 6) for n in QUANTILES})


# Similarity of a paragraph to an attribute: a seeded value in [-0.2, 0.2), as a caller's encoder would give.
SIM = v.u_sql(77, "doc_id", "entity", "grp") + " * 0.4 - 0.2"


@query("W08_similarity_contexts", f"""
  WITH RECURSIVE {PACKED},
  sc AS (SELECT *, {SIM} AS sim FROM pw),
  o AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, entity ORDER BY abs(sim) DESC, grp ROWS UNBOUNDED PRECEDING) AS total FROM sc WHERE sim <= -0.05 OR sim >= 0.05)
  SELECT j.doc_id, j.entity, coalesce(string_agg(o.text, chr(10) ORDER BY o.grp) FILTER (total <= 100), '') AS text, (count(*) FILTER (total <= 100))::INT AS taken
  FROM jtext j LEFT JOIN o ON o.doc_id = j.doc_id AND o.entity = j.entity GROUP BY j.doc_id, j.entity""")
def w08b(spark, d):
    from docattr.functions.draws import uniform

    segs = segments(spark, d)
    n = F.size(sp.split_paragraphs(F.col("text"), F.col("spans"), 25))
    sims = F.transform(F.sequence(F.lit(0), n - 1), lambda i: uniform(77, "doc_id", "entity", i) * 0.4 - 0.2)
    scored = segs.select("doc_id", "entity", F.lit("attr").alias("attribute"), sims.alias("sims"))
    return plan.similarity_contexts(segs, scored, 100, 25, -0.05, 0.05).select("doc_id", "entity", "text", "taken")


@query("P21_entity_mask", f"""
  WITH {JOINED},
  g AS (SELECT t.doc_id, t.entity, t.text, s, e, len(regexp_extract_all(substr(t.text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)), '\\S+')) AS n0,
      len(regexp_extract_all(substr(t.text, s + 1, e - s), '\\S+')) AS n1
    FROM jtext t JOIN jspan j ON j.doc_id = t.doc_id AND j.entity = t.entity WINDOW w AS (PARTITION BY t.doc_id, t.entity ORDER BY s))
  SELECT doc_id, entity, '1' || string_agg(repeat('0', n0::INT) || repeat('1', n1::INT), '' ORDER BY s)
    || repeat('0', len(regexp_extract_all(substr(any_value(text), max(e) + 1), '\\S+'))::INT) AS mask FROM g GROUP BY doc_id, entity""")
def p21(spark, d):
    tokenize = lambda t: F.regexp_extract_all(t, F.lit(r"\S+"), 0)
    masked = sp.entity_mask(F.col("text"), F.col("spans"), F.col("entity"), tokenize)
    return segments(spark, d).select("doc_id", "entity", F.array_join(masked["mask"], "").alias("mask"))


@query("M13_document_contexts", f"""
  WITH RECURSIVE ls AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  sz AS (SELECT doc_id, list({v.wc_sql('line')} ORDER BY pos) AS w FROM ls GROUP BY doc_id),
  rec AS (SELECT doc_id, w, 1 AS i, 0 AS grp, w[1] AS running FROM sz UNION ALL
    SELECT doc_id, w, i + 1, CASE WHEN running + w[i + 1] < 25 THEN grp ELSE grp + 1 END,
      CASE WHEN running + w[i + 1] < 25 THEN running + w[i + 1] ELSE w[i + 1] END FROM rec WHERE i < len(w)),
  p AS (SELECT r.doc_id, grp, string_agg(line, chr(10) ORDER BY pos) AS text FROM rec r JOIN ls ON ls.doc_id = r.doc_id AND ls.pos = r.i - 1 GROUP BY r.doc_id, grp),
  t AS (SELECT *, sum({v.wc_sql('text')}) OVER (PARTITION BY doc_id ORDER BY grp DESC) AS total FROM p)
  SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY grp) FILTER (total <= 250), '') AS text, (count(*) FILTER (total <= 250))::INT AS taken FROM t GROUP BY doc_id""")
def m13d(spark, d):
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = table(spark, d, "documents").select("doc_id", sp.split_paragraphs(F.col("text"), none, 25).alias("parts"))
    order = ordered.order_for("last", F.size("parts"), F.col("doc_id"))
    return parts.select("doc_id", sp.build_context(F.col("parts"), order, 250).alias("c")).select("doc_id", "c.text", "c.taken")
