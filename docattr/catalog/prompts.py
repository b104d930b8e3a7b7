"""Prompt and sample tables on documents, conversations and customers."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.contexts import JOINED, SHOW, segments, show
from docattr.catalog.registry import query, table
from docattr.catalog.sampling import few_sql
from docattr.operators import prompts as pr, sampling as sm
from docattr.operators.scoring import score_batches

DOC = pr.DOCUMENT_TEMPLATE
DEFS = "defs AS (SELECT lang AS attribute, 'texts written in ' || lang AS definition FROM documents GROUP BY lang)"


def sql_text(s):
    return "'" + s.replace("'", "''") + "'"


def fill_sql(template, *pairs):
    out = sql_text(template).replace("\n", "' || chr(10) || '")
    out = f"({out})"
    for name, value in pairs:
        out = f"replace({out}, '{name}', {value})"
    return out


def labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    labels = table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").alias("entity"), F.col("lang").alias("attribute"), F.col("quality").alias("label"))
    defs = docs.select(F.col("lang").alias("attribute"), F.concat(F.lit("texts written in "), "lang").alias("definition")).distinct()
    return docs, labels, defs


@query("M14_document_prompts", f"""
  WITH {DEFS} SELECT doc_id AS entity, lang AS attribute, quality AS label,
    {fill_sql(DOC, ('$ATTRIBUTE$', 'lang'), ('$ENTITY$', 'doc_id::VARCHAR'), ('$DEFINITION$', 'definition'), ('$TEXT$', 'text'))} AS prompt, 0::BIGINT AS missing
  FROM labels JOIN documents USING (doc_id) JOIN defs ON attribute = lang""")
def m14(spark, d):
    docs, labels, defs = labelled(spark, d)
    texts = docs.select(F.col("doc_id").alias("entity"), "text")
    rows, missing = pr.zero_shot_prompts(labels, texts, defs, "entity", "attribute")
    return rows.select("entity", "attribute", "label", "prompt").withColumn("missing", missing.scalar())


@query("M14_segment_prompts", f"""
  WITH {JOINED}, {DEFS}, l AS (SELECT doc_id, lang AS attribute, quality AS label FROM labels JOIN documents USING (doc_id))
  SELECT l.doc_id, t.entity AS name, l.attribute, l.label,
    {fill_sql(DOC, ('$ATTRIBUTE$', 'l.attribute'), ('$ENTITY$', 't.entity'), ('$DEFINITION$', 'definition'), ('$TEXT$', 't.text'))} AS prompt,
    (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM jtext)) AS missing
  FROM l JOIN jtext t ON t.doc_id = l.doc_id JOIN defs ON defs.attribute = l.attribute""")
def m14b(spark, d):
    _, labels, defs = labelled(spark, d)
    texts = segments(spark, d).select(F.col("doc_id").alias("entity"), F.col("entity").alias("name"), "text")
    rows, missing = pr.zero_shot_prompts(labels, texts, defs, "entity", "attribute", name="name")
    return rows.select(F.col("entity").alias("doc_id"), "name", "attribute", "label", "prompt").withColumn("missing", missing.scalar())


@query("M14_prior_prompts", f"""
  WITH t AS (SELECT n_name AS entity, r_name AS attribute, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS ts
    FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
  SELECT entity, attribute, {fill_sql(pr.PRIOR_TEMPLATE, ('$ENTITY$', 'entity'),
    ('$TITLES$', "CASE WHEN len(ts) = 1 THEN ts[1] ELSE array_to_string(ts[:-2], ', ') || ' and ' || ts[-1] END"),
    ('$ATTRIBUTE$', 'attribute'), ('$DEFINITION$', "'part of ' || attribute"))} AS prompt FROM t""")
def m14c(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    labels = nation.select(F.col("n_name").alias("entity"), F.col("r_name").alias("attribute"))
    known = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("t")).distinct()
    titles = known.groupBy("entity").agg(F.array_sort(F.collect_list("t")).alias("titles"))
    defs = table(spark, d, "region").select(F.col("r_name").alias("attribute"), F.concat(F.lit("part of "), "r_name").alias("definition"))
    return pr.prior_prompts(labels, titles, defs, "entity", "attribute").select("entity", "attribute", "prompt")


OPTIONS = ["able", "erin", "tion", "eau", "cht"]


@query("M15_option_prompts", f"""
  SELECT doc_id, k::INT AS option_no, o AS option, (k = doc_id % 5)::INT AS label,
    {fill_sql(pr.OPTION_TEMPLATE, ('$STORY$', 'text'), ('$CHARACTER$', 'source'), ('$ATTRIBUTE$', 'o'))} AS prompt
  FROM (SELECT *, unnest({OPTIONS}) AS o, unnest(range(0, 5)) AS k FROM documents)""")
def m15(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    samples = docs.withColumns({"options": F.array(*[F.lit(o) for o in OPTIONS]), "answer": (F.col("doc_id") % 5).cast("int")})
    rows = pr.option_prompts(samples, "options", "answer", {"$STORY$": F.col("text"), "$CHARACTER$": F.col("source")})
    return rows.select("doc_id", "option_no", "option", "label", "prompt")


@query("M16_dialogue_pack", """
  WITH t AS (SELECT conv_id, role = 'user' AS u, text, min(turn) AS o FROM conversations GROUP BY ALL)
  SELECT conv_id, trim('UTTERANCES:' || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY o) FILTER (u), '') || chr(10) || chr(10) || 'MENTIONS:' || chr(10)
    || coalesce(string_agg(text, chr(10) ORDER BY o) FILTER (NOT u), '')) AS text FROM t GROUP BY conv_id""")
def m16(spark, d):
    return pr.dialogue_pack(table(spark, d, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")


@query("M17_canonical_samples", f"""
  WITH {JOINED}, {DEFS}, x AS (SELECT doc_id, entity, {SHOW} AS spans FROM jspan GROUP BY ALL),
  l AS (SELECT doc_id, lang AS attribute, quality AS human, toxic AS weak, CASE WHEN n_chars > 3000 THEN 'test' WHEN n_chars > 1500 THEN 'dev' ELSE 'train' END AS partition
    FROM labels JOIN documents USING (doc_id))
  SELECT l.doc_id || '-' || l.attribute AS key, l.doc_id AS docid, t.entity, l.attribute, definition, t.text, x.spans,
    CASE WHEN partition = 'test' THEN human ELSE weak END AS label, partition
  FROM l JOIN jtext t ON t.doc_id = l.doc_id JOIN x ON x.doc_id = t.doc_id AND x.entity = t.entity JOIN defs ON defs.attribute = l.attribute WHERE partition IN ('dev', 'test')""")
def m17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    part = F.when(F.col("n_chars") > 3000, "test").when(F.col("n_chars") > 1500, "dev").otherwise("train")
    labels = table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("lang").alias("attribute"), F.col("quality").alias("human"), F.col("toxic").alias("weak"), part.alias("partition"))
    texts = segments(spark, d).withColumnRenamed("entity", "name").withColumn("docid", F.col("doc_id"))
    _, _, defs = labelled(spark, d)
    rows = pr.load_samples(labels, texts, defs, "doc_id", "attribute", "docid", "name", ["dev", "test"])
    return rows.withColumn("spans", show(F.col("spans")))


@query("M18_introductions", """
  WITH o AS (SELECT c_custkey, c_name, o_orderkey, year(o_orderdate) AS y, '<a href="https://example.org/o/' || o_orderkey || '" target="_blank"><i>order ' || o_orderkey || '</i></a>' ||
      CASE WHEN o_orderstatus = 'F' THEN ' (<a href="https://example.org/c/' || o_custkey || '" target="_blank">Page</a>)' ELSE '' END AS t
    FROM customer JOIN orders ON o_custkey = c_custkey),
  l AS (SELECT c_custkey, min(c_name) AS n, list(t ORDER BY o_orderkey) AS ts, min(y)::INT AS first_year FROM o GROUP BY c_custkey)
  SELECT c_custkey, '<strong>' || n || '</strong> appears in the document' || CASE WHEN len(ts) > 1 THEN 's: ' || array_to_string(ts[:-2], ', ') || ' and ' || ts[-1] ELSE ' ' || ts[1] END || '.' AS introduction, first_year FROM l""")
def m18(spark, d):
    orders = table(spark, d, "orders")
    rows = table(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"))
    oid, cid = F.col("o_orderkey").cast("string"), F.col("c_custkey").cast("string")
    page = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://example.org/c/"), cid))
    intro = pr.introductions(rows, "c_custkey", "c_name", "o_orderkey", F.concat(F.lit("order "), oid),
                             F.concat(F.lit("https://example.org/o/"), oid), page)
    years = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).alias("first_year"))
    return intro.join(years, "c_custkey")


@query("M19_filter_by_response", """
  WITH r AS (SELECT lang || source AS attribute, bool_or(n_chars > 9000) AS ok FROM documents GROUP BY 1),
  ds AS (SELECT doc_id, lang || source AS attribute, quality FROM labels JOIN documents USING (doc_id)),
  k AS (SELECT * FROM ds WHERE attribute IN (SELECT attribute FROM r WHERE ok))
  SELECT 'before' AS stage, count(*) AS n, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg FROM ds
  UNION ALL SELECT 'after', count(*), count(*) FILTER (quality = 1), count(*) FILTER (quality = 0) FROM k""")
def m19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.concat("lang", "source").alias("attribute"))
    verdict = docs.groupBy("attribute").agg(F.max("n_chars").alias("n"))
    response = F.concat_ws("\n", F.lit("1. Yes"), F.when(F.col("n") > 9000, "2) yes!").otherwise("2) No."), F.lit("3. summary"))
    # answers as a model would word them: numbering and punctuation are stripped by the parser
    responses = verdict.select("attribute", response.alias("response"))
    dataset = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "attribute", "quality")
    _, counts = pr.filter_by_response(responses, "response", dataset, "attribute", "quality")
    return counts


@query("M20_chat_messages", """
  SELECT conv_id, turn, 'system=' || role || '|user=' || text AS plain, 'user=' || role || chr(10) || text AS folded FROM conversations""")
def m20(spark, d):
    def flat(messages):
        return F.array_join(F.transform(messages, lambda m: F.concat_ws("=", m["role"], m["content"])), "|")

    text, role = F.col("text"), F.col("role")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", flat(pr.chat_messages(text, role)).alias("plain"), flat(pr.chat_messages(text, role, fold=True)).alias("folded"))


@query("D03_score_batches", f"""
  SELECT conv_id, turn, CASE WHEN {v.wc_sql('text')} % 2 = 0 THEN 'yes' ELSE 'no' END AS response FROM conversations""")
def d03(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return score_batches(rows, "text").drop("text")


SHOWN = (('$ATTRIBUTE$', 'lang'), ('$DEFINITION$', "'texts written in ' || lang"), ('$ENTITY$', 'source'), ('$TEXT$', 'text'))


@query("R06_few_shot_prompts", f"""
  WITH picks AS ({few_sql("source")}), ex AS (SELECT doc_id, generate_subscripts(es, 1) AS k, unnest(es)::BIGINT AS e FROM (SELECT doc_id, string_split(examples, ',') AS es FROM picks WHERE examples <> '')),
  txt AS (SELECT doc_id, quality, {fill_sql(pr.EXAMPLE_TEMPLATE, *SHOWN)} AS t FROM labels JOIN documents USING (doc_id)),
  b AS (SELECT ex.doc_id, string_agg(replace(replace(t, '$HEADER$', 'Example ' || k), '$LABEL$', CASE quality WHEN 1 THEN 'yes' ELSE 'no' END),
    chr(10) || chr(10) ORDER BY k) AS body FROM ex JOIN txt q ON q.doc_id = ex.e GROUP BY ex.doc_id)
  SELECT p.doc_id, 'Learn:' || chr(10) || coalesce(body, '') || chr(10) || 'Now: ' || rtrim(replace(replace(t, '$HEADER$', 'Query'), '$LABEL$', ''), ' ') AS prompt
  FROM picks p JOIN txt USING (doc_id) LEFT JOIN b ON b.doc_id = p.doc_id""")
def r06p(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    rows = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    picks = sm.few_shot(rows.select("doc_id", "quality", "source"), "doc_id", "quality", 3, 31, "source")
    fields = {"$ATTRIBUTE$": F.col("lang"), "$DEFINITION$": F.concat(F.lit("texts written in "), "lang"),
              "$ENTITY$": F.col("source"), "$TEXT$": F.col("text")}
    return pr.few_shot_prompts(picks, rows, "doc_id", "quality", fields, "Learn:\n$EXAMPLES$\nNow: $QUERY$")
