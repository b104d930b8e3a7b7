"""Mention finding and anonymisation on documents, with names taken from the texts."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.pages import SCRIPT, script
from docattr.catalog.registry import query, table
from docattr.functions import text as tx
from docattr.operators import mentions as mn

NAMES = r"""names AS (
  SELECT doc_id, tok AS entity FROM (
    SELECT doc_id, tok, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS tok FROM documents)
    WHERE length(tok) >= 4 GROUP BY ALL HAVING count(*) >= 2)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, tok) <= 10),
  roster AS (SELECT doc_id, entity, list_sort(list_distinct([entity, lower(entity)])) AS aliases FROM names),
  alias AS (SELECT doc_id, entity, unnest(aliases) AS alias FROM roster)"""


def names(spark, d):
    words = F.filter(F.regexp_extract_all("text", F.lit(tx.WORD + "+"), 0), lambda w: F.length(w) >= 4)
    return mn.word_roster(table(spark, d, "documents"), "doc_id", words, 10)


def spelled(found):
    return found.withColumn("aliases", F.array_sort(F.array_distinct(F.array("entity", F.lower("entity")))))


def roster(spark, d):
    return spelled(names(spark, d))


def mentions_sql(segs="segments", name="mentions"):
    """Mentions of one-word aliases: words with offsets, joined to the aliases; of words of one
    entity that are one character apart, every other one is skipped."""
    return f"""{name}_split AS (SELECT doc_id, seg_no, text AS seg_text, regexp_extract_all(text, '{tx.WORD}+') AS ws, string_split_regex(text, '{tx.WORD}+') AS gs FROM {segs}),
  {name}_words AS (SELECT doc_id, seg_no, seg_text, ws[k] AS text, k,
      sum(length(gs[k]) + length(ws[k])) OVER (PARTITION BY doc_id, seg_no ORDER BY k) AS e
    FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM {name}_split)),
  {name}_hits AS (SELECT w.doc_id, seg_no, seg_text, entity, text, e - length(text) AS s, e,
      lag(e) OVER (PARTITION BY w.doc_id, seg_no, entity ORDER BY e) AS before
    FROM {name}_words w JOIN alias a ON a.doc_id = w.doc_id AND a.alias = w.text),
  {name}_runs AS (SELECT *, sum((before IS NULL OR s - before > 1)::INT) OVER (PARTITION BY doc_id, seg_no, entity ORDER BY e) AS run FROM {name}_hits),
  {name} AS (SELECT doc_id, seg_no, seg_text, entity, text, s::INT AS "start", e::INT AS "end",
      row_number() OVER (PARTITION BY doc_id, seg_no, entity ORDER BY e) AS i
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_no, entity, run ORDER BY e) AS n FROM {name}_runs) WHERE n % 2 = 1)"""


MENTIONS = f"{v.SEGMENTS}, {NAMES}, {mentions_sql()}"


@query("M05_find_mentions", f"""
  WITH {MENTIONS} SELECT doc_id, seg_no::INT AS seg_no, entity, "start", "end", text FROM mentions""")
def m05(spark, d):
    return mn.find_mentions(v.segments(spark, d), roster(spark, d))


@query("J13_alias_join", f"""
  WITH {MENTIONS} SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum("start")::BIGINT AS offsets FROM mentions GROUP BY entity""")
def j13(spark, d):
    found = mn.find_mentions(v.segments(spark, d), roster(spark, d))
    return found.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("start").alias("offsets"))


TURNS = """turns AS (SELECT conv_id AS doc_id, turn AS seg_no, role || ': ' || text AS text FROM conversations),
  alias AS (SELECT DISTINCT conv_id AS doc_id, role AS entity, role AS alias FROM conversations)"""


@query("M06_first_mention_only", f"""
  WITH {TURNS}, {mentions_sql('turns')} SELECT doc_id, seg_no, entity, "start", "end", text FROM mentions WHERE i = 1""")
def m06(spark, d):
    conv = table(spark, d, "conversations")
    turns = conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_no"), F.concat_ws(": ", "role", "text").alias("text"))
    cast = conv.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("entity"), F.array("role").alias("aliases")).distinct()
    return mn.find_utterances(turns, cast)


@query("M07_name_roster", rf"""
  WITH {SCRIPT},
  occ AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM script
    UNION ALL SELECT doc_id, regexp_extract(speaker, '^(\S+)', 1) FROM script WHERE speaker <> ''),
  ok AS (SELECT doc_id, trim(regexp_replace(name, '\([^)]*\)', '', 'g')) AS name FROM occ),
  cnt AS (SELECT doc_id, name, count(*) AS n FROM ok WHERE regexp_full_match(name, '[a-zA-Z0-9\s.\-'']+') AND len(regexp_extract_all(name, '[.\-'']')) <= 2
    GROUP BY ALL HAVING count(*) >= 2),
  top AS (SELECT doc_id, name FROM cnt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) <= 6),
  cast_ AS (SELECT doc_id, unnest(list_distinct(['Dr ' || upper(source[1]) || source[2:], 'Dr', upper(source[1]) || source[2:], 'dr ' || source, 'DR ' || upper(source), upper(source)])) AS name FROM documents)
  SELECT doc_id, name FROM top UNION SELECT doc_id, name FROM cast_ WHERE name <> 'Dr'""")
def m07(spark, d):
    segs = script(spark, d)
    words = segs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)).alias("raw"))
    speakers = segs.filter("speaker <> ''").select("doc_id", F.regexp_extract("speaker", r"^(\S+)", 1).alias("raw"))
    named = words.unionByName(speakers).select("doc_id", tx.clean_name(F.col("raw")).alias("name")).filter("name IS NOT NULL")
    cast = table(spark, d, "documents").select("doc_id", F.explode(tx.aliases(F.concat(F.lit("dr "), "source"))).alias("name"))
    return mn.name_roster(named, "doc_id", "name", 6).unionByName(cast).distinct()


KNOWN = f"""known AS (SELECT doc_id, entity, doc_id AS number FROM names WHERE length(entity) = 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY entity) = 1),
  fresh AS (SELECT n.doc_id, n.entity, (SELECT max(number) FROM known) + row_number() OVER (ORDER BY n.doc_id, n.entity) AS number
    FROM names n LEFT JOIN known k ON k.doc_id = n.doc_id AND k.entity = n.entity WHERE k.number IS NULL),
  codes AS (SELECT doc_id, entity, 'CHARACTER' || lpad(number::VARCHAR, greatest(4, length(number::VARCHAR))::INT, '0') AS code FROM (SELECT * FROM known UNION ALL SELECT * FROM fresh))"""


def known(found):
    from docattr.operators.ordered import keep_first

    short = found.filter(F.length("entity") == 4)
    return keep_first(short, ["doc_id"], ["entity"]).withColumn("number", F.col("doc_id"))


def coded(spark, d):
    found = names(spark, d)
    return mn.assign_codes(spelled(found), known(found), "doc_id")


# Mentions that survive left to right: walk the sorted list of each segment.
KEPT = f"""{MENTIONS}, {KNOWN},
  sorted AS (SELECT doc_id, seg_no, any_value(seg_text) AS seg_text,
      list({{'s': "start", 'e': "end", 'entity': entity, 'code': code}} ORDER BY "start", "end" DESC, entity) AS ml
    FROM mentions JOIN codes USING (doc_id, entity) GROUP BY doc_id, seg_no),
  walk AS (
    SELECT doc_id, seg_no, seg_text, ml, 1 AS i, true AS keep, ml[1].e AS last FROM sorted
    UNION ALL
    SELECT doc_id, seg_no, seg_text, ml, i + 1, ml[i + 1].s >= last, CASE WHEN ml[i + 1].s >= last THEN ml[i + 1].e ELSE last END
    FROM walk WHERE i < len(ml)),
  kept AS (SELECT doc_id, seg_no, seg_text, ml[i].s AS s, ml[i].e AS e, ml[i].entity AS entity, ml[i].code AS code,
      substr(seg_text, coalesce(lag(ml[i].e) OVER w, 0) + 1, ml[i].s - coalesce(lag(ml[i].e) OVER w, 0)) AS gap
    FROM walk WHERE keep WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY i)),
  anon AS (SELECT doc_id, seg_no, string_agg(gap || code, '' ORDER BY s) || substr(any_value(seg_text), max(e) + 1) AS text FROM kept GROUP BY doc_id, seg_no)"""


@query("M08_anonymise_segments", f"""
  WITH RECURSIVE {KEPT} SELECT s.doc_id, s.seg_no::INT AS seg_no, coalesce(a.text, s.text) AS text
  FROM segments s LEFT JOIN anon a ON a.doc_id = s.doc_id AND a.seg_no = s.seg_no""")
def m08(spark, d):
    return mn.anonymize_simple(v.segments(spark, d), coded(spark, d))


@query("M09_anonymise_with_spans", f"""
  WITH RECURSIVE {KEPT}
  SELECT doc_id, seg_no::INT AS seg_no, entity, (sum(length(gap) + length(code)) OVER w - length(code))::INT AS "start",
    (sum(length(gap) + length(code)) OVER w)::INT AS "end", code AS text FROM kept WINDOW w AS (PARTITION BY doc_id, seg_no ORDER BY s)""")
def m09(spark, d):
    anon = mn.anonymize(v.segments(spark, d), coded(spark, d))
    return anon.select("doc_id", "seg_no", F.explode("mentions").alias("m")).select(
        "doc_id", "seg_no", "m.entity", "m.start", "m.end", "m.text")


REPORT = f"""{MENTIONS}, spk AS (SELECT doc_id, seg_no, regexp_extract(text, '^(\\S+)', 1) AS text FROM segments),
  {mentions_sql('spk', 'spoken')},
  report AS (SELECT n.doc_id, n.entity, coalesce(m.c, 0) AS n_mentions, coalesce(u.c, 0) AS n_utterances, coalesce(m.c, 0) + coalesce(u.c, 0) > 0 AS matched
  FROM names n LEFT JOIN (SELECT doc_id, entity, count(*) AS c FROM mentions GROUP BY ALL) m USING (doc_id, entity)
  LEFT JOIN (SELECT doc_id, entity, count(*) AS c FROM spoken WHERE i = 1 GROUP BY ALL) u USING (doc_id, entity))"""


def matches(spark, d):
    segs, cast = v.segments(spark, d), roster(spark, d)
    speakers = segs.withColumn("text", F.regexp_extract("text", r"^(\S+)", 1))
    return cast, mn.find_mentions(segs, cast), mn.find_utterances(speakers, cast)


@query("A29_match_report", f"WITH {REPORT} SELECT * FROM report")
def a29(spark, d):
    return mn.match_report(*matches(spark, d))


@query("A29_match_totals", f"""
  WITH {REPORT} SELECT count(*) AS entities, count(*) FILTER (n_mentions > 0) AS with_mentions, count(*) FILTER (n_utterances > 0) AS with_utterances,
    sum(n_mentions)::BIGINT AS n_mentions, sum(n_utterances)::BIGINT AS n_utterances FROM report""")
def a29b(spark, d):
    return mn.match_totals(mn.match_report(*matches(spark, d)))


@query("A29_alias_flags", f"""
  WITH {REPORT}, hit AS (SELECT DISTINCT doc_id, entity, text AS alias FROM mentions UNION SELECT doc_id, entity, text FROM spoken WHERE i = 1)
  SELECT a.doc_id, a.entity, a.alias, h.alias IS NOT NULL AS matched FROM alias a LEFT JOIN hit h ON h.doc_id = a.doc_id AND h.entity = a.entity AND h.alias = a.alias""")
def a29c(spark, d):
    return mn.alias_report(*matches(spark, d))
