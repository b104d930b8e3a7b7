"""Scalar projections on the given tables."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.registry import query, table
from docattr.functions import text as tx, tokens as tk
from docattr.operators import identity, setops, stats
from docattr.operators.tokens import pad_batches


@query("P01_last_segment", "SELECT page_id, string_split(url, '/')[-1] AS leaf FROM pages")
def p01(spark, d):
    return table(spark, d, "pages").select("page_id", tx.last_segment(F.col("url")).alias("leaf"))


PATHS = """paths AS (SELECT p_partkey, [p_type, p_brand, p_name] ||
    CASE WHEN p_size > 25 THEN ['A-C'] WHEN p_size < 5 THEN ['#-Z'] ELSE [] END AS path FROM part)"""


def paths(spark, d):
    bucket = F.when(F.col("p_size") > 25, F.array(F.lit("A-C"))).when(F.col("p_size") < 5, F.array(F.lit("#-Z")))
    path = F.concat(F.array("p_type", "p_brand", "p_name"), F.coalesce(bucket, F.array().cast("array<string>")))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


@query("P02_strip_bucket", f"""
  WITH {PATHS} SELECT p_partkey, trim(regexp_replace(array_to_string(path, '->'), '(^|(->))[#A-Z]-[A-Z]$', '')) AS path FROM paths""")
def p02(spark, d):
    return paths(spark, d).select("p_partkey", tx.strip_bucket(F.array_join("path", "->")).alias("path"))


@query("P03_squeeze", f"SELECT doc_id, {v.squeeze_sql('text')} AS text FROM documents")
def p03(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("text"))


@query("P04_ascii_fold", f"SELECT doc_id, {v.fold_sql('text')} AS text FROM documents")
def p04(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.ascii_fold(F.col("text")).alias("text"))


@query("P05_case_fold", "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low FROM part")
def p05(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"))


@query("P06_leaf_name", f"""
  WITH {PATHS} SELECT p_partkey, CASE WHEN regexp_matches(path[-1], '^[#A-Z]-[A-Z]$') THEN path[-2] ELSE path[-1] END AS name FROM paths""")
def p06(spark, d):
    return paths(spark, d).select("p_partkey", tx.leaf_name(F.col("path")).alias("name"))


TEMPLATE = "Speaker $NAME$ says:\n$STORY$\nIs $NAME$ polite? ($TURN$)"


@query("P07_template_fill", f"""
  SELECT conv_id, turn, replace(replace(replace('{TEMPLATE}', '$NAME$', role), '$TURN$', turn::VARCHAR), '$STORY$', text) AS prompt
  FROM conversations""")
def p07(spark, d):
    fill = tx.fill_template(TEMPLATE, {
        "$NAME$": F.col("role"), "$TURN$": F.col("turn").cast("string"), "$STORY$": F.col("text")})
    return table(spark, d, "conversations").select("conv_id", "turn", fill.alias("prompt"))


@query("P08_padded_ids", """
  SELECT s_suppkey, 'C' || lpad((row_number() OVER (ORDER BY s_name) - 1)::VARCHAR, length((SELECT count(*) FROM supplier)::VARCHAR)::INT, '0') AS id
  FROM supplier""")
def p08(spark, d):
    return identity.numbered(table(spark, d, "supplier"), ["s_name"], "C", "id").select("s_suppkey", "id")


@query("P12_word_count", f"SELECT doc_id, {v.wc_sql('text')}::INT AS n_words FROM documents")
def p12(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query("P13_human_list", """
  WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey)
  SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS names FROM n""")
def p13(spark, d):
    wide = stats.to_wide(table(spark, d, "nation"), "n_regionkey", ["n_name"], "n_nationkey")
    return wide.select("n_regionkey", tx.human_list(F.split("n_name", ";")).alias("names"))


@query("P14_name_filter", r"""
  WITH n AS (SELECT c_custkey, replace(c_name, '#', CASE WHEN c_nationkey < 5 THEN '.-''' WHEN c_nationkey < 15 THEN ' (nr) ' ELSE '#' END) AS nm FROM customer),
  p AS (SELECT c_custkey, trim(regexp_replace(nm, '\([^)]*\)', '', 'g')) AS x FROM n)
  SELECT c_custkey, CASE WHEN regexp_full_match(x, '[a-zA-Z0-9\s.\-'']+') AND len(regexp_extract_all(x, '[.\-'']')) <= 2 THEN x END AS name FROM p""")
def p14(spark, d):
    mark = F.when(F.col("c_nationkey") < 5, ".-'").when(F.col("c_nationkey") < 15, " (nr) ").otherwise("#")
    return table(spark, d, "customer").select(
        "c_custkey", tx.clean_name(F.replace("c_name", F.lit("#"), mark)).alias("name"))


@query("P15_aliases", """
  WITH n AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
  c AS (SELECT p_partkey, w, [upper(x[1]) || lower(x[2:]) FOR x IN w] AS t FROM n)
  SELECT p_partkey, array_to_string(list_sort(list_distinct([y FOR y IN list_concat(
    [array_to_string(t, ' '), t[1], t[-1], array_to_string(w, ' ')],
    [upper(array_to_string(w, ' ')), upper(w[1]), upper(w[-1])]) ])), ';') AS aliases FROM c""")
def p15(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.aliases(F.col("p_name")), ";").alias("aliases"))


@query("P16_letter_index", """
  SELECT p_partkey, (p_size % 5)::INT AS position FROM part""")
def p16(spark, d):
    answer = F.concat(F.lit("("), F.char(F.lit(97) + F.col("p_size") % 5), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", tx.letter_index(answer).cast("int").alias("position"))


@query("P17_list_normalise", """
  SELECT doc_id, array_to_string([lower(trim(x)) FOR x IN string_split(text, ',')], '|') AS items FROM documents""")
def p17(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(tx.normalized_list(F.split("text", ",")), "|").alias("items"))


@query("P18_html_link", """
  SELECT page_id, CASE WHEN url LIKE 'https%' THEN '<a href="' || url || '" target="_blank"><i>' || 'page ' || page_id || '</i></a>'
    ELSE '<i>page ' || page_id || '</i>' END AS link FROM pages""")
def p18(spark, d):
    label = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    url = F.when(F.col("url").startswith("https"), F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.html_link(url, label, italic=True).alias("link"))


@query("P19_list_to_columns", """
  SELECT p_brand, coalesce(t[1], '') AS first, coalesce(t[2], '') AS "second", coalesce(t[3], '') AS third
  FROM (SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS t FROM part GROUP BY p_brand)""")
def p19(spark, d):
    sets = stats.joined_set(table(spark, d, "part"), "p_brand", "p_type")
    return sets.select("p_brand", *tx.pad_columns(F.split("items", ";"), ["first", "second", "third"]))


def token_ids(text):
    """Ids of a hashed vocabulary, standing in for a tokenizer's."""
    toks = F.regexp_extract_all(text, F.lit(r"\S+"), 0)
    return F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))


IDS = "[('0x' || substr(md5(t), 1, 4))::INT FOR t IN regexp_extract_all({0}, '\\S+')]"


@query("P20_budget_and_labels", f"""
  WITH p AS (SELECT u.conv_id, u.turn, {IDS.format('u.text')} AS p, {IDS.format('a.text')} AS c
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'),
  t AS (SELECT *, p[:greatest(256 - len(c), 0)] AS k FROM p)
  SELECT conv_id, turn, array_to_string(list_concat(k, c), ' ') AS input_ids,
    array_to_string(list_concat([-100 FOR x IN k], c), ' ') AS labels FROM t""")
def p20(spark, d):
    conv = table(spark, d, "conversations")
    prompt = conv.filter("role = 'user'").select("conv_id", "turn", token_ids(F.col("text")).alias("p"))
    reply = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), token_ids(F.col("text")).alias("c"))
    p, c = F.col("p"), F.col("c")
    return prompt.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.array_join(tk.sequence_ids(p, c, 256), " ").alias("input_ids"),
        F.array_join(tk.sequence_labels(p, c, 256), " ").alias("labels"))


@query("P22_batch_padding", f"""
  WITH t AS (SELECT conv_id, turn, {IDS.format('text')} AS ids FROM conversations),
  m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM t)
  SELECT conv_id, turn, array_to_string(list_concat(ids, [0 FOR x IN range(m - len(ids))]), ' ') AS padded,
    array_to_string(list_concat([1 FOR x IN ids], [0 FOR x IN range(m - len(ids))]), '') AS attention_mask FROM m""")
def p22(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", token_ids(F.col("text")).alias("ids"))
    return pad_batches(rows, "conv_id", "ids", 0).select(
        "conv_id", "turn", F.array_join("ids", " ").alias("padded"), F.array_join("attention_mask", "").alias("attention_mask"))


@query("P22_left_padding", f"""
  WITH t AS (SELECT conv_id, turn, {IDS.format('text')} AS ids FROM conversations),
  m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM t)
  SELECT conv_id, turn, array_to_string(list_concat([0 FOR x IN range(m - len(ids))], ids), ' ') AS padded FROM m""")
def p22b(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", token_ids(F.col("text")).alias("ids"))
    return pad_batches(rows, "conv_id", "ids", 0, side="left").select("conv_id", "turn", F.array_join("ids", " ").alias("padded"))


@query("P23_explode_joined_list", "SELECT n_regionkey, n_name FROM nation")
def p23(spark, d):
    wide = stats.to_wide(table(spark, d, "nation"), "n_regionkey", ["n_name"], "n_nationkey")
    return setops.explode_list(wide, "n_name")
