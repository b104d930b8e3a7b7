"""Scans and sinks: the given tables are written in each layout and read back."""

from pyspark.sql import functions as F

from docattr.catalog.registry import query, table
from docattr.session import scratch_path
from docattr.sources import readers as rd

NATION = "n_nationkey INT, n_name STRING, n_regionkey STRING"


@query("S01_csv_scan", "SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s01(spark, d):
    path = scratch_path(spark, "s01")
    rd.write_csv(table(spark, d, "nation"), path)
    return rd.read_csv(spark, path, NATION)


@query("S02_pruned_csv_scan", "SELECT o_orderkey, o_orderpriority FROM orders")
def s02(spark, d):
    path = scratch_path(spark, "s02")
    rd.write_csv(table(spark, d, "orders").drop("o_orderdate"), path)
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING"
    return rd.read_csv(spark, path, schema).select("o_orderkey", "o_orderpriority")


@query("S03_all_string_scan", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s03(spark, d):
    path = scratch_path(spark, "s03")
    rd.write_csv(table(spark, d, "nation"), path)
    return rd.read_csv_strings(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query("S04_headerless_scan", "SELECT r_regionkey AS id, r_name AS title FROM region")
def s04(spark, d):
    path = scratch_path(spark, "s04")
    rd.write_csv(table(spark, d, "region"), path, header=False)
    return rd.read_csv(spark, path, "id INT, title STRING", header=False)


@query("S05_header_sniff", "SELECT n_nationkey::VARCHAR AS content_id, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s05(spark, d):
    path = scratch_path(spark, "s05")
    rd.write_csv(table(spark, d, "nation").coalesce(1), path)
    return rd.read_csv_sniffed(spark, path, "content_id")


@query("S06_whole_text_files", "SELECT page_id::VARCHAR AS key, html AS text FROM pages")
def s06(spark, d):
    path = scratch_path(spark, "s06")
    table(spark, d, "pages").select("page_id", "html").write.partitionBy("page_id").text(path)
    return rd.read_texts(spark, path, r"page_id=(\d+)", drop_final_newline=True)


@query("S07_nested_json", """
  WITH c AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations)
  SELECT conv_id, turn, role, (i - 1)::INT AS rank, ls[i] AS character, length(ls[i])::INT AS person
  FROM (SELECT *, unnest(range(1, least(len(ls), 10) + 1)) AS i FROM c)""")
def s07(spark, d):
    path = scratch_path(spark, "s07")
    lines = F.split("text", "\n")
    cast = F.transform(lines, lambda x: F.struct(x.alias("character"), F.length(x).alias("personID")))
    table(spark, d, "conversations").select("conv_id", "turn", "role", cast.alias("cast")).write.json(path)
    schema = "conv_id BIGINT, turn BIGINT, role STRING, cast ARRAY<STRUCT<character: STRING, personID: INT>>"
    top = F.posexplode(F.slice("cast", 1, 10)).alias("rank", "c")
    return rd.read_json(spark, path, schema).select("conv_id", "turn", "role", top).select(
        "conv_id", "turn", "role", "rank", "c.character", F.col("c.personID").alias("person"))


@query("S08_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def s08(spark, d):
    path = scratch_path(spark, "s08")
    table(spark, d, "conversations").write.json(path)
    return rd.read_json(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


@query("S08_json_arrays", """
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations""")
def s08b(spark, d):
    path = scratch_path(spark, "s08")
    objects = F.transform(F.split("text", "\n"), lambda x: F.struct("conv_id", "turn", x.alias("line")))
    table(spark, d, "conversations").select(F.to_json(objects).alias("value")).write.text(path)
    return rd.read_json(spark, path, "conv_id BIGINT, turn BIGINT, line STRING")


@query("S09_offset_pairs", """
  WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  SELECT doc_id, (i * 10)::INT AS "start", (i * 10 + length(line))::INT AS "end" FROM l""")
def s09(spark, d):
    path = scratch_path(spark, "s09")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat_ws(
        " ", ((i + 1) * 10).cast("string"), ((i + 1) * 10 + F.length(x)).cast("string")))
    table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("spans")).write.parquet(path)
    spans = F.explode(rd.parse_spans(F.col("spans"))).alias("s")
    return spark.read.parquet(path).select("doc_id", spans).select("doc_id", "s.start", "s.end")


@query("S10_alternating_lines", """
  WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
  SELECT doc_id, ls[2 * i + 1] AS key, ls[2 * i + 2] AS value FROM (SELECT *, unnest(range(0, len(ls) // 2)) AS i FROM l)""")
def s10(spark, d):
    pairs = F.explode(rd.parse_alternating(F.col("text"))).alias("p")
    return table(spark, d, "documents").select("doc_id", pairs).select("doc_id", "p.key", "p.value")


@query("S11_manifest_concat", "SELECT event_id, user_id, value, event_type AS run FROM events")
def s11(spark, d):
    path = scratch_path(spark, "s11")
    kinds = ["signup", "click", "view", "error", "purchase"]
    events = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("run"))
    events.write.option("header", True).partitionBy("run").csv(path)
    manifest = [f"{path}/run={k}" for k in kinds]
    return rd.read_runs(spark, manifest, "event_id BIGINT, user_id BIGINT, value DOUBLE", r"run=(\w+)")


@query("S12_page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def s12(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("S13_text_sink", """
  SELECT unnest(string_split(text, chr(10))) AS line FROM documents""")
def s13(spark, d):
    path = scratch_path(spark, "s13")
    table(spark, d, "documents").select("text").write.mode("overwrite").text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("S14_keyed_output", "SELECT doc_id, n_chars, lang FROM documents")
def s14(spark, d):
    path = scratch_path(spark, "s14")
    rd.write_by_key(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), path, ["lang"])
    return spark.read.parquet(path)


@query("S15_incremental_append", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def s15(spark, d):
    path = scratch_path(spark, "s15")
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    events.filter("event_type IN ('signup', 'view')").write.parquet(path)
    stored = spark.read.parquet(path)
    # the stored part is offered again together with everything else
    offered = events.unionByName(events.filter("value > 50"))
    rd.append_new(offered, stored, ["event_id"]).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("S15_bucketed_append", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def s15b(spark, d):
    path = scratch_path(spark, "s15")
    name = "s15_" + path.rsplit("-", 1)[1]
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    rd.bucketed_table(spark, name, ", ".join(f"{c} {t}" for c, t in events.dtypes), path, ["event_id"], 16)
    for offered in (events.filter("event_type IN ('signup', 'view')"), events.unionByName(events.filter("value > 50"))):
        rd.append_bucketed(offered, name, ["event_id"])
    return spark.table(name).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("S16_resume_after_last", """
  SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > (SELECT max(l_orderkey) FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08)""")
def s16(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1D AND l_tax = 0.08D").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return rd.after_last(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", done)
