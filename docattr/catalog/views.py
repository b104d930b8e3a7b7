"""Relations of the data model derived from the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docattr.catalog.registry import table
from docattr.functions.draws import coin, uniform

# event_type -> vote (fixed values)
ANSWER_OF = {"signup": "yes", "click": "maybeyes", "view": "notsure", "error": "maybeno", "purchase": "no"}


def facts(spark: SparkSession, d: str) -> DataFrame:
    """entity = order, document = supplier, attribute = brand."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("entity"), F.col("l_suppkey").alias("document"), F.col("p_brand").alias("attribute")
    )


FACTS = """facts AS (
  SELECT l_orderkey AS entity, l_suppkey AS document, p_brand AS attribute
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def relation(spark: SparkSession, d: str) -> DataFrame:
    """Antonym relation: brand n and brand 26 - n."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("attribute"), F.concat(F.lit("Brand#"), (F.lit(26) - n).cast("string")).alias("antonym")
    ).distinct()


RELATION = """relation AS (
  SELECT DISTINCT p_brand AS attribute,
         'Brand#' || (26 - regexp_extract(p_brand, '([0-9]+)', 1)::INT)::VARCHAR AS antonym
  FROM part)"""


def votes(spark: SparkSession, d: str, dense: bool = False) -> DataFrame:
    """Votes from events: up to three per unit, or (dense) many workers on few units."""
    ev = table(spark, d, "events")
    answer = F.lit(None).cast("string")
    for event, vote in ANSWER_OF.items():
        answer = F.when(F.col("event_type") == event, vote).otherwise(answer)
    unit = F.get_json_object("props", "$.k").cast("long") if dense else F.floor(F.col("event_id") / 3)
    return ev.select(
        unit.cast("long").alias("unit"), F.col("user_id").alias("worker"), answer.alias("answer"),
        F.col("value").alias("seconds"), "event_id", (uniform(99, "user_id") >= 0.1).alias("reliable"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("label"),
    )


def votes_sql(dense: bool = False) -> str:
    unit = "(props->>'$.k')::BIGINT" if dense else "event_id // 3"
    cases = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in ANSWER_OF.items())
    return f"""votes AS (
  SELECT ({unit})::BIGINT AS unit, user_id AS worker, CASE event_type {cases} END AS answer,
         value AS seconds, event_id, {u_sql(99, 'user_id')} >= 0.1 AS reliable,
         CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS label
  FROM events)"""


ONE_VOTE = """one_vote AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY unit, worker ORDER BY
      CASE WHEN answer IN ('yes','no') THEN 0 WHEN answer IN ('maybeyes','maybeno') THEN 1 ELSE 2 END,
      event_id) AS rn FROM votes) WHERE rn = 1)"""


def predictions(spark: SparkSession, d: str, seed: int = 7) -> DataFrame:
    """label = quality, run = source; prediction from length with seeded flips and some unparsed rows."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    joined = table(spark, d, "labels").join(docs, "doc_id")
    base = (F.col("n_chars") > 1500).cast("int")
    flipped = F.when(coin(seed, "doc_id", p=0.2), 1 - base).otherwise(base)
    pred = F.when(coin(seed + 1, "doc_id", p=0.05), F.lit(None)).otherwise(flipped)
    return joined.select("doc_id", F.col("source").alias("run"), F.col("quality").alias("label"),
                         F.col("toxic").alias("toxic"), pred.cast("int").alias("pred"), "n_chars")


def u_sql(seed, *keys: str) -> str:
    """SQL of the uniform draw."""
    key = "concat_ws('|', '" + str(seed) + "', " + ", ".join(f"({k})::VARCHAR" for k in keys) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def h_sql(seed, *keys: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"({k})::VARCHAR" for k in keys) + "))"


def predictions_sql(seed: int = 7, name: str = "preds") -> str:
    return f"""{name} AS (
  SELECT doc_id, source AS run, quality AS label, toxic,
         CASE WHEN {u_sql(seed + 1, 'doc_id')} < 0.05 THEN NULL
              WHEN {u_sql(seed, 'doc_id')} < 0.2 THEN 1 - (n_chars > 1500)::INT
              ELSE (n_chars > 1500)::INT END AS pred, n_chars
  FROM labels JOIN documents USING (doc_id))"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document in reading order."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "text"))


SEGMENTS = """segments AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 AS seg_no, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def fold_sql(text: str) -> str:
    from docattr.functions.text import FOLD_FROM, FOLD_SPECIAL, FOLD_TO

    out = f"translate({text}, '{FOLD_FROM}', '{FOLD_TO}')"
    for char, plain in FOLD_SPECIAL:
        out = f"replace({out}, '{char}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"


def squeeze_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def wc_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"
