"""Aggregations, vote statistics and evaluation metrics."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.registry import query, table
from docattr.functions import answers, text as tx
from docattr.operators import identity, metrics, setops, stats, votes


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("A01_partition_summary", """
  WITH j AS (SELECT o_orderstatus AS p, l_suppkey, l_orderkey, l_partkey, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  g AS (SELECT coalesce(p, 'full') AS partition, count(DISTINCT l_suppkey) AS n_documents, count(DISTINCT l_orderkey) AS n_entities,
    count(DISTINCT l_partkey) AS n_attributes, count(*) AS n_rows, count(*) FILTER (l_linestatus = 'F') AS n_pos,
    count(*) FILTER (l_linestatus <> 'F') AS n_neg FROM j GROUP BY GROUPING SETS ((p), ()))
  SELECT *, round(100.0 * n_documents / (SELECT n_documents FROM g WHERE partition = 'full'), 6) AS pct_documents,
    round(100.0 * n_entities / (SELECT n_entities FROM g WHERE partition = 'full'), 6) AS pct_entities,
    round(100.0 * n_attributes / (SELECT n_attributes FROM g WHERE partition = 'full'), 6) AS pct_attributes,
    round(100.0 * n_rows / (SELECT n_rows FROM g WHERE partition = 'full'), 6) AS pct_rows FROM g""")
def a01(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    df = table(spark, d, "lineitem").join(orders, "l_orderkey")
    out = stats.partition_summary(
        df, "o_orderstatus", {"documents": "l_suppkey", "entities": "l_orderkey", "attributes": "l_partkey"},
        F.col("l_linestatus") == "F")
    return rounded(out, "pct_documents", "pct_entities", "pct_attributes", "pct_rows")


@query("A02_most_common", """
  SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS tok FROM documents)
  GROUP BY tok ORDER BY n DESC, tok LIMIT 50""")
def a02(spark, d):
    toks = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(tx.WORD + "+"), 0)).alias("tok"))
    return setops.frequency(toks, "tok", 50)


@query("A03_top_k_coverage", """
  WITH t AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100)
  SELECT sum(n)::BIGINT AS covered, min(n) AS min_frequency, round(100.0 * sum(n) / (SELECT count(*) FROM lineitem), 6) AS pct FROM t""")
def a03(spark, d):
    return rounded(setops.top_k_coverage(table(spark, d, "lineitem"), "l_partkey", 100), "pct")


@query("A04_summary", """
  SELECT round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS min,
    arg_min(doc_id, (n_chars, doc_id)) AS min_key, max(n_chars) AS max, arg_max(doc_id, (n_chars, -doc_id)) AS max_key,
    round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.8), 6) AS q80, round(quantile_cont(n_chars, 0.9), 6) AS q90,
    round(quantile_cont(n_chars, 0.95), 6) AS q95, round(quantile_cont(n_chars, 0.98), 6) AS q98,
    round(quantile_cont(n_chars, 0.99), 6) AS q99 FROM documents""")
def a04(spark, d):
    out = stats.summary(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    return rounded(out, "mean", "std", "median", *stats.SUMMARY_QUANTILES)


def hist_sql(source, bins):
    return f"""
  WITH x AS ({source}), e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS size FROM x),
  c AS (SELECT least(floor((v - lo) * {bins} / (hi - lo)) + 1, {bins})::INT AS bin, count(*) AS n FROM x, e GROUP BY 1)
  SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / {bins}.0), 6) AS lower, coalesce(n, 0) AS n,
    round(coalesce(n, 0) / (size * ((hi - lo) / {bins}.0)), 6) AS density
  FROM (SELECT unnest(range(1, {bins} + 1))::INT AS bin) b LEFT JOIN c USING (bin), e"""


@query("A05_histogram", hist_sql("SELECT n_chars::DOUBLE AS v FROM documents", 50))
def a05(spark, d):
    return rounded(stats.histogram(table(spark, d, "documents"), "n_chars", 50), "lower", "density")


@query("A05_histogram_below_q95", hist_sql(
    "SELECT n_chars::DOUBLE AS v FROM documents WHERE n_chars < (SELECT quantile_cont(n_chars, 0.95) FROM documents)", 50))
def a05b(spark, d):
    return rounded(stats.histogram(table(spark, d, "documents"), "n_chars", 50, upper_q=0.95), "lower", "density")


@query("A05_histogram_density", hist_sql("SELECT embedding[1]::DOUBLE AS v FROM embeddings", 100))
def a05c(spark, d):
    e = table(spark, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return rounded(stats.histogram(e, "x", 100), "lower", "density")


def _describe_sql(cols):
    return " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", count(n)::INT AS count, floor(avg(n))::INT AS mean, floor(stddev_samp(n))::INT AS std, min(n)::INT AS min,
    floor(quantile_cont(n, 0.25))::INT AS q25, floor(quantile_cont(n, 0.5))::INT AS q50, floor(quantile_cont(n, 0.75))::INT AS q75, max(n)::INT AS max
  FROM (SELECT count(DISTINCT {c}) AS n FROM lineitem GROUP BY l_orderkey)""" for c in cols)


@query("A06_describe_nunique", _describe_sql(["l_partkey", "l_suppkey"]))
def a06(spark, d):
    return stats.describe_nunique(table(spark, d, "lineitem"), "l_orderkey", ["l_partkey", "l_suppkey"])


@query("A07_conditional_rates", """
  SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS n_high, count(*) FILTER (value <= 10) AS n_low,
    round(100.0 * count(*) FILTER (value > 100) / count(*), 6) AS pct_high,
    round(100.0 * count(*) FILTER (value <= 10) / count(*), 6) AS pct_low FROM events GROUP BY event_type""")
def a07(spark, d):
    out = stats.conditional_rates(
        table(spark, d, "events"), "event_type", {"high": F.col("value") > 100, "low": F.col("value") <= 10})
    return rounded(out, "pct_high", "pct_low")


_A = answers.ANSWERS


@query("A08_worker_report", f"""
  WITH {v.votes_sql()}
  SELECT worker, count(*) AS n_ratings, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
    round(avg(seconds / 60), 6) AS mean_minutes, round(stddev_pop(seconds / 60), 6) AS std_minutes,
    {", ".join(f"count(*) FILTER (answer = '{a}') AS n_{a}" for a in _A)},
    round(100.0 * count(*) FILTER (label = 1 AND answer IN ('yes','maybeyes')) / nullif(count(*) FILTER (label = 1), 0), 6) AS perf_positive,
    round(100.0 * count(*) FILTER (label = 0 AND answer IN ('no','maybeno')) / nullif(count(*) FILTER (label = 0), 0), 6) AS perf_negative,
    round(100.0 * count(*) FILTER ((label = 1 AND answer IN ('yes','maybeyes')) OR (label = 0 AND answer IN ('no','maybeno'))) / count(*), 6) AS perf,
    {", ".join(f"round(100.0 * count(*) FILTER (answer = '{a}') / count(*), 6) AS pct_{a}" for a in _A)},
    round(median(seconds / 60), 6) AS median_minutes
  FROM votes GROUP BY worker""")
def a08(spark, d):
    out = votes.worker_report(v.votes(spark, d), "worker", "label", "seconds")
    return rounded(out, "mean_minutes", "std_minutes", "perf_positive", "perf_negative", "perf",
                   *[f"pct_{a}" for a in _A], "median_minutes")


VOTE_TABLE = f"""{v.votes_sql()}, {v.ONE_VOTE},
  agg AS (SELECT unit, count(*) FILTER (NOT reliable) AS unreliable, count(*) FILTER (reliable AND answer = 'notsure') AS notsure,
    count(*) FILTER (reliable AND answer = 'yes') AS yes, count(*) FILTER (reliable AND answer = 'maybeyes') AS maybeyes,
    count(*) FILTER (reliable AND answer = 'maybeno') AS maybeno, count(*) FILTER (reliable AND answer = 'no') AS "no"
    FROM one_vote GROUP BY unit),
  vt AS (SELECT *, yes + maybeyes + maybeno + "no" AS n,
    yes::VARCHAR || maybeyes::VARCHAR || maybeno::VARCHAR || "no"::VARCHAR AS combination FROM agg)"""


def vote_table(spark, d):
    return votes.vote_table(votes.one_vote_per_worker(v.votes(spark, d), ["unit"], "worker", "event_id"), ["unit"], "reliable")


@query("A09_vote_table", f"WITH {VOTE_TABLE} SELECT * FROM vt")
def a09(spark, d):
    return vote_table(spark, d)


@query("A10_combination_distribution", f"""
  WITH {VOTE_TABLE}, r AS (SELECT unnest(range(0, 4)) AS x)
  SELECT a.x + b.x + c.x + e.x AS n, a.x AS yes, b.x AS maybeyes, c.x AS maybeno, e.x AS "no",
    a.x::VARCHAR || b.x::VARCHAR || c.x::VARCHAR || e.x::VARCHAR AS combination,
    (SELECT count(*) FROM vt WHERE yes = a.x AND maybeyes = b.x AND maybeno = c.x AND "no" = e.x) AS samples,
    round(100.0 * (SELECT count(*) FROM vt WHERE yes = a.x AND maybeyes = b.x AND maybeno = c.x AND "no" = e.x) / (SELECT count(*) FROM vt), 6) AS percentage
  FROM r a, r b, r c, r e WHERE a.x + b.x + c.x + e.x <= 3""")
def a10(spark, d):
    return rounded(votes.combination_distribution(vote_table(spark, d)), "percentage")


ALPHA = f"""
  WITH {v.votes_sql(True)}, {v.ONE_VOTE},
  p AS (SELECT unit, list_position(['no','maybeno','maybeyes','yes'], answer) AS c FROM one_vote WHERE reliable AND answer <> 'notsure'),
  m AS (SELECT unit, count(*) AS m FROM p GROUP BY unit HAVING count(*) > 1),
  cu AS (SELECT unit, c, count(*) AS n FROM p GROUP BY ALL),
  o AS (SELECT a.c AS c, b.c AS k, sum(a.n * (b.n - (a.c = b.c)::INT) / (m.m - 1)::DOUBLE) AS o
        FROM cu a JOIN cu b USING (unit) JOIN m USING (unit) GROUP BY ALL),
  nc AS (SELECT c, sum(o) AS n FROM o GROUP BY c),
  dl AS (SELECT a.c AS c, b.c AS k, power((SELECT sum(n) FROM nc g WHERE g.c BETWEEN least(a.c, b.c) AND greatest(a.c, b.c)) - (a.n + b.n) / 2, 2) AS d2, a.n * b.n AS e
         FROM nc a, nc b WHERE a.c <> b.c)
  SELECT round(1 - (SELECT sum(o.o * d2) FROM o JOIN dl USING (c, k)) / ((SELECT sum(e * d2) FROM dl) / ((SELECT sum(n) FROM nc) - 1)), 6) AS alpha,
    round((SELECT sum(n) FROM nc), 6) AS pairable"""


@query("A11_krippendorff_alpha", ALPHA)
def a11(spark, d):
    one = votes.one_vote_per_worker(v.votes(spark, d, dense=True), ["unit"], "worker", "event_id").filter("reliable")
    return rounded(votes.krippendorff_ordinal(one, ["unit"], ["no", "maybeno", "maybeyes", "yes"]), "alpha", "pairable")


@query("A12_joined_set", """
  SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey::VARCHAR))), ';') AS items FROM lineitem GROUP BY l_orderkey""")
def a12(spark, d):
    return stats.joined_set(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("A13_canonical_identity", f"""
  WITH {v.FACTS}, s AS (SELECT f.entity, list_sort(list_distinct(list(attribute))) AS attrs, min(o_orderstatus) AS name
    FROM facts f JOIN orders ON o_orderkey = f.entity GROUP BY f.entity),
  g AS (SELECT *, min(entity) OVER (PARTITION BY attrs, name) AS first FROM s),
  i AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT first FROM g))
  SELECT entity, 'C' || lpad(n::VARCHAR, length(total::VARCHAR)::INT, '0') AS id FROM g JOIN i USING (first)""")
def a13(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderstatus").alias("name"))
    return identity.canonical_id(v.facts(spark, d).join(orders, "entity"), "entity", "attribute", "name")


@query("A14_drop_ambiguous", """
  SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderdate) IN (
    SELECT (o_custkey, o_orderdate) FROM orders GROUP BY o_custkey, o_orderdate HAVING count(DISTINCT o_orderpriority) = 1)""")
def a14(spark, d):
    return stats.drop_ambiguous(table(spark, d, "orders"), ["o_custkey", "o_orderdate"], "o_orderpriority").select(
        "o_orderkey", "o_custkey")


@query("A15_prefer_primary", """
  WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber FROM lineitem JOIN n USING (l_orderkey) WHERE n <> 1 OR l_returnflag = 'R'""")
def a15(spark, d):
    return stats.prefer_primary(
        table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "R", ["l_partkey"]
    ).select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")


@query("A16_longest_value", """
  SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS p_name FROM part GROUP BY p_brand""")
def a16(spark, d):
    return stats.longest(table(spark, d, "part"), "p_brand", "p_name", "p_partkey")


@query("A17_group_min", """
  SELECT o_orderkey, o_custkey, min(year(o_orderdate)) OVER (PARTITION BY o_custkey)::INT AS first_year FROM orders""")
def a17(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return stats.group_min(orders, "o_custkey", "y", "first_year").drop("y")


# --- metrics ------------------------------------------------------------------------------

SCORES = """round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy,
    round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS "precision",
    round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def cells_sql(w="1"):
    return f"""coalesce(sum({w}) FILTER (label = 1 AND pred = 1), 0) AS tp, coalesce(sum({w}) FILTER (label = 0 AND pred = 1), 0) AS fp,
    coalesce(sum({w}) FILTER (label = 1 AND pred = 0), 0) AS fn, coalesce(sum({w}) FILTER (label = 0 AND pred = 0), 0) AS tn"""


KEYED = """keyed AS (SELECT run, label_key, max(pred) AS pred, arg_min(label, doc_id) AS label
    FROM (SELECT *, n_chars // 500 AS label_key FROM preds WHERE pred IS NOT NULL) GROUP BY run, label_key)"""
METRIC_COLS = ("accuracy", "precision", "recall", "f1")


def keyed_preds(spark, d):
    return v.predictions(spark, d).withColumn("label_key", F.floor(F.col("n_chars") / 500))


@query("A18_keyed_metrics", f"""
  WITH {v.predictions_sql()}, {KEYED}, c AS (SELECT {cells_sql()}, count(*) AS scored_keys FROM keyed)
  SELECT scored_keys, {SCORES}, (SELECT count(*) FROM (SELECT DISTINCT run, n_chars // 500 FROM preds)) AS total_keys FROM c""")
def a18(spark, d):
    return rounded(metrics.evaluate(keyed_preds(spark, d), ["run", "label_key"], "doc_id"), *METRIC_COLS)


@query("A19_metrics_across_runs", f"""
  WITH {v.predictions_sql()}, {KEYED}, c AS (SELECT run, {cells_sql()} FROM keyed GROUP BY run),
  m AS (SELECT {SCORES.replace("round(", "(").replace(", 6)", ")")} FROM c)
  SELECT count(*) AS runs, {", ".join(f'round(avg("{c}"), 6) AS {c}_mean, round(stddev_pop("{c}"), 6) AS {c}_std' for c in METRIC_COLS)} FROM m""")
def a19(spark, d):
    out = metrics.run_metrics(keyed_preds(spark, d), "run", ["label_key"], "doc_id")
    return rounded(out, *[f"{c}_{s}" for c in METRIC_COLS for s in ("mean", "std")])


@query("A20_weighted_f1", f"""
  WITH {v.predictions_sql()}, c AS (SELECT {cells_sql("(n_chars % 4 + 1) / 4.0::DOUBLE")}, count(*) AS n FROM preds WHERE pred IS NOT NULL)
  SELECT n, {SCORES} FROM c""")
def a20(spark, d):
    weighted = v.predictions(spark, d).withColumn("weight", (F.col("n_chars") % 4 + 1) / F.lit(4.0))
    return rounded(metrics.weighted_f1(weighted, "weight"), *METRIC_COLS)


AT_K = """
  WITH e AS (SELECT vec_id, vec_id // 5 AS key, CASE WHEN embedding[2] > -0.1 THEN 'yes' ELSE 'no' END AS response,
      embedding[1]::DOUBLE AS prob, (vec_id % 5 = label % 5)::INT AS gold FROM embeddings),
  y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prob DESC, vec_id) - 1 AS rnk FROM e WHERE response = 'yes'),
  g AS (SELECT key, arg_min(rnk, vec_id) AS rnk FROM y WHERE gold = 1 GROUP BY key)
  SELECT k::INT AS k, count(*) FILTER (rnk < k) AS hits, round(count(*) FILTER (rnk < k) / (SELECT count(DISTINCT key) FROM e)::DOUBLE, 6) AS accuracy
  FROM (SELECT unnest([1, 2, 3]) AS k) LEFT JOIN g ON true GROUP BY k"""


@query("A21_accuracy_at_k", AT_K)
def a21(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 5).alias("key"),
        F.when(F.get("embedding", F.lit(1)) > -0.1, "yes").otherwise("no").alias("response"),
        F.get("embedding", F.lit(0)).cast("double").alias("prob"),
        F.when(F.col("vec_id") % 5 == F.col("label") % 5, 1).otherwise(0).alias("gold"))
    from docattr.operators.ordered import union_all

    return rounded(union_all([
        metrics.accuracy_at_k(e, "key", "prob", "gold", k, "response", "vec_id") for k in (1, 2, 3)]), "accuracy")


@query("A22_multiclass_accuracy", """
  WITH e AS (SELECT label, CASE WHEN embedding[1] > 0 THEN vec_id % 10 WHEN embedding[2] > 0 THEN label END AS pred FROM embeddings)
  SELECT round(count(*) FILTER (pred = label) / nullif(count(pred), 0)::DOUBLE, 6) AS accuracy, count(pred) AS scored, count(*) AS total FROM e""")
def a22(spark, d):
    x = lambda i: F.get("embedding", F.lit(i))
    e = table(spark, d, "embeddings").select(
        "label", F.when(x(0) > 0, F.col("vec_id") % 10).when(x(1) > 0, F.col("label")).alias("pred"))
    return rounded(metrics.multiclass_accuracy(e), "accuracy")


def perm_sql(metric):
    def score(side):
        tp, fp, fn, tn = (f"sum((label = {a} AND {side} = {b})::INT)" for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
        return {"accuracy": f"({tp} + {tn})::DOUBLE / ({tp} + {fp} + {fn} + {tn})",
                "f1": f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"}[metric]

    return f"""
  WITH {v.predictions_sql(7, 'pa')}, {v.predictions_sql(17, 'pb')},
  p AS (SELECT doc_id, pa.label AS label, pa.pred AS x, pb.pred AS y FROM pa JOIN pb USING (doc_id) WHERE pa.pred IS NOT NULL AND pb.pred IS NOT NULL),
  s AS (SELECT r, label, CASE WHEN sw THEN y ELSE x END AS x, CASE WHEN sw THEN x ELSE y END AS y FROM (
    SELECT *, substr({v.h_sql(11, 'r', 'doc_id')}, 1, 1) >= '8' AS sw FROM p, (SELECT unnest(range(0, 1000)) AS r))),
  st AS (SELECT {score('x')} - {score('y')} AS d FROM s GROUP BY r),
  o AS (SELECT {score('x')} - {score('y')} AS d0 FROM p),
  t AS (SELECT count(*) FILTER (d <= d0 + 1e-12) AS low, count(*) FILTER (d >= d0 - 1e-12) AS high, any_value(d0) AS d0 FROM st, o)
  SELECT round(d0, 6) AS statistic, round(least(1.0, 2.0 * least(low + 1, high + 1) / 1001.0), 6) AS p,
    round(least(1.0, 2 * least(1.0, 2.0 * least(low + 1, high + 1) / 1001.0)), 6) AS p_corrected FROM t"""


def _perm(spark, d, metric):
    a = v.predictions(spark, d, 7).filter("pred IS NOT NULL")
    b = v.predictions(spark, d, 17).filter("pred IS NOT NULL")
    return rounded(metrics.permutation_test(a, b, ["doc_id"], metric, seed=11, factor=2), "statistic", "p", "p_corrected")


@query("A23_permutation_test_accuracy", perm_sql("accuracy"))
def a23(spark, d):
    return _perm(spark, d, "accuracy")


@query("A23_permutation_test_f1", perm_sql("f1"))
def a23b(spark, d):
    return _perm(spark, d, "f1")


# Three systems with two runs each: the seeds of their predictions.
SYSTEMS = {("a", "0"): 7, ("a", "1"): 17, ("b", "0"): 27, ("b", "1"): 37, ("c", "0"): 47, ("c", "1"): 57}


def systems_sql(metric, rounds=200, seed=11):
    def score(side, other):
        def total(label, pred):
            return f"sum(CASE WHEN label = {label} THEN CASE WHEN {side} = {pred} THEN n - k ELSE 0 END + CASE WHEN {other} = {pred} THEN k ELSE 0 END ELSE 0 END)"

        tp, fp, fn, tn = (total(*c) for c in ((1, 1), (0, 1), (1, 0), (0, 0)))
        return {"accuracy": f"({tp} + {tn})::DOUBLE / ({tp} + {fp} + {fn} + {tn})",
                "f1": f"coalesce(2.0::DOUBLE * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"}[metric]

    pair = "sa, ra, sb, rb"
    bits = f"('0x' || substr({v.h_sql(seed, 'sa', 'ra', 'sb', 'rb', 'label', 'x', 'y', 'r', 'c')}, 1, 8))::BIGINT"
    return f"""
  WITH {", ".join(v.predictions_sql(x, f"p{x}") for x in SYSTEMS.values())},
  p AS ({" UNION ALL ".join(f"SELECT '{s}' AS s, '{r}' AS r, doc_id, label, pred FROM p{x}" for (s, r), x in SYSTEMS.items())}),
  c AS (SELECT DISTINCT s, r FROM p),
  pairs AS (SELECT a.s AS sa, a.r AS ra, b.s AS sb, b.r AS rb FROM c a JOIN c b ON a.s < b.s
    QUALIFY row_number() OVER (PARTITION BY a.s, b.s ORDER BY {v.h_sql(seed, 'a.s', 'b.s', 'a.r', 'b.r')}) <= 2),
  cells AS (SELECT {pair}, a.label, a.pred AS x, b.pred AS y, count(*) AS n FROM pairs JOIN p a ON a.s = sa AND a.r = ra
    JOIN p b ON b.s = sb AND b.r = rb AND b.doc_id = a.doc_id WHERE a.pred IS NOT NULL AND b.pred IS NOT NULL GROUP BY ALL),
  o AS (SELECT {pair}, {score('x', 'y')} - {score('y', 'x')} AS d0 FROM (SELECT *, 0 AS k FROM cells) GROUP BY ALL),
  sw AS (SELECT {pair}, label, x, y, n, r, sum(bit_count({bits} >> greatest(0, (c + 1) * 32 - n)))::BIGINT AS k
    FROM (SELECT *, unnest(range(0, (n + 31) // 32)) AS c FROM cells WHERE x <> y), (SELECT unnest(range(0, {rounds})) AS r) GROUP BY ALL),
  every AS (SELECT * FROM sw UNION ALL SELECT {pair}, label, x, y, n, r, 0 FROM cells, (SELECT unnest(range(0, {rounds})) AS r) WHERE x = y),
  st AS (SELECT {pair}, r, {score('x', 'y')} - {score('y', 'x')} AS d FROM every GROUP BY ALL),
  t AS (SELECT {pair}, any_value(d0) AS d0, least(count(*) FILTER (d <= d0 + 1e-12), count(*) FILTER (d >= d0 - 1e-12)) AS few FROM st JOIN o USING ({pair}) GROUP BY ALL)
  SELECT sa AS system_a, ra AS run_a, sb AS system_b, rb AS run_b, round(d0, 6) AS statistic, round(least(1.0, 2.0 * (few + 1) / {rounds + 1}.0), 6) AS p,
    round(least(1.0, 6 * least(1.0, 2.0 * (few + 1) / {rounds + 1}.0)), 6) AS p_corrected FROM t"""


def _systems(spark, d, metric):
    from docattr.operators.ordered import union_all

    rows = union_all([
        v.predictions(spark, d, x).select(F.lit(s).alias("system"), F.lit(r).alias("variant"), "doc_id", "label", "pred") for (s, r), x in SYSTEMS.items()])
    out = metrics.compare_systems(rows, "system", "variant", ["doc_id"], metric, 11, run_pairs=2, resamples=200)
    return rounded(out, "statistic", "p", "p_corrected")


@query("A23_all_systems_accuracy", systems_sql("accuracy"))
def a23c(spark, d):
    return _systems(spark, d, "accuracy")


@query("A23_all_systems_f1", systems_sql("f1"))
def a23d(spark, d):
    return _systems(spark, d, "f1")


@query("A24_length_profile", f"""
  WITH w AS (SELECT lang, source, {v.wc_sql('text')} AS n_words FROM documents)
  SELECT lang, source, count(*) AS n, max(n_words)::INT AS max, round(quantile_cont(n_words, 0.5), 6) AS p50, round(quantile_cont(n_words, 0.9), 6) AS p90,
    round(quantile_cont(n_words, 0.99), 6) AS p99 FROM w GROUP BY ALL""")
def a24(spark, d):
    w = table(spark, d, "documents").select("lang", "source", tx.word_count(F.col("text")).alias("n_words"))
    return rounded(stats.length_profile(w, ["lang", "source"], "n_words", {"p50": 0.5, "p90": 0.9, "p99": 0.99}), "p50", "p90", "p99")


@query("A25_token_budget", f"""
  SELECT count(*) AS n_prompts, sum({v.wc_sql('text')})::BIGINT AS input_tokens, count(*) * 64 AS max_output_tokens FROM conversations WHERE role = 'user'""")
def a25(spark, d):
    return stats.token_budget(table(spark, d, "conversations").filter("role = 'user'"), "text", 64)


@query("A26_wide_form", """
  SELECT n_regionkey, array_to_string(list(n_nationkey::VARCHAR ORDER BY n_nationkey), ';') AS n_nationkey,
    array_to_string(list(n_name ORDER BY n_nationkey), ';') AS n_name FROM nation GROUP BY n_regionkey""")
def a26(spark, d):
    return stats.to_wide(table(spark, d, "nation"), "n_regionkey", ["n_nationkey", "n_name"], "n_nationkey")


LOG_SQL = """
  SELECT event_id AS step, CASE event_type WHEN 'click' THEN 'train' ELSE 'dev' END AS partition, value AS loss,
    CASE event_type WHEN 'error' THEN value / 2 END AS f1 FROM events WHERE event_type IN ('click', 'error')"""


def training_log(events):
    """Clicks as training records, errors as evaluation records, the rest carries neither loss."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("step"), F.when(kind == "click", F.col("value")).alias("loss"),
        F.when(kind == "error", F.col("value")).alias("eval_loss"),
        F.when(kind == "error", F.col("value") / 2).alias("f1"))


@query("A27_log_compaction", LOG_SQL)
def a27(spark, d):
    return stats.compact_log(training_log(table(spark, d, "events")), "f1")


@query("A28_catalogue", "SELECT p_name, arg_max(p_type, p_partkey) AS p_type FROM part GROUP BY p_name")
def a28(spark, d):
    return stats.catalogue(table(spark, d, "part"), "p_name", "p_type", "p_partkey")


@query("P10_vote_ambiguity", """
  SELECT event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 1 ELSE 2 END AS ambiguity FROM events""")
def p10(spark, d):
    return v.votes(spark, d).select("event_id", answers.ambiguity(F.col("answer")).alias("ambiguity"))


@query("P11_confidence", f"""
  WITH {VOTE_TABLE}, c AS (SELECT *, 2 * yes + maybeyes - maybeno - 2 * "no" AS conf FROM vt)
  SELECT unit, n, conf, (conf > 0)::INT AS label, (abs(conf) - 2) / 4.0::DOUBLE AS weight FROM c WHERE abs(conf) >= 3 AND n >= 2""")
def p11(spark, d):
    return votes.reliable_units(vote_table(spark, d), 3, 2).select("unit", "n", "conf", "label", "weight")
