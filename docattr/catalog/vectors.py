"""Vector operators on the embeddings; a label's centroid stands for its attribute vector."""

from pyspark.sql import functions as F

from docattr.catalog.registry import query, table
from docattr.functions import vectors as vx
from docattr.operators import filters, vectors as vo

VECS = """vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  dims AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vecs) GROUP BY label, i),
  centroids AS (SELECT label AS cid, list(m ORDER BY i) AS c FROM dims GROUP BY label)"""


def vecs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def centroids(spark, d):
    return vo.mean_pool(vecs(spark, d), "label", "v", name="c").withColumnRenamed("label", "cid")


def own(spark, d):
    c = centroids(spark, d).withColumnRenamed("cid", "label")
    return vo.cosine_join(vecs(spark, d), c, ["label"], "v", "c")


@query("V01_cosine_similarity", f"WITH {VECS} SELECT vec_id, label, round(list_cosine_similarity(v, c), 6) AS similarity FROM vecs JOIN centroids ON cid = label")
def v01(spark, d):
    return own(spark, d).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("J15_grouped_pairs_similarity", f"""
  WITH {VECS} SELECT vec_id, cid AS attribute, round(list_cosine_similarity(v, c), 6) AS similarity FROM vecs JOIN centroids ON cid // 5 = label // 5""")
def j15(spark, d):
    a = vecs(spark, d).withColumn("entity", F.floor(F.col("label") / 5)).drop("label")
    b = centroids(spark, d).select(F.floor(F.col("cid") / 5).alias("entity"), F.col("cid").alias("attribute"), "c")
    return vo.cosine_join(a, b, ["entity"], "v", "c").select("vec_id", "attribute", F.round("similarity", 6).alias("similarity"))


@query("F06_outside_dead_zone", f"""
  WITH {VECS}, s AS (SELECT vec_id, list_cosine_similarity(v, c) AS s FROM vecs JOIN centroids ON cid = (label + 1) % 10)
  SELECT vec_id, round(s, 6) AS similarity FROM s WHERE s <= -0.05 OR s >= 0.05""")
def f06(spark, d):
    nxt = centroids(spark, d).withColumn("cid", F.pmod(F.col("cid") - 1, F.lit(10))).withColumnRenamed("cid", "label")
    sims = vo.cosine_join(vecs(spark, d), nxt, ["label"], "v", "c")
    return filters.outside_dead_zone(sims, "similarity", -0.05, 0.05).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("V02_normalise_and_dot", f"""
  WITH {VECS} SELECT vec_id, round(list_dot_product([x / sqrt(list_dot_product(v, v)) FOR x IN v], c), 6) AS dot, round(sqrt(list_dot_product(v, v)), 6) AS norm
  FROM vecs JOIN centroids ON cid = label""")
def v02(spark, d):
    c = centroids(spark, d).withColumnRenamed("cid", "label")
    return vecs(spark, d).join(c, "label").select(
        "vec_id", F.round(vx.dot(vx.l2_normalize(F.col("v")), F.col("c")), 6).alias("dot"), F.round(vx.norm(F.col("v")), 6).alias("norm"))


def long_form(pooled, key):
    return pooled.select(key, F.posexplode("pooled").alias("pos", "x")).select(key, "pos", F.round("x", 6).alias("x"))


@query("V03_masked_mean_pool", """
  WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding[1] > 0))
  SELECT label, (i - 1)::INT AS pos, round(avg(x), 6) AS x FROM e GROUP BY label, i""")
def v03(spark, d):
    return long_form(vo.mean_pool(vecs(spark, d), "label", "v", mask=F.get("v", F.lit(0)) > 0), "label")


@query("V04_attention_pool", """
  WITH e AS (SELECT label, embedding[1]::DOUBLE * 10 AS s, embedding FROM embeddings WHERE embedding[2] > -0.2),
  w AS (SELECT label, exp(s - max(s) OVER (PARTITION BY label)) AS w, embedding FROM e),
  x AS (SELECT label, w, i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM w))
  SELECT label, (i - 1)::INT AS pos, round(sum(w * x) / sum(w), 6) AS x FROM x GROUP BY label, i""")
def v04(spark, d):
    score = F.get("v", F.lit(0)) * 10
    # the mask compares the stored single-precision value
    mask = F.get("v", F.lit(1)) > F.lit(-0.2)
    return long_form(vo.attention_pool(vecs(spark, d), "label", "v", score, mask), "label")


CANDS = f"""{VECS}, cand AS (SELECT vec_id, label, k AS pos, (label + k) % 10 AS cid, v FROM vecs, (SELECT unnest(range(0, 5)) AS k)),
  scores AS (SELECT vec_id, label, pos, cid, list_cosine_similarity(v, c) AS s FROM cand JOIN centroids USING (cid))"""


def scores(spark, d):
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("label") + k) % 10)
    return vo.candidate_scores(vecs(spark, d).withColumn("ids", ids), "vec_id", "v", "ids", centroids(spark, d), "cid", "c")


@query("V05_best_candidate", f"""
  WITH {CANDS} SELECT vec_id, arg_max(cid, (s, -pos))::INT AS candidate, round(max(s), 6) AS similarity FROM scores GROUP BY vec_id""")
def v05(spark, d):
    return vo.best_candidate(scores(spark, d), "vec_id").withColumn("similarity", F.round("similarity", 6))


@query("V06_evaluation_losses", f"""
  WITH {CANDS}, ce AS (SELECT vec_id, ln(sum(exp(s))) - max(s) FILTER (pos = 0) AS ce, max(s) FILTER (pos = 0) AS z, any_value(label) % 2 AS y FROM scores GROUP BY vec_id)
  SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 6) AS bce, round(avg(ce), 6) AS cross_entropy, count(*) AS n FROM ce""")
def v06(spark, d):
    logits = scores(spark, d).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "similarity"))).alias("l"))
    rows = logits.join(vecs(spark, d).select("vec_id", (F.col("label") % 2).alias("y")), "vec_id").withColumn("l", F.col("l.similarity"))
    z = F.get("l", F.lit(0))
    return rows.agg(
        F.round(F.avg(vx.bce_logits(z, F.col("y"))), 6).alias("bce"),
        F.round(F.avg(vx.cross_entropy(F.col("l"), F.lit(0))), 6).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


@query("V04_alpha_mix", f"""
  WITH {VECS} SELECT vec_id, round(list_sum(list_transform(list_zip(v, c), lambda z: (0.3 * z[1] + 0.7 * z[2]) ** 2)), 6) AS energy FROM vecs JOIN centroids ON cid = label""")
def v04b(spark, d):
    c = centroids(spark, d).withColumnRenamed("cid", "label")
    mixed = vo.mix(F.col("v"), F.col("c"), 0.3)
    return vecs(spark, d).join(c, "label").select("vec_id", F.round(vx.dot(mixed, mixed), 6).alias("energy"))
