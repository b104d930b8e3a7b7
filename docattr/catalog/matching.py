"""Fuzzy name matching inside brands."""

from pyspark.sql import functions as F

from docattr.catalog.registry import query, table
from docattr.operators import matching as mt


def sides(spark, d):
    """Names (whole, and first words) against type-prefixed, reversed names of the same brand."""
    part = table(spark, d, "part")
    w = F.split("p_name", " ")
    a = part.select("p_brand", F.explode(F.array("p_name", F.get(w, F.lit(0)))).alias("name")).distinct()
    b = part.select("p_brand", F.concat_ws(" ", F.lower("p_type"), F.get(w, F.lit(1)), F.get(w, F.lit(0))).alias("member")).distinct()
    return a, b


def lcs_sql(a, b):
    return f"""list_reduce([[unicode(c)::BIGINT] FOR c IN string_split({a}, '')], lambda prev, ch:
      list_reduce([[j] FOR j IN range(1, length({b}) + 1)], lambda acc, jj: list_append(acc,
        CASE WHEN unicode(substr({b}, jj[1], 1)) = ch[1] THEN prev[jj[1]] + 1 ELSE greatest(prev[jj[1] + 1], acc[-1]) END), [0::BIGINT]),
      [0::BIGINT FOR x IN range(length({b}) + 1)])[-1]"""


SIDES = """a AS (SELECT DISTINCT p_brand, unnest([p_name, string_split(p_name, ' ')[1]]) AS name FROM part),
  b AS (SELECT DISTINCT p_brand, lower(p_type) || ' ' || string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS member FROM part),
  cand AS (SELECT p_brand, name, member, list_sort(list_distinct(string_split(name, ' '))) AS ta, list_sort(list_distinct(string_split(member, ' '))) AS tb
    FROM a JOIN b USING (p_brand) WHERE list_has_any(string_split(name, ' '), string_split(member, ' ')))"""
FUZZY = f"""{SIDES},
  fuzzy AS (SELECT * FROM (SELECT p_brand, name, member, {lcs_sql('name', 'member')} / length(name)::DOUBLE AS lcs, 1.0::DOUBLE AS tok FROM cand
    WHERE list_has_all(tb, ta) OR list_has_all(ta, tb)) WHERE lcs >= 0.5)"""


@query("M01_lcs_ratio", f"""
  WITH {SIDES} SELECT p_brand, name, member, round({lcs_sql('name', 'member')} / length(name)::DOUBLE, 6) AS ratio FROM cand""")
def m01(spark, d):
    a, b = sides(spark, d)
    pairs = mt.shared_tokens(a, b, "p_brand", "name", "member")
    return pairs.select("p_brand", "name", "member", F.round(mt.lcs_ratio(F.col("name"), F.col("member")), 6).alias("ratio"))


@query("M02_token_set_containment", f"""
  WITH {SIDES} SELECT p_brand, name, member, list_has_all(tb, ta) OR list_has_all(ta, tb) AS contained FROM cand""")
def m02(spark, d):
    a, b = sides(spark, d)
    pairs = mt.shared_tokens(a, b, "p_brand", "name", "member")
    return pairs.select("p_brand", "name", "member", (mt.token_set_ratio(F.col("name"), F.col("member")) >= 1).alias("contained"))


@query("J09_blocked_fuzzy_join", f"WITH {FUZZY} SELECT p_brand, name, member, round(lcs, 6) AS lcs, tok FROM fuzzy")
def j09(spark, d):
    a, b = sides(spark, d)
    return mt.fuzzy_pairs(a, b, "p_brand", "name", "member").withColumn("lcs", F.round("lcs", 6))


@query("J10_greedy_matching", f"""
  WITH RECURSIVE {FUZZY},
  srt AS (SELECT p_brand, list({{'a': name, 'b': member}} ORDER BY lcs DESC, tok DESC, name, member) AS ps FROM fuzzy GROUP BY p_brand),
  walk AS (
    SELECT p_brand, ps, 0 AS i, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub FROM srt
    UNION ALL
    SELECT p_brand, ps, i + 1,
      CASE WHEN list_contains(ua, ps[i + 1].a) OR list_contains(ub, ps[i + 1].b) THEN ua ELSE list_append(ua, ps[i + 1].a) END,
      CASE WHEN list_contains(ua, ps[i + 1].a) OR list_contains(ub, ps[i + 1].b) THEN ub ELSE list_append(ub, ps[i + 1].b) END
    FROM walk WHERE i < len(ps))
  SELECT p_brand, unnest(ua) AS name, unnest(ub) AS member FROM walk WHERE i = len(ps)""")
def j10(spark, d):
    a, b = sides(spark, d)
    pairs = mt.fuzzy_pairs(a, b, "p_brand", "name", "member")
    return mt.greedy_matching(pairs, "p_brand", "name", "member", ["lcs", "tok"]).select("p_brand", "name", "member")


@query("J11_best_unique_match", f"""
  WITH {SIDES}, n AS (SELECT p_brand, name, member, len(list_intersect(ta, tb)) AS shared FROM cand),
  r AS (SELECT *, max(shared) OVER (PARTITION BY p_brand, name) AS top FROM n)
  SELECT p_brand, name, any_value(member) AS member, any_value(shared) AS shared FROM r WHERE shared = top GROUP BY p_brand, name HAVING count(*) = 1""")
def j11(spark, d):
    a, b = sides(spark, d)
    return mt.best_unique_match(a, b, "p_brand", "name", "member")
