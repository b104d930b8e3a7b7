"""One query per operator on the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docattr.llm import chat, lines, media, merkle, mixing, negatives, packing, pii, simhash, substrings, syncmers, toxicity, urls

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = dedent(sql).strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixing", r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
      FROM d GROUP BY source),
    w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][rank % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
    r AS (
      SELECT *, cap / w AS ratio,
             coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws,
             sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM w),
    lv AS (
      SELECT (total * 1.5::DOUBLE - caps) / (all_w - ws) AS level FROM r
      WHERE (total * 1.5::DOUBLE - caps) / (all_w - ws) < ratio ORDER BY ratio, rank LIMIT 1),
    t AS (SELECT source, source_size, rank, least(cap, w * (SELECT level FROM lv)) AS target FROM r),
    q AS (
      SELECT d.doc_id, d.size, t.*, md5('17|' || d.doc_id::VARCHAR) AS h,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17|' || d.doc_id::VARCHAR), d.doc_id, d.size
                               ROWS UNBOUNDED PRECEDING) AS hi
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (
      SELECT q.*, epoch, greatest(0, least(size, ceil(target) - (hi + epoch * source_size - size))) AS words,
             CASE WHEN target > 0 THEN least(hi + epoch * source_size, ceil(target)) / target ELSE 0 END AS finish
      FROM q, (VALUES (0), (1)) AS v(epoch)),
    m AS (
      SELECT *, sum(words) OVER (ORDER BY finish, rank, epoch, hi, h, size ROWS UNBOUNDED PRECEDING) - words AS pos,
             floor((SELECT sum(size) FROM d) * 1.5::DOUBLE) AS budget FROM e),
    k AS (SELECT *, greatest(0, least(words, budget - pos)) AS kept FROM m)
    SELECT doc_id, source, size, source_size, target, sum(kept)::BIGINT AS taken,
           (min(pos) FILTER (WHERE kept > 0))::BIGINT AS position
    FROM k GROUP BY doc_id, source, size, source_size, target, hi
""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).withColumn("position", F.col("position").cast("long"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _pii_sql() -> str:
    """The base patterns as they are stated, the pieces between the matches for positions, and counts of documents."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, regexp_extract_all(text, '{p}') AS hs, string_split_regex(text, '{p}') AS gs FROM d"
        for n, p in enumerate(plain.values()))
    luhn = ("list_sum(list_transform(range(1, length(dg) + 1), lambda i: "
            "substr(reverse(dg), i::INT, 1)::INT * (2 - i % 2) - CASE WHEN substr(reverse(dg), i::INT, 1)::INT * (2 - i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0")
    name = "CASE kind WHEN 0 THEN 'email' WHEN 1 THEN 'ip' WHEN 2 THEN 'card' WHEN 3 THEN 'phone' ELSE 'term' END"
    blank = r"[\x20\x09-\x0D]"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    hits AS (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM ({found}) WHERE len(hs) > 0),
    placed AS (
      SELECT doc_id, kind, hs[i] AS value, regexp_replace(hs[i], '[^0-9]', '', 'g') AS dg,
             list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS start FROM hits),
    base AS (
      SELECT *, start + length(value) AS stop FROM placed WHERE CASE kind WHEN 0 THEN true
        WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0
        WHEN 2 THEN length(dg) BETWEEN 14 AND 19 AND {luhn} ELSE length(dg) BETWEEN 10 AND 15 END),
    pieces AS (
      SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM (SELECT doc_id, string_split_regex(text, '{blank}') AS ps FROM d)),
    words AS (
      SELECT doc_id, lower(piece) AS term, length(piece) AS n,
             coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM pieces QUALIFY regexp_matches(term, '\p{{L}}') AND NOT regexp_matches(term, '[0-9@]')),
    held AS (SELECT DISTINCT doc_id, term FROM words),
    seen AS (SELECT term, count(*) AS n_t FROM held GROUP BY term),
    ents AS (SELECT kind, value, count(DISTINCT doc_id) AS n_c FROM base GROUP BY ALL),
    pairs AS (SELECT kind, value, term, count(*) AS n_ct FROM (SELECT DISTINCT doc_id, kind, value FROM base) JOIN held USING (doc_id) GROUP BY ALL),
    told AS (
      SELECT DISTINCT term FROM pairs JOIN ents USING (kind, value) JOIN seen USING (term), (SELECT count(*)::DOUBLE AS total FROM d)
      WHERE n_c < total AND log2(total * n_ct / (n_c * (n_t + 1.0::DOUBLE))) / log2(total / n_c) >= 0.9 - 1e-9),
    terms AS (SELECT doc_id, 4 AS kind, start, start + n AS stop FROM words JOIN told USING (term)),
    every AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT * FROM terms),
    listed AS (
      SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card,
             count(*) FILTER (kind = 3) AS n_phone, count(*) FILTER (kind = 4) AS n_term,
             string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
             string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 4) AS base FROM every GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
    FROM d LEFT JOIN listed USING (doc_id)"""


@query("op4_pii", _pii_sql())
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op5_chat_formatting", r"""
    WITH RECURSIVE c AS (SELECT * FROM conversations),
    calls AS (SELECT conv_id, turn, text FROM c WHERE role = 'user'),
    walk AS (
      SELECT conv_id, turn, turn AS at, 0::BIGINT AS n, turn >= 2 AS waits, false AS lost FROM calls
      UNION ALL
      SELECT w.conv_id, w.turn, w.at - 2, w.n + (p.turn IS NOT NULL)::BIGINT, p.turn IS NOT NULL AND w.at - 2 >= 2, p.turn IS NULL
      FROM walk w LEFT JOIN calls p ON p.conv_id = w.conv_id AND p.turn = w.at - 2 WHERE w.waits),
    level AS (SELECT conv_id, turn, n AS level, lost FROM walk WHERE NOT waits),
    results AS (SELECT conv_id, turn, text FROM c WHERE role = 'assistant'),
    linked AS (
      SELECT k.conv_id, level, k.turn, 'call' AS kind, k.turn::VARCHAR AS call_id, lost, r.turn IS NOT NULL AS answered,
             length(coalesce(k.text, '')) > 0 AS valid, k.text, r.text AS result
      FROM calls k JOIN level USING (conv_id, turn) LEFT JOIN results r ON r.conv_id = k.conv_id AND r.turn = k.turn + 1)
    SELECT conv_id, level, turn, 0::BIGINT AS place, kind, call_id,
           CASE WHEN lost THEN 'missing_dependency' WHEN NOT valid THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
           CASE WHEN valid THEN '' WHEN text IS NULL THEN '$.question: missing' ELSE '$.question: length' END AS problems,
           '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"question":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '},"id":"'
           || call_id || '","name":"reply"' || CASE WHEN answered THEN ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') ELSE '' END || '}' AS json
    FROM linked
    UNION ALL
    SELECT conv_id, 0, turn, 0, 'message', NULL, 'ok', NULL,
           '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
    FROM c WHERE role IS NULL OR role NOT IN ('user', 'assistant')
    UNION ALL
    SELECT r.conv_id, 0, r.turn, 0, 'result', (r.turn - 1)::VARCHAR, 'orphan_result', NULL, coalesce(to_json(r.text)::VARCHAR, 'null')
    FROM results r LEFT JOIN calls k ON k.conv_id = r.conv_id AND k.turn = r.turn - 1 WHERE k.turn IS NULL
""")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(chat.as_calls(table(spark, sf_dir, "conversations")))


@query("op6_substring_dedup", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again)),
    pos AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
    kept AS (
      SELECT pos.doc_id, count(*) - count(gone.p) AS n, string_agg(word, ' ' ORDER BY pos.p) FILTER (gone.p IS NULL) AS t
      FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_media_columns")
def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "shard", "offset")


@query("op9_url_filters", r"""
    WITH u AS (
      SELECT page_id, url,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
             list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'),
                       lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept FROM pages),
    c AS (
      SELECT *, CASE WHEN regexp_replace(host, '^www\.|:(80|443)$', '', 'g') <> '' THEN
               regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '')
               || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key FROM u),
    l AS (SELECT DISTINCT key AS lk FROM c WHERE regexp_matches(host, '(^|\.)ads?[.-]') AND key IS NOT NULL),
    j AS (SELECT c.*, lk IS NOT NULL AS listed FROM c LEFT JOIN l ON key = lk)
    SELECT page_id, host, path, listed,
      CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
           WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
           WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
           WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
      CASE rule WHEN 'example.org/en/1' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'com/fr/' THEN 'allow'
           WHEN 'com/de/' THEN 'block' WHEN 'org/' THEN 'allow' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
    FROM j
""")
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: all URLs of the table on advertising hosts (a label ``ad`` or ``ads``)."""
    pages = table(spark, sf_dir, "pages")
    ads = pages.filter(urls.host(F.col("url")).rlike(r"(^|\.)ads?[.-]")).select("url")
    return urls.judge(pages, ads).drop("maybe")


@query("op10_syncmers")
def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_report(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", r"""
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


def _merkle_sql() -> str:
    def digest(n_chars: str) -> str:
        fields = ("doc_id", "source", "lang", n_chars, "text")
        return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"

    # CRC-32 by eight shifts a byte
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    return rf"""
    WITH RECURSIVE
    crc AS (
      SELECT doc_id, doc_id::VARCHAR AS s, 1 AS byte, 0 AS bit, xor(4294967295, ascii(substr(doc_id::VARCHAR, 1, 1))::BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
      UNION ALL
      SELECT doc_id, s, CASE WHEN bit = 7 THEN byte + 1 ELSE byte END, (bit + 1) % 8,
             CASE WHEN bit = 7 AND byte < length(s) THEN xor({step.format('c')}, ascii(s[byte + 1])::BIGINT) ELSE {step.format('c')} END
      FROM crc WHERE byte <= length(s)),
    hit AS (SELECT doc_id FROM crc WHERE byte > length(s) AND xor(c, 4294967295) % 7 = 0),
    leaf AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
      FROM (SELECT doc_id, lang, {digest('n_chars')} AS h,
              CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {digest('n_chars + 1')} ELSE {digest('n_chars')} END AS claimed FROM documents)),
    ranked AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
    base AS (SELECT leaf.*, tree FROM leaf JOIN ranked ON leaf.lang IS NOT DISTINCT FROM ranked.lang),
    low AS (
      SELECT tree, 0 AS level, pos, n, h FROM base
      UNION ALL
      SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n),
    sub AS (SELECT tree, h, level FROM low WHERE n = 1),
    top AS (
      SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, h FROM sub
      UNION ALL
      SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
    node AS (
      SELECT tree, level, pos, n, h FROM low WHERE n > 1
      UNION ALL SELECT sub.tree, sub.level + top.level, top.pos, top.n, top.h FROM sub, top WHERE top.n > 1),
    climb AS (
      SELECT tree, pos AS place, 0 AS level, pos, claimed AS folded, '' AS proof FROM base
      UNION ALL
      SELECT c.tree, c.place, c.level + 1, c.at // 2,
             sha256(CASE WHEN c.at % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END), proof || coalesce(s.h, '')
      FROM (SELECT climb.*, CASE WHEN climb.level = sub.level THEN climb.tree ELSE climb.pos END AS at FROM climb JOIN sub USING (tree)) c
      JOIN (SELECT DISTINCT tree, level FROM node) l ON l.tree = c.tree AND l.level = c.level
      LEFT JOIN node s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.at, 1)),
    done AS (SELECT tree, place, folded, proof FROM climb QUALIFY row_number() OVER (PARTITION BY tree, place ORDER BY level DESC) = 1)
    SELECT doc_id, base.h AS leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
    FROM base JOIN sub USING (tree) JOIN done ON done.tree = base.tree AND done.place = base.pos, (SELECT h FROM top WHERE n = 1) r"""


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


@query("op13_line_dedup", r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (
      SELECT r, doc_id, i, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
    f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key),
    k AS (SELECT l.*, first IS NULL OR doc_id IS NOT DISTINCT FROM first AS stays FROM l LEFT JOIN f ON l.key = f.key)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
    FROM k GROUP BY r
""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))
