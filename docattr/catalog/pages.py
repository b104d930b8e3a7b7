"""Page and text extraction on the given tables."""

from pyspark.sql import functions as F

from docattr.catalog import views as v
from docattr.catalog.registry import query, table
from docattr.functions import answers, html as h, text as tx
from docattr.operators import pages as pg, segmentation as sg

ANCHOR = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def plain_sql(x):
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in h.ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, name.replace("'", "''"), char.replace("'", "''"))
    return v.squeeze_sql(out)


LINKS = f"""links AS (SELECT page_id, url, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href, unnest(ts) AS raw FROM (
    SELECT page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) AS hs, regexp_extract_all(html, '{ANCHOR}', 2) AS ts FROM pages))"""


@query("X01_links_in_order", f"WITH {LINKS} SELECT page_id, pos::INT AS pos, href, {plain_sql('raw')} AS text FROM links")
def x01(spark, d):
    return pg.links(table(spark, d, "pages"))


@query("X02_absolute_and_filtered", f"""
  WITH {LINKS} SELECT page_id, pos::INT AS pos, 'https://example.org' || href AS url FROM links WHERE contains(href, '/th')""")
def x02(spark, d):
    found = pg.links(table(spark, d, "pages"))
    return found.select("page_id", "pos", h.absolute(F.col("href"), "https://example.org").alias("url")).filter(
        F.col("url").contains("/th"))


def blocks_sql(tags, source="pages", cols="page_id"):
    names = "|".join(tags)
    pat = rf"(?s)<({names})(?:\s[^>]*)?>(.*?)</(?:{names})>"
    return f"""blocks AS (SELECT {cols}, generate_subscripts(ks, 1) - 1 AS pos, unnest(ks) AS kind, unnest(bs) AS inn FROM (
    SELECT {cols}, regexp_extract_all(html, '{pat}', 1) AS ks, regexp_extract_all(html, '{pat}', 2) AS bs FROM {source}))"""


@query("X03_element_stream", f"""
  WITH {blocks_sql(['h1', 'p', 'li'])} SELECT page_id, pos::INT AS pos, kind, {plain_sql('inn')} AS text FROM blocks""")
def x03(spark, d):
    return pg.elements(table(spark, d, "pages"), ["h1", "p", "li"]).drop("inner")


def nested_pages(spark, d):
    """The pages' headings, paragraphs and lists arranged as an article with folders."""
    html = F.regexp_replace("html", r"<article>", '<div id="main-article"><h2>Body</h2><div class="folderlabel">Links</div>')
    html = F.regexp_replace(html, r"</article>", "</div>")
    nav = F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)
    html = F.replace(html, F.lit('<div class="folderlabel">Links</div>'),
                     F.concat(F.lit('<div class="folderlabel">Links</div><div class="folder"><h3>All</h3>'), nav, F.lit("</div>")))
    return table(spark, d, "pages").select("page_id", html.alias("html"))


STRICT = f"""
  WITH nav AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS n FROM pages WHERE contains(html, '<article>')),
  l AS (SELECT page_id, generate_subscripts(hs, 1) AS i, unnest(hs) AS url, unnest(ts) AS raw FROM (
    SELECT page_id, regexp_extract_all(n, '{ANCHOR}', 1) AS hs, regexp_extract_all(n, '{ANCHOR}', 2) AS ts FROM nav))
  SELECT page_id, (i + 2)::INT AS pos, 'Body->Links->All' AS path, url, {plain_sql('raw')} AS explanation FROM l WHERE contains(url, '/')"""


@query("D04_strict_article_parser", STRICT)
def d04(spark, d):
    return pg.entity_attributes(pg.article_stream(nested_pages(spark, d)), "page_id", "/")


@query("D04_table_function", STRICT)
def d04b(spark, d):
    pg.register_table_functions(spark)
    stream = spark.sql("SELECT p.page_id, e.* FROM {pages} AS p, LATERAL html_elements(p.html) AS e", pages=nested_pages(spark, d))
    return pg.entity_attributes(stream, "page_id", "/")


LEVELED = f"""lines AS (SELECT doc_id, pos, line, CASE WHEN {v.wc_sql('line')} BETWEEN 1 AND 3 THEN {v.wc_sql('line')} END AS level FROM (
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query("X04_heading_paths", f"""
  WITH {LEVELED}, c AS (SELECT doc_id, pos, line, level,
    {", ".join(f"last_value(CASE WHEN level = {k} THEN line END IGNORE NULLS) OVER w AS s{k}" for k in (1, 2, 3))},
    coalesce(last_value(level IGNORE NULLS) OVER w, 0) AS depth
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, pos::INT AS pos, array_to_string(list_filter([s1, s2, s3][:depth], lambda x: x IS NOT NULL), '->') AS path
  FROM c WHERE level IS NULL""")
def x04(spark, d):
    segs = v.segments(spark, d)
    n = tx.word_count(F.col("text"))
    stream = segs.withColumn("level", F.when(n.between(1, 3), n))
    paths = pg.heading_paths(stream, "doc_id", "seg_no", "level", "text", slots=3)
    return paths.select("doc_id", F.col("seg_no").alias("pos"), F.array_join("path", "->").alias("path"))


EXPLAINED = "(SELECT page_id, replace(html, '</a></li>', '</a>: see page ' || page_id || '</li>') AS html FROM pages)"


@query("X05_item_target_and_text", f"""
  WITH {blocks_sql(['li'], EXPLAINED)},
  i AS (SELECT page_id, pos, regexp_extract(inn, '{ANCHOR}', 1) AS url, {plain_sql(f"regexp_extract(inn, '{ANCHOR}', 2)")} AS link, {plain_sql('inn')} AS content FROM blocks)
  SELECT page_id, pos::INT AS pos, url, CASE WHEN starts_with(content, link || ':') THEN trim(substr(content, length(link) + 2)) ELSE content END AS explanation
  FROM i WHERE contains(url, '/t')""")
def x05(spark, d):
    see = F.concat(F.lit("</a>: see page "), F.col("page_id").cast("string"), F.lit("</li>"))
    pages = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</a></li>"), see))
    items = pg.elements(pages, ["li"]).withColumn("i", h.list_item(F.col("inner"), "/t"))
    return items.filter("i IS NOT NULL").select("page_id", "pos", "i.url", "i.explanation")


@query("X06_page_list_mining", f"""
  WITH {blocks_sql(['li'], 'pages', 'page_id, url')}
  SELECT url, regexp_extract(inn, '{ANCHOR}', 1) AS target, {plain_sql('inn')} AS text FROM blocks
  WHERE contains(regexp_extract(inn, '{ANCHOR}', 1), '/a')""")
def x06(spark, d):
    items = pg.elements(table(spark, d, "pages"), ["li"], key="url")
    target = F.regexp_extract("inner", h.ANCHOR, 1)
    return items.select("url", target.alias("target"), "text").filter(F.col("target").contains("/a"))


def definition_sql(tag, boundary, target):
    pat = rf"(?s)<({tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>"
    link = rf'(?s)<a\s[^>]*?href="([^"]*{target}[^"]*)"[^>]*>(.*?)</a>'
    marked = f"regexp_replace(b, '{link}', chr(1) || 'attr value=\\1' || chr(2) || '\\2' || chr(1) || '/attr' || chr(2), 'g')"
    text = f"translate({plain_sql(marked)}, chr(1) || chr(2), '<>')"
    return v.fold_sql(f"""array_to_string(list_filter([{text} FOR b IN
      list_filter(regexp_extract_all(string_split(html, '{boundary}')[1], '{pat}', 2), lambda y: NOT contains(y, '<div'))], lambda z: z <> ''), chr(10))""")


@query("X07_definition_block", f"""
  SELECT page_id, {definition_sql('p', '<footer', '/')} AS definition, {definition_sql('li', '<article', '/t')} AS marked FROM pages""")
def x07(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", pg.definition(html, "p", "<footer", "/").alias("definition"),
        pg.definition(html, "li", "<article", "/t").alias("marked"))


@query("X08_linked_attribute_set", f"""
  WITH m AS (SELECT page_id, {definition_sql('li', '<article', '/t')} AS marked FROM pages)
  SELECT page_id, array_to_string(list_sort(list_distinct([string_split(u, '/')[-1] FOR u IN regexp_extract_all(marked, '<attr value=([^>]*)>', 1)])), ';') AS linked FROM m""")
def x08(spark, d):
    marked = pg.definition(F.col("html"), "li", "<article", "/t")
    return table(spark, d, "pages").select("page_id", F.array_join(pg.linked_attributes(marked), ";").alias("linked"))


SEG_PAT = "(S+)|(N+)|((C+)([EDX]+))"
SCRIPT = f"""tagged AS (SELECT doc_id, ls, translate(array_to_string([substr('SNCDEOTM', length(x) % 8 + 1, 1) FOR x IN ls], ''), 'OTM', 'XXX') AS tags
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  runs AS (SELECT doc_id, ls, regexp_extract_all(tags, '{SEG_PAT}') AS ms, string_split_regex(tags, '{SEG_PAT}') AS gs FROM tagged),
  pieces AS (
    SELECT doc_id, ls, i * 2 AS k, 'other' AS kind, gs[i] AS run FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS i FROM runs)
    UNION ALL
    SELECT doc_id, ls, i * 2 + 1, CASE ms[i][1] WHEN 'S' THEN 'slugline' WHEN 'N' THEN 'desc' ELSE 'utter' END, ms[i]
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM runs)),
  placed AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY k) - length(run) AS s FROM pieces WHERE run <> ''),
  texts AS (SELECT doc_id, k, kind, {v.squeeze_sql(v.fold_sql("array_to_string(ls[s + 1:s + length(run)], ' ')"))} AS text,
    CASE WHEN kind = 'utter' THEN {v.squeeze_sql(v.fold_sql("array_to_string(ls[s + 1:s + length(regexp_extract(run, '^(C+)', 1))], ' ')"))} ELSE '' END AS speaker FROM placed),
  script AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS seg_no, kind, text, speaker FROM texts WHERE text <> '')"""


def script(spark, d):
    lines = F.split("text", "\n")
    tags = F.array_join(F.transform(lines, lambda x: F.substring(F.lit("SNCDEOTM"), F.length(x) % 8 + 1, F.lit(1))), "")
    return sg.segment_table(table(spark, d, "documents"), "doc_id", lines, tags)


@query("X09_script_segments", f"""
  WITH {SCRIPT} SELECT doc_id, seg_no, doc_id || '-' || kind || '-' || seg_no AS segment_id, kind, text, speaker FROM script""")
def x09(spark, d):
    return script(spark, d)


RESPONSE = r"""resp AS (SELECT doc_id, string_split(trim(text), chr(10)) AS ls FROM documents),
  parsed AS (SELECT doc_id, lower(regexp_replace(ls[1], '[^a-zA-Z]', '', 'g')) = 'yes' AS single,
    coalesce(lower(regexp_replace(ls[2], '[^a-zA-Z]', '', 'g')) = 'yes', false) AS portrayable,
    regexp_replace(regexp_replace(array_to_string(ls[3:], ' '), '^\s*3[^a-zA-Z]*', ''), '\s+', ' ', 'g') AS summary FROM resp)"""


@query("X10_structured_response", f"WITH {RESPONSE} SELECT * FROM parsed")
def x10(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.structured_response(F.col("text")).alias("r")).select("doc_id", "r.*")


CLUSTERED = f"""listed AS (SELECT doc_id, pos, CASE WHEN {v.wc_sql('line')} <= 3 THEN '### ' || line ELSE pos || '. ' || replace(line, '(', ' ') || ' (2001)' END AS line FROM (
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query("X11_cluster_list", rf"""
  WITH {CLUSTERED}, c AS (SELECT doc_id, pos, trim(last_value(nullif(regexp_extract(line, '^### (.+)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos)) AS cluster,
    trim(regexp_extract(line, '^\d+\. ([^\(]+) \(\d+\)', 1)) AS title FROM listed)
  SELECT doc_id, pos::INT AS pos, cluster, title FROM c WHERE title <> ''""")
def x11(spark, d):
    line = F.when(tx.word_count(F.col("text")) <= 3, F.concat(F.lit("### "), "text")).otherwise(
        F.concat(F.col("seg_no").cast("string"), F.lit(". "), F.replace("text", F.lit("("), F.lit(" ")), F.lit(" (2001)")))
    listed = v.segments(spark, d).select("doc_id", F.col("seg_no").alias("pos"), line.alias("line"))
    head = F.regexp_extract("line", r"^### (.+)$", 1)
    carried = pg.carry_forward(listed, "doc_id", "pos", F.trim(F.when(head != "", head)), "cluster")
    title = F.trim(F.regexp_extract("line", r"^\d+\. ([^\(]+) \(\d+\)", 1))
    return carried.select("doc_id", "pos", "cluster", title.alias("title")).filter("title <> ''")


@query("X12_first_word_answer", """
  WITH a AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'Yes, ' WHEN length(text) % 3 = 1 THEN ' NO ' ELSE '' END || text AS t FROM conversations WHERE role = 'assistant')
  SELECT conv_id, turn, CASE lower(regexp_extract(t, '([\\p{L}\\p{N}_]+)', 1)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS pred FROM a""")
def x12(spark, d):
    n = F.length("text") % 3
    said = F.concat(F.when(n == 0, "Yes, ").when(n == 1, " NO ").otherwise(""), F.col("text"))
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", answers.yes_no(said).alias("pred"))


OPTIONS = ["able", "erin", "tion", "eau", "cht"]


@query("X13_last_option_wins", f"""
  SELECT doc_id, list_filter({OPTIONS}, lambda o: contains(text, o))[-1] AS choice FROM documents""")
def x13(spark, d):
    options = F.array(*[F.lit(o) for o in OPTIONS])
    return table(spark, d, "documents").select("doc_id", answers.last_option(F.col("text"), options).alias("choice"))


@query("X14_ids_from_urls", r"""
  SELECT page_id, array_to_string(regexp_extract_all(url, '/(\d+)', 1), ';') AS ids FROM pages""")
def x14(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.array_join(F.regexp_extract_all("url", F.lit(r"/(\d+)"), 1), ";").alias("ids"))


# --- typed tokens -------------------------------------------------------------------------

TYPED = ["the", "of", "de", "la", "und", "que"]
CUES = ["is", "on", "et", "en", "der", "por"]
TOK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
TOKENS = f"""sents AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sent, unnest(ss) AS s FROM (
    SELECT doc_id, regexp_extract_all(text, '{sg.SENTENCE.replace("++", "+").replace("*+", "*")}') AS ss FROM documents)),
  toks AS (SELECT doc_id, sent, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS tok FROM (
    SELECT doc_id, sent, regexp_extract_all(s, '{TOK}') AS ts FROM sents)),
  typed AS (SELECT *, CASE WHEN tok IN ({", ".join(f"'{t}'" for t in TYPED)}) THEN tok ELSE 'token' END AS type FROM toks)"""


@query("M03_typed_tokens", f"WITH {TOKENS} SELECT doc_id, sent::INT AS sent, pos::INT AS pos, tok, type FROM typed")
def m03(spark, d):
    return sg.token_table(table(spark, d, "documents"), "doc_id", F.col("text"), TYPED)


@query("M04_cued_attributes", f"""
  WITH {TOKENS},
  heads AS (SELECT *, lag(type) OVER (PARTITION BY doc_id, sent ORDER BY pos) AS before FROM typed),
  runs AS (SELECT doc_id, sent, pos AS i, type FROM heads WHERE type <> 'token' AND before IS DISTINCT FROM type),
  near AS (SELECT r.doc_id, r.sent, r.i, r.type, t.pos > r.i AS rgt, lower(t.tok) AS w, min(abs(t.pos - r.i)) AS dist
    FROM runs r JOIN typed t ON t.doc_id = r.doc_id AND t.sent = r.sent AND t.type = 'token' AND t.tok NOT IN ('and', ',') GROUP BY ALL),
  top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, sent, i, rgt ORDER BY dist) <= 5),
  hit AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(type))), ';') AS cued FROM top WHERE w IN ({", ".join(f"'{c}'" for c in CUES)}) GROUP BY doc_id)
  SELECT doc_id, coalesce(cued, '') AS cued FROM documents LEFT JOIN hit USING (doc_id)""")
def m04(spark, d):
    sentences = sg.typed_sentences(F.col("text"), TYPED)
    docs = table(spark, d, "documents").select("doc_id", sentences.alias("s"))
    return docs.select("doc_id", F.array_join(sg.cued_attributes(F.col("s"), CUES), ";").alias("cued"))
