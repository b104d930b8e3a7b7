"""Hand-worked cases for the order-dependent operators."""

from pyspark.sql import functions as F

from docattr.functions import answers, text as tx
from docattr.operators import graph, identity, matching, mentions, metrics, ordered, pages, segmentation, spans, votes


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*items):
    return F.array(*[F.lit(i) for i in items])


PAGE = """<html><body><div id="main-article"><h1>A</h1><h2>B</h2><div class="folderlabel">F</div>
<div class="folder"><ul><li><a href="/p/Main/Foo">Foo</a>: bar</li></ul></div>
<h2>C</h2><div class="folder"><h3>x:y</h3><ul><li><a href="/p/Main/Baz">Baz</a> is it</li>
<li><a href="/p/Other/Z">Z</a>: no</li></ul></div></div></body></html>"""


def test_nested_page_paths(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    got = pages.entity_attributes(pages.article_stream(df), "page_id", "Main/")
    assert rows(got, "path", "url", "explanation") == [
        ("A->B->F", "/p/Main/Foo", "bar"), ("A->C", "/p/Main/Baz", "Baz is it")]


def test_script_segments(spark):
    lines = strings(*"abcdefghi")
    got = one(spark, segmentation.script_segments(lines, F.lit("SNNCDDXCS")))
    assert [(s.kind, s.text, s.speaker) for s in got] == [
        ("slugline", "a", ""), ("desc", "b c", ""), ("utter", "d e f g", "d"), ("other", "h", ""), ("slugline", "i", "")]


def test_script_tail_is_kept_or_dropped(spark):
    lines = strings("a", "b")
    assert [s.kind for s in one(spark, segmentation.script_segments(lines, F.lit("SC")))] == ["slugline", "other"]
    assert [s.kind for s in one(spark, segmentation.script_segments(lines, F.lit("SC"), drop_tail=True))] == ["slugline"]


def test_answers(spark):
    assert [one(spark, answers.yes_no(F.lit(t))) for t in ("Yes, he", " NO", "maybe", "")] == [1, 0, None, None]
    conf = answers.confidence(F.lit(2), F.lit(1), F.lit(0), F.lit(0))
    assert one(spark, F.struct(conf, answers.confidence_label(conf), answers.confidence_weight(conf))) == (5, 1, 0.75)
    assert one(spark, answers.last_option(F.lit("kind or brave"), strings("brave", "kind"))) == "kind"
    assert one(spark, answers.last_option(F.lit("neither"), strings("brave", "kind"))) is None


def test_padded_ids(spark):
    ids = identity.numbered(spark.range(1000).select(F.col("id").alias("k")), ["k"], "C", "cid")
    assert rows(ids.filter("k in (0, 999)"), "k", "cid") == [(0, "C0000"), (999, "C0999")]


def test_names(spark):
    assert one(spark, tx.aliases(F.lit("Dr Ann Lee"))) == sorted(
        {"Dr Ann Lee", "DR ANN LEE", "Ann Lee", "ANN LEE", "Dr Ann", "DR ANN", "Dr Lee", "DR LEE", "Ann", "ANN", "Lee", "LEE"})
    assert one(spark, tx.clean_name(F.lit("ANN (V.O.)"))) == "ANN"
    assert one(spark, tx.clean_name(F.lit("a.b-c'd"))) is None
    assert one(spark, tx.leaf_name(strings("X", "Ann", "A-C"))) == "Ann"
    assert one(spark, tx.human_list(strings("a", "b", "c"))) == "a, b and c"
    assert one(spark, tx.ascii_fold(F.lit("Élan ßø – “x”"))) == "Elan sso - \"x\""


def test_matching(spark):
    scores = spark.createDataFrame([(0, "a0", "b0", .9), (0, "a0", "b1", .8), (0, "a1", "b0", .8), (0, "a1", "b1", .1)],
                                   "blk int, a string, b string, s double")
    assert rows(matching.greedy_matching(scores, "blk", "a", "b", ["s"]), "a", "b") == [("a0", "b0"), ("a1", "b1")]
    names = spark.createDataFrame([(0, "Ann Lee")], "blk int, n string")
    cast = spark.createDataFrame([(0, "Ann Ray"), (0, "Bob Lee")], "blk int, m string")
    assert matching.best_unique_match(names, cast, "blk", "n", "m").count() == 0


def test_name_similarity(spark):
    assert one(spark, matching.lcs_length(F.lit("abcbdab"), F.lit("bdcaba"))) == 4
    long_a, long_b = "ab" * 40, "ba" * 40
    assert one(spark, matching.lcs_length(F.lit(long_a), F.lit(long_b))) == 79
    assert one(spark, matching.token_set_ratio(F.lit("Ann Lee"), F.lit("lee, ann b."))) == 1.0
    assert one(spark, matching.token_set_ratio(F.lit("fuzzy was a bear"), F.lit("fuzzy fuzzy was a cat"))) == 0.85
    assert one(spark, matching.token_set_ratio(F.lit(""), F.lit("x"))) == 0.0


def test_votes(spark):
    v = spark.createDataFrame([("u", "w1", "yes", 1), ("u", "w2", "yes", 2), ("u", "w3", "notsure", 3)],
                              "unit string, worker string, answer string, id int").withColumn("ok", F.lit(True))
    table = votes.vote_table(v, ["unit"], "ok")
    assert rows(table, "n", "combination", "notsure") == [(2, "2000", 1)]
    assert votes.combination_distribution(table).count() == 35
    twice = spark.createDataFrame([("u", "w", "maybeyes", 1), ("u", "w", "no", 2)], "unit string, worker string, answer string, id int")
    assert rows(votes.one_vote_per_worker(twice, ["unit"], "worker", "id"), "answer") == [("no",)]


def test_alpha_limits(spark):
    full = spark.createDataFrame([(u, w, "yes" if u < 3 else "no") for u in range(6) for w in range(3)], "unit int, worker int, answer string")
    assert one_alpha(full) == 1.0
    split = spark.createDataFrame([(u, w, "yes" if w else "no") for u in range(4) for w in range(2)], "unit int, worker int, answer string")
    assert one_alpha(split) < 0


def one_alpha(df):
    return votes.krippendorff_ordinal(df, ["unit"], ["no", "maybeno", "maybeyes", "yes"]).first()["alpha"]


def test_keyed_metrics(spark):
    p = spark.createDataFrame([("k", 1, 0, 1), ("k", 1, 1, 2), ("m", 0, None, 3)], "k string, label int, pred int, o int")
    got = metrics.evaluate(p, ["k"], "o").first()
    assert (got["scored_keys"], got["total_keys"], got["accuracy"], got["recall"]) == (1, 2, 1.0, 1.0)


def test_accuracy_at_k(spark):
    p = spark.createDataFrame([("k", "yes", .9, 0, 1), ("k", "yes", .8, 1, 2)], "k string, r string, p double, l int, o int")
    assert [metrics.accuracy_at_k(p, "k", "p", "l", k, "r", "o").first()["accuracy"] for k in (1, 2)] == [0.0, 1.0]


def test_permutation_of_few_rows_is_exact(spark):
    a = spark.createDataFrame([(i, 1, 1) for i in range(4)], "k int, label int, pred int")
    b = spark.createDataFrame([(i, 1, 0) for i in range(4)], "k int, label int, pred int")
    got = metrics.permutation_test(a, b, ["k"], "accuracy", seed=1, method="exact").first()
    assert (got["statistic"], got["p"]) == (1.0, 2 / 16)


def test_row_local_order(spark):
    assert one(spark, ordered.pack_min(F.array(*[F.lit(n) for n in (5, 5, 5, 30, 3)]), 12)) == [0, 0, 1, 2, 3]
    assert one(spark, ordered.budget_prefix(F.array(F.lit(5), F.lit(9), F.lit(2)), 8)) == 1
    flags = F.array(*[F.lit(f) for f in (False, True, True, False, False, True)])
    assert one(spark, ordered.islands(flags)) == [(1, 2), (5, 5)]


def test_cues(spark):
    text = F.lit("Foo is the opposite of <attr value=Main/Bar>BAR</attr> . See <attr value=Main/Baz>a baz</attr> too.")
    assert one(spark, segmentation.cued_attributes(segmentation.typed_sentences(text))) == ["Bar"]


def test_boundary_is_consumed(spark):
    got = one(spark, mentions.mention_spans(F.lit("Ann met Ann Ann."), mentions.mention_pattern(strings("Ann"))))
    assert [s.start for s in got] == [0, 8]
    far = one(spark, mentions.mention_spans(F.lit("😀 Ann"), mentions.mention_pattern(strings("Ann"))))
    assert [(s.start, s.end) for s in far] == [(2, 5)]


def test_longest_of_overlapping_mentions_is_replaced(spark):
    segs = spark.createDataFrame([(1, 0, "Ann Lee saw")], "doc_id long, seg_no int, text string")
    cast = spark.createDataFrame([(1, "Ann", ["Ann"], "C1"), (1, "Ann Lee", ["Ann Lee"], "C22")],
                                 "doc_id long, entity string, aliases array<string>, code string")
    got = mentions.anonymize(segs, cast).first()
    assert got["text"] == "C22 saw"
    assert [(m.entity, m.start, m.end) for m in got["mentions"]] == [("Ann Lee", 0, 3)]


def pair(text, *ss):
    none = F.array().cast("array<struct<start:int,end:int>>")
    lit = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ss]) if ss else none
    return F.struct(F.lit(text).alias("text"), lit.alias("spans"))


def test_span_arithmetic(spark):
    got = one(spark, spans.join_parts(F.array(pair("ab", (0, 1)), pair("cd", (1, 2))), " "))
    assert got.text == "ab cd" and got.spans == [(0, 1), (4, 5)]
    p = pair("a  b   c  d", (3, 4), (7, 8))
    got = one(spark, spans.clean_between_spans(p["text"], p["spans"]))
    assert got.text == "a b c  d" and got.spans == [(2, 3), (4, 5)]


def test_span_at_a_paragraph_end_stays_inside(spark):
    p = pair("a b\nc d", (2, 3), (4, 5))
    parts = one(spark, spans.split_paragraphs(p["text"], p["spans"], 1))
    assert [(x.text, x.spans) for x in parts] == [("a b", [(2, 3)]), ("c d", [(0, 1)])]


def test_components_and_numbers(spark):
    bridge = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3")], "e string, d string")
    nodes = graph.bipartite_components(bridge, "e", "d")
    ids = graph.number_components(nodes, F.col("root"))
    got = graph.tag_bridge(bridge, "d", nodes, ids)
    assert rows(got, "e", "d", "component") == [("a", "1", "N0"), ("b", "1", "N0"), ("b", "2", "N0"), ("c", "3", "N1")]


def test_leakage_safe_split(spark):
    bridge = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("c", 2), ("d", 2)], "e string, d int")
    test = spark.createDataFrame([("a",)], "e string")
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "x", None), ("c", "x", None), ("d", "x", None)],
                                 "e string, t string, label int")
    got = graph.leakage_safe_split(bridge, "e", "d", test, rows, "t")
    assert {(r["e"], r["t"]): r["partition"] for r in got.collect()} == {
        ("a", "x"): "test", ("a", "y"): "dev", ("b", "x"): "dev", ("c", "x"): None, ("d", "x"): "train"}


def test_greedy_cover(spark):
    bridge = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "z"), (3, "z")], "d int, s string")
    got = graph.greedy_cover(bridge, "d", "s").orderBy("step").collect()
    assert [(r["d"], r["gain"], round(r["coverage"], 1)) for r in got] == [(1, 2, 66.7), (2, 1, 100.0)]
