"""Cases that once went wrong: null groups, deep loops, lost bytes and rows, key types."""

import pytest
from pyspark.sql import functions as F

from docattr import session
from docattr.operators import filters, graph, matching, metrics, ordered, prompts, sampling, segmentation
from docattr.sources import readers
from docattr.streaming import ingest


def test_a_null_group_over_several_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), "id")
    got = ordered.running_total(rows.repartition(4), ["id"], F.lit(1), "n", ["g"]).groupBy("g").agg(F.max("n").alias("n"))
    assert {r.g: r.n for r in got.collect()} == {None: 1000, "a": 2000}
    middle = ordered.quantiles(rows, "id", {"p50": 0.5}, ["g"]).collect()
    assert {r.g: r.p50 for r in middle} == {None: 1498.5, "a": 1500.0}


def test_whole_files_keep_their_last_newlines(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "a.txt").write_text("x\n\n")
    assert readers.read_texts(spark, str(tmp_path), r"k=(\d+)").first().text == "x\n\n"
    assert readers.read_texts(spark, str(tmp_path), r"k=(\d+)", drop_final_newline=True).first().text == "x\n"


def test_sentences_of_many_open_brackets(spark):
    df = spark.createDataFrame([("<" * 20_000 + " end. Next <attr value=/a/B>b</attr> one!",)], "t string")
    found = df.select(F.regexp_extract_all("t", F.lit(segmentation.SENTENCE), 0).alias("s")).first()["s"]
    assert [s[-5:] for s in found] == [" end.", " one!"]


@pytest.mark.parametrize("n", [9, 10])
def test_the_method_of_a_permutation_test_is_named(spark, n):
    a = spark.createDataFrame([(i, 1, 1) for i in range(n)], "k int, label int, pred int")
    b = a.withColumn("pred", F.lit(0))
    exact = metrics.permutation_test(a, b, ["k"], "accuracy", seed=1, method="exact").first()
    assert exact.p == 2 / 2**n
    drawn = metrics.permutation_test(a, b, ["k"], "accuracy", seed=1, resamples=500).first()
    assert drawn.p <= 0.03 and drawn.p * 501 / 2 == pytest.approx(round(drawn.p * 501 / 2))
    with pytest.raises(ValueError):
        metrics.permutation_test(a, b, ["k"], "accuracy", seed=1, method="some")


def test_all_pairs_of_systems(spark):
    rows = [(s, r, k, 1, int(k % (i + 2) > 0)) for i, s in enumerate("xyz") for r in (1, 2) for k in range(12)]
    preds = spark.createDataFrame(rows, "system string, run int, k int, label int, pred int")
    got = metrics.compare_systems(preds, "system", "run", ["k"], "accuracy", 5, run_pairs=3, resamples=50).collect()
    assert len(got) == 9 and {(r.system_a, r.system_b) for r in got} == {("x", "y"), ("x", "z"), ("y", "z")}
    assert all(r.p_corrected == pytest.approx(min(1.0, 6 * r.p)) for r in got)


def test_negatives_of_an_entity_that_holds_everything(spark):
    facts = spark.createDataFrame([("e", "A", "why"), ("e", "B", "so"), ("f", "A", "as")], "e string, t string, x string")
    relation = spark.createDataFrame([("A", "Z")], "t string, antonym string")
    got = sampling.inject_negatives(facts, ["e", "t"], "e", "t", relation, 3, p=0.0).collect()
    assert {(r.e, r.t) for r in got if r.label == 0} == {("e", "Z"), ("f", "B")}
    vocab = spark.createDataFrame([(c,) for c in "ABQ"], "t string")
    got = sampling.inject_negatives(facts, ["e", "t"], "e", "t", relation, 3, p=0.0, vocab=vocab, blank=["x"]).collect()
    assert {(r.e, r.t) for r in got if r.label == 0} <= {("e", "Q"), ("f", "B"), ("f", "Q")}
    assert {r.x for r in got if r.label == 0} == {None} and {r.x for r in got if r.label} == {"why", "so", "as"}


def test_examples_with_string_keys_and_answers(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 2, f"text {i}") for i in range(8)], "k string, label int, t string")
    picks = sampling.few_shot(rows.select("k", "label"), "k", "label", 3, 4)
    shown = prompts.few_shot_prompts(picks, rows, "k", "label", {"$T$": F.col("t")}, "$EXAMPLES$ | $QUERY$", "$HEADER$ $T$ = $LABEL$")
    for r in shown.collect():
        examples, query = r.prompt.split(" | ")
        assert query == f"Query text {r.k[1:]} ="
        for i, line in enumerate(examples.split("\n\n"), 1):
            number = int(line.split()[3])
            assert line == f"Example {i} text {number} = {'yes' if number % 2 else 'no'}" and f"k{number}" != r.k


def test_names_with_signs(spark):
    names = spark.createDataFrame([(0, "O'Brien"), (0, "Jo Hart")], "blk int, n string")
    cast = spark.createDataFrame([(0, "O'Hara"), (0, "Jo Lind")], "blk int, m string")
    got = matching.best_unique_match(names, cast, "blk", "n", "m").collect()
    assert [(r.n, r.m) for r in got] == [("Jo Hart", "Jo Lind")]


def test_token_threshold(spark):
    a = spark.createDataFrame([(0, "ann mary lee"), (0, "bob")], "blk int, l string")
    b = spark.createDataFrame([(0, "ann lee"), (0, "ann mary leigh"), (0, "rob")], "blk int, r string")
    strict = matching.fuzzy_pairs(a, b, "blk", "l", "r").collect()
    loose = matching.fuzzy_pairs(a, b, "blk", "l", "r", min_tok=0.7).collect()
    assert [(r.l, r.r, r.tok) for r in strict] == [("ann mary lee", "ann lee", 1.0)]
    assert {(r.l, r.r) for r in loose} == {("ann mary lee", "ann lee"), ("ann mary lee", "ann mary leigh")}


def test_long_common_subsequences(spark):
    import random

    rnd = random.Random(6)
    pairs = [("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 200))), "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90))))
             for _ in range(12)] + [("", "a"), ("a" * 60, "a" * 61), ("ab" * 60, "ba" * 60)]

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = row
            row = [0]
            for j, e in enumerate(y):
                row.append(last[j] + 1 if c == e else max(last[j + 1], row[-1]))
        return row[-1]

    df = spark.createDataFrame([(x, y) for x, y in pairs], "x string, y string").coalesce(1)
    assert [r[0] for r in df.select(matching.lcs_length(F.col("x"), F.col("y"))).collect()] == [plain(x, y) for x, y in pairs]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "dev"), (2, "b", "test"), (3, "c", "test")], "k int, t string, p string")
    assert {tuple(r) for r in filters.not_one_to_one(df, "k", "t").collect()} == {("k", "2"), ("t", "a")}
    assert [r.t for r in filters.leaks(df, "t", "p", ["train", "dev"]).collect()] == ["a"]


def test_components_keep_lone_nodes_and_drop_their_tables(spark):
    import os

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (90, 91)], "a int, b int")
    roots = {r.node: r.root for r in graph.components(edges, "a", "b").collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 90: 90, 91: 90}
    table = session.cut(edges)
    path = table._scratch
    session.discard(table)
    assert not os.path.exists(path.removeprefix("file:"))


def test_five_way_samples_keep_weight_and_partition(spark):
    facts = spark.createDataFrame([(e, t, e * 0.5, "dev") for e in range(4) for t in "AB"] + [(9, c, 1.0, "train") for c in "CDEFGH"],
                                  "e int, t string, weight double, partition string")
    relation = spark.createDataFrame([("A", "C")], "t string, antonym string")
    got = sampling.multiclass_samples(facts, "e", "t", relation, 2, keep=["weight", "partition"]).collect()
    assert len(got) == 14 and all((r.weight, r.partition) == ((r.e * 0.5, "dev") if r.e < 9 else (1.0, "train")) for r in got)
    assert all(r.options[r.label - 1] == r.t for r in got)


def test_weighted_draws_follow_the_frequencies(spark):
    """First draws of many entities: odds by frequency among what is neither held nor an antonym."""
    import collections

    # A is held by all, B is the antonym; C, D, E are free with frequencies 300, 200 and 100
    rows = [(e, "A") for e in range(3000)] + [(10_000 + i, t) for t, n in (("B", 50), ("C", 300), ("D", 200), ("E", 100)) for i in range(n)]
    facts = spark.createDataFrame(rows + [(None, "A"), (5, None)], "e int, t string")
    relation = spark.createDataFrame([("A", "B")], "t string, antonym string")
    got = sampling.multiclass_samples(facts, "e", "t", relation, 7, options=3).filter("e < 3000").collect()
    others = collections.Counter(o for r in got for o in r.options if o not in "AB")
    assert len(got) == 3000 and all(len(r.options) == 3 and {"A", "B"} <= set(r.options) for r in got)
    assert all(abs(others[t] / 3000 - share) < 0.04 for t, share in (("C", 1 / 2), ("D", 1 / 3), ("E", 1 / 6)))


def test_best_split_of_little(spark):
    members = spark.createDataFrame([(f"c{i}", "x") for i in range(6)] + [(None, "x")], "c string, t string")
    got = sampling.best_split(members, "c", "t", 0.5, 0.25, 3, 4, 1).collect()
    assert sorted(r.partition for r in got) == ["dev", "test", "test", "train", "train", "train"]
    assert {r.partition for r in sampling.best_split(members, "c", "t", 1.0, 0.0, 3, 4, 1).collect()} == {"train"}
    assert sampling.best_split(members.limit(0), "c", "t", 0.5, 0.25, 3, 4, 1).collect() == []


def test_breaker_over_batches(spark, tmp_path):
    """A run that goes on over batches, one that a success breaks, and a source that trips only once."""
    from docattr.streaming import ingest

    schema = "s string, o int, bad boolean"
    batches = [[("a", 1, True), ("a", 2, True), ("b", 1, True), ("c", 1, True), ("c", 2, True), ("c", 3, True)],
               [("b", 2, False), ("b", 3, True), ("c", 4, True)], [("a", 5, True), ("b", 6, True), ("b", 7, True), ("c", 8, True)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
        ingest.breaker_stream(stream, "s", "o", F.col("bad"), 3, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.s, r.tripped_at) for r in got} == {("a", 5), ("b", 7), ("c", 3)} and len(got) == 3


def test_a_document_of_very_many_lines(spark):
    n, minimum = 250_000, 97
    sizes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 1000 * 7919 % 41)
    df = spark.range(1).select(ordered.offsets(sizes).alias("o"), ordered.pack_min(sizes, minimum).alias("g"))
    got = df.first()
    at, group, running = 0, -1, 0
    starts, groups = [], []
    for i in range(n):
        size = i % 1000 * 7919 % 41
        starts.append(at)
        at += size + 1
        if group >= 0 and running + size < minimum:
            running += size
        else:
            group, running = group + 1, size
        groups.append(group)
    assert got.o == starts and got.g == groups


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 512, 513])
def test_pieces_of_a_fold(spark, n):
    df = spark.createDataFrame([([1] * n,), (None,)], "s array<int>")
    got = df.select(ordered.offsets(F.col("s"), 0).alias("o"), ordered.pack_min(F.col("s"), 4).alias("g")).collect()
    assert got[0].o == list(range(n)) and got[0].g == [i // 3 for i in range(n)]
    assert got[1].o is None and got[1].g is None


def test_bucketed_append_leaves_stored_rows_in_place(spark, tmp_path):
    name = "bucketed_append_test"
    readers.bucketed_table(spark, name, "a string, k bigint", str(tmp_path / "t"), ["k"], 8)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("a"))
    readers.append_bucketed(rows, name, ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        more = spark.range(2000).select(F.lit("y").alias("a"), (F.col("id") % 1000 + 500).alias("k"))
        plan = readers.fresh_rows(more, name, ["k"])._jdf.queryExecution().executedPlan().toString()
        readers.append_bucketed(more, name, ["k"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    found = {r.a: r.n for r in spark.table(name).groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark.sql(f"DROP TABLE {name}")
    assert found == {"x": 1000, "y": 500}


def test_keys_in_the_state_store_survive_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in ([1, 2, 2, None], [2, 3, None], [1, 3, 4]):
        spark.createDataFrame([(k,) for k in part], "k int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int").parquet(source)
        ingest.distinct_stream(stream, ["k"], sink, state).awaitTermination()
    assert sorted((r.k for r in spark.read.parquet(sink).collect()), key=str) == [1, 2, 3, 4, None]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept


def test_a_chain_of_dominated_pairs(spark, monkeypatch):
    """Every pair of the chain but the first is dominated by the one before, so rounds of best pairs take one each."""
    n = 1000
    chain = [("c", f"l{i // 2:04}" if i % 2 == 0 else f"l{i // 2 + 1:04}", f"r{i // 2:04}", float(n - i)) for i in range(n)]
    others = [(f"b{i % 7}", f"l{i % 11}", f"r{i * i % 13}", float(i * 37 % 101)) for i in range(200)]
    tables = []
    for module in (matching, graph):
        monkeypatch.setattr(module, "cut", lambda df, name=module.__name__: tables.append(name) or session.cut(df))
    rows = [*chain, *others, ("c", None, "r0000", 2000.0), ("c", "l0000", None, 2000.0)]
    pairs = spark.createDataFrame(rows, "blk string, a string, b string, s double")
    got = matching.greedy_matching(pairs, "blk", "a", "b", ["s"])
    used, want = set(), set()
    for blk, a, b, s in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (-r[3], r[1], r[2])):
        if (blk, "a", a) not in used and (blk, "b", b) not in used:
            used |= {(blk, "a", a), (blk, "b", b)}
            want.add((blk, a, b))
    assert {(r.blk, r.a, r.b) for r in got.collect()} == want
    # two rounds of best pairs, then the groups: rounds that write a table each
    assert tables.count(graph.__name__) <= 12 and tables.count(matching.__name__) <= 12
    # groups beyond the bound go on in rounds and give the same pairs
    few = pairs.filter("blk <> 'c'")
    split = matching.greedy_matching(few, "blk", "a", "b", ["s"], rounds=1, group_pairs=3)
    assert {(r.blk, r.a, r.b) for r in split.collect()} == {w for w in want if w[0] != "c"}


@pytest.mark.parametrize("ahead", [1, 3, 16])
def test_cover_looks_ahead(spark, ahead):
    rows = [(i % 60, i * i * 31 % 997 % 400) for i in range(2400)] + [(i % 5 + 100, 500 + i) for i in range(40)] + [(7, None), (None, 3)]
    got = graph.greedy_cover(spark.createDataFrame(rows, "d int, s int"), "d", "s", ahead).orderBy("step").collect()
    held = {}
    for d, s in rows:
        if d is not None and s is not None:
            held.setdefault(d, set()).add(s)
    todo, want = set().union(*held.values()), []
    while todo:
        d = min(held, key=lambda x: (-len(held[x] & todo), x))
        want.append((d, len(held[d] & todo)))
        todo -= held[d]
    assert [(r.d, r.gain) for r in got] == want


@pytest.mark.parametrize("ahead, pairs", [(3, 60), (16, 700), (16, 4_000_000)])
def test_cover_takes_few_rounds(spark, ahead, pairs, monkeypatch):
    """Hundreds of choices one after the other took a round for a handful of them (F1)."""
    rows = [(f"d{i % 90:02}", i * i * 31 % 997 % 400) for i in range(2400)] + [(f"e{i}", 1000 + i * 9 + k) for i in range(40) for k in range(9)]
    rounds = []
    monkeypatch.setattr(graph, "discard", lambda *tables: rounds.append(1))
    got = graph.greedy_cover(spark.createDataFrame(rows, "d string, s int"), "d", "s", ahead, pairs).orderBy("step").collect()
    held = {}
    for d, s in rows:
        held.setdefault(d, set()).add(s)
    todo, want = set().union(*held.values()), []
    while todo:
        d = min(held, key=lambda x: (-len(held[x] & todo), x))
        want.append((d, len(held[d] & todo)))
        todo -= held[d]
    assert [(r.d, r.gain, r.step) for r in got] == [(*w, i) for i, w in enumerate(want, 1)]
    assert got[-1].coverage == 100
    if pairs > 1000:
        assert not rounds


def test_five_way_samples_in_rows_and_in_ranges(spark, monkeypatch):
    """Each round ordered all rows and cuts anew; entities that hold little draw in their rows, with the same draws (F3)."""
    rows = [(i % 37, f"t{i * 7 % 53:02}") for i in range(300)] + [(40, f"t{i:02}") for i in range(50)] + [(41, None), (None, "t01"), (42, "t03")]
    facts = spark.createDataFrame(rows, "e int, t string")
    relation = spark.createDataFrame([(f"t{i:02}", f"t{(i + k) % 60:02}") for i in range(53) for k in (0, 1, 1, 9, 21)] + [(None, "t01"), ("t02", None)],
                                     "t string, antonym string")
    ranged, ordered = sampling._draws_in_ranges, []
    monkeypatch.setattr(sampling, "_draws_in_ranges", lambda held, *a: (ordered.append(held.count()), ranged(held, *a))[1])
    got = {}
    for limit in (0, 20, 256):
        monkeypatch.setattr(sampling, "IN_ROW", limit)
        got[limit] = sorted(map(tuple, sampling.multiclass_samples(facts, "e", "t", relation, 7).collect()))
    n = len({r for r in rows if None not in r})
    assert len(got[0]) == n and got[0] == got[20] == got[256]
    assert ordered == [n, 50]


def test_negatives_in_rows_and_in_ranges(spark, monkeypatch):
    """Facts were shuffled a dozen times; those of an entity are gathered once, with the same draws (F5)."""
    rows = [(i % 37, i % 5, f"t{i * 7 % 53:02}", "why") for i in range(400)] + [(40, i % 3, f"t{i:02}", "so") for i in range(53)]
    rows += [(41, 1, None, "so"), (41, None, "t05", "so"), (41, 2, "t05", None), (None, 1, "t01", "so"), (42, 1, "x", "so"), *rows[:9]]
    facts = spark.createDataFrame(rows, "e int, d int, t string, n string")
    relation = spark.createDataFrame([(f"t{i:02}", f"t{(i + k) % 60:02}") for i in range(53) for k in (0, 1, 1, 9)] + [(None, "t01"), ("t02", None)],
                                     "t string, antonym string")
    ranged, spread = sampling._negatives_in_ranges, []
    monkeypatch.setattr(sampling, "_negatives_in_ranges", lambda many, *a: (spread.append(many.count()), ranged(many, *a))[1])
    got = {}
    for limit in (0, 40, 1000):
        monkeypatch.setattr(sampling, "IN_ENTITY", limit)
        out = sampling.inject_negatives(facts, ["e", "d", "t"], "e", "t", relation, 7, blank=["n"])
        got[limit] = sorted(map(str, out.collect()))
    assert spread == [len(rows), 54, 1] and got[0] == got[40] == got[1000]
    assert len(got[0]) > len(set(rows)) + 300
