"""Mentions of many names by one automaton, and the paragraphs and spans built on them, against plain loops."""

import random
import time

from pyspark.sql import functions as F

from docattr.functions.names import Names
from docattr.operators import mentions, spans

SIGNS = [" ", ".", "-", "_", "é", "7", "\U0001f600", "\n", "'"]


def test_the_automaton_finds_what_one_pattern_per_name_finds(spark):
    rnd = random.Random(5)
    names = ["Ann", "Ann Lee", "Lee", "Le", "A", "O'Ann", "é", "Ann-Lee", "7", "\U0001f600"]
    texts = ["".join(rnd.choice([*names, *SIGNS, " ", " "]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    rosters = [rnd.sample(names, rnd.randint(1, 3)) for _ in texts]
    df = spark.createDataFrame(list(zip(range(400), texts, rosters, strict=True)), "i int, t string, aliases array<string>")
    want = df.select("i", mentions.mention_spans(F.col("t"), mentions.mention_pattern(F.col("aliases"))).alias("s")).collect()
    for row in want:
        got = [(s, -e) for s, e, _ in Names([rosters[row["i"]]]).scan(texts[row["i"]])]
        assert got == [(s.start, s.end) for s in row["s"]], (texts[row["i"]], rosters[row["i"]])


def test_rosters_without_names_and_texts_without_words(spark):
    assert Names([]).scan("Ann") == Names([None, [], [None, ""]]).scan("Ann") == Names([["Ann"]]).scan(None) == []
    segs = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, "Ann"), (2, 0, "Ann"), (None, 0, "Ann")], "doc_id long, seg_no int, text string")
    cast = spark.createDataFrame([(1, 10, ["Ann", None, ""]), (1, 11, None), (3, 12, ["Ann"])], "doc_id long, entity int, aliases array<string>")
    assert [tuple(r) for r in mentions.find_mentions(segs, cast).collect()] == [(1, 2, 10, 0, 3, "Ann")]
    assert spans.entity_rows(segs, cast, "doc_id").count() == 1


def test_two_hundred_names_in_a_long_document(spark):
    rnd = random.Random(6)
    names = [f"Name{i} Of{i % 20}" for i in range(200)]
    lines = [" ".join(rnd.choice(names) if rnd.random() < 0.02 else f"word{rnd.randint(0, 5000)}" for _ in range(20)) for _ in range(10000)]
    segs = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, seg_no int, text string")
    cast = spark.createDataFrame([(1, n, [n, n.upper()]) for n in names], "doc_id long, entity string, aliases array<string>")
    begin = time.time()
    got = mentions.find_mentions(segs, cast).count()
    assert got == sum(t.count(n + " ") + t.endswith(n) for t in lines for n in names if n.split()[0] + " " in t)
    assert time.time() - begin < 60
    rows = spans.entity_rows(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), cast, "doc_id")
    held = rows.select(F.sum(F.size("parts")).alias("lines"), F.sum(F.size(F.flatten("parts.spans"))).alias("spans")).first()
    # only lines with a mention are copied
    assert held["spans"] == got and held["lines"] <= got


def plain_paragraphs(text, found, least):
    """Lines packed while the next one stays below ``least`` words, spans by looking at all of them."""
    groups, running = [], 0
    for line in text.split("\n"):
        n = len(line.split())
        if groups and running + n < least:
            groups[-1].append(line)
            running += n
        else:
            groups.append([line])
            running = n
    out, at = [], 0
    for g in groups:
        t = "\n".join(g)
        out.append((t, [(s - at, e - at) for s, e in sorted(found) if s >= at and e <= at + len(t)]))
        at += len(t) + 1
    return out


def test_spans_of_paragraphs_by_one_merge(spark):
    rnd = random.Random(7)
    cases = []
    for i in range(60):
        text = "\n".join(" ".join("w" * rnd.randint(1, 4) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 30)))
        found = []
        for _ in range(rnd.randint(0, 20)):
            s = rnd.randint(0, len(text))
            found.append((s, min(len(text), s + rnd.randint(0, 5))))
        cases.append((i, text, found))
    df = spark.createDataFrame(cases, "i int, t string, s array<struct<start:int,end:int>>")
    for row in df.select("i", spans.split_paragraphs(F.col("t"), F.col("s"), 8).alias("p")).collect():
        _, text, found = cases[row["i"]]
        assert [(p.text, [tuple(s) for s in p.spans]) for p in row["p"]] == plain_paragraphs(text, found, 8)


def test_adjacent_lines_form_paragraphs(spark):
    text = "Ann a\nb Ann\nc\nLee Ann\n\nAnn"
    rows = spans.entity_rows(
        spark.createDataFrame([(1, text)], "doc_id long, text string"),
        spark.createDataFrame([(1, "A", ["Ann"]), (1, "L", ["Lee"])], "doc_id long, entity string, aliases array<string>"), "doc_id")
    got = {r["entity"]: [p["text"] for p in r["paragraphs"]] for r in spans.paragraphs(rows).collect()}
    assert got == {"A": ["Ann a b Ann", "Lee Ann", "Ann"], "L": ["Lee Ann"]}


def test_word_roster_moves_repeated_words_only(spark, tmp_path, monkeypatch):
    """Every word of every text was shuffled, and once per branch that reads the names (F2)."""
    texts = [(1, "anna bob anna clem"), (2, "dora emil"), (2, "dora gina gina"), (3, None), (None, "hans"), (None, "hans iris"),
             (4, "zoe yan zoe yan abe abe abe abe ")]
    moved, real = [], mentions.name_roster
    monkeypatch.setattr(mentions, "name_roster", lambda words, *a: (moved.append(words.count()), real(words, *a))[1])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = F.regexp_extract_all("text", F.lit(r"\w+"), 0)
    got = mentions.word_roster(docs, "doc_id", words, 2)
    assert {tuple(r) for r in got.collect()} == {(1, "anna"), (2, "dora"), (2, "gina"), (None, "hans"), (4, "abe"), (4, "yan")}
    assert moved == [18]
    every = real(docs.select("doc_id", F.explode(words).alias("entity")), "doc_id", "entity", 2)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert mentions.word_roster(docs.filter("doc_id = 4"), "doc_id", words, 1).first().entity == "abe"
    assert mentions.word_roster(docs.filter("doc_id = 1"), "doc_id", words, 9, 1).count() == 3
