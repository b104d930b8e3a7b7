"""Hard negatives, Merkle manifest and line dedup against plain loops, and the edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docattr.llm import lines, merkle, negatives

# --- hard negatives -----------------------------------------------------------------------


def plain_negatives(rows):
    seen, ok = set(), []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e))
        if row not in seen:
            seen.add(row)
            ok.append(row)
    out = []
    for a in ok:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in ok if b is not a and len(b[2]) == len(a[2]))
        for s, i, label in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], i, n, x[1], -s, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, d, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((12, d))
    v = centres[rnd.integers(0, 12, n)] + rnd.standard_normal((n, d)) * 0.6
    return [(i, v[i].tolist(), int(rnd.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("d", [3, 64, 70])
def test_hard_negatives(spark, monkeypatch, d):
    monkeypatch.setattr(negatives, "CHUNK", 40 * d)  # many tiles
    monkeypatch.setattr(negatives, "ANCHORS", 2 * d)
    rows = vectors(400, d, d)
    same = rows[17][1]
    rows += [(1000 + i, same, i % 10) for i in range(60)] + [rows[5], rows[100]]
    rows += [(2000, [0.0] * d, 3), (2100, None, 3), (2200, [float("nan")] * d, 1), (2300, [None] * d, 1), (2400, [1.0] * d, None),
             (None, [1.0] * d, 2), (2500, [float("inf")] * d, 1), (2600, [1.0] * (d + 1), 4), (2700, [], 4), (2701, [], 4), (2702, [], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in negatives.report(df).collect())
    assert got == plain_negatives(rows)
    assert negatives.report(df.limit(0)).collect() == []


def test_bounds_hold_the_scores_and_prune():
    v = np.array([r[1] for r in vectors(2000, 64, 1)]) * 256 // 1
    v = v.astype(np.int64)
    bounds = negatives.Bounds(*negatives.encode(v), 64)
    q = v[7].astype(np.float64) @ negatives.rotation(64).T
    low, high = bounds.of(q)
    scores = v @ v[7]
    assert ((low <= scores) & (scores <= high)).all()
    assert (high >= np.sort(scores)[-6] * 0.8).mean() < 0.5


def test_scores_beyond_a_long_are_held_at_its_ends():
    v = np.array([[1 << 62, 1 << 62], [-(1 << 62), 0], [1, 2]])
    assert negatives.exact(v, np.array([1 << 62, 1 << 62])).tolist() == [(1 << 63) - 1, -(1 << 63), 3 << 62 if 3 << 62 < 1 << 63 else (1 << 63) - 1]


# --- Merkle manifest ----------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, source, lang, n = row
    fields = (doc_id, source, lang, None if n is None else n + more, text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def levels_above(level):
    out = [level]
    while len(level) > 1:
        level = [digest(*level[i:i + 2]) for i in range(0, len(level), 2)]
        out.append(level)
    return out


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(r)))
        trees[lang] = levels_above([plain_leaf(r) for r in by[lang]])
    top = levels_above([trees[lang][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h, proof = plain_leaf(r, int(hit)), []
            for levels, at in ((trees[lang], i), (top, t)):
                for level in levels[:-1]:
                    if at ^ 1 < len(level):
                        other = level[at ^ 1]
                        proof.append(other)
                        h = digest(other, h) if at % 2 else digest(h, other)
                    else:
                        h = digest(h)
                    at //= 2
            out.append((r[0], plain_leaf(r), trees[lang][-1][0], top[-1][0], digest(*proof), h, h == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize("block", [1, 3, 8])
def test_manifest(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rnd = random.Random(4)
    rows = [(i, "é" * rnd.randint(0, 9), "s", rnd.choice(["de", "en", "en", "en", "zz"]), rnd.randint(0, 99)) for i in range(75)]
    rows += [(500, "x", "s", None, 1), (501, "", None, "one", None), (None, None, None, "en", None), (None, "a", "b", "en", 3), rows[3], rows[3]]
    rows += [(7, "same id", "s", "en", 5), (7, "other text", "s", "en", 5), (9, "long " * 40000, "s", "de", 200000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("pos", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(2)).repartition(4)
    got = sorted((tuple(r) for r in merkle.report(df).collect()), key=str)
    assert got == plain_manifest(rows)
    assert not all(r[-1] for r in got)


def test_manifest_of_little(spark):
    for rows in ([(3, "a", "s", "en", 1)], [(3, "a", "s", None, 1), (4, "b", "s", "en", 1)]):
        df = spark.createDataFrame(rows, DOCS)
        assert sorted((tuple(r) for r in merkle.report(df).collect()), key=str) == plain_manifest(rows)
    assert merkle.report(spark.createDataFrame([], DOCS)).collect() == []


# --- line dedup ---------------------------------------------------------------------------

ASCII = str.maketrans(lines.UPPER, lines.LOWER)


def plain_lines(rows):
    def key(line):
        return line.strip(lines.BLANK).translate(ASCII)

    def order(d):
        return d is None, d or 0

    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in first or order(d) < order(first[k])):
                first[k] = d
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_corpus():
    numbered = "\n".join(f"line number {i}" for i in range(200))
    rows = [
        (1, "Hello world one\nshort\n  HELLO WORLD ONE \n" + numbered), (2, "hello world one\nÄpfel und Birnen\n"),
        (3, "äpfel und Birnen\nÄPFEL UND BIRNEN\nÄpfel und birnen"), (None, "hello world one\nline number 7"),
        (None, "a third text of note"), (5, "a third text of note"), (4, None), (6, ""), (7, "\n"),
        (2, "hello world one\nÄpfel und Birnen\n"), (8, "x\n" + "\n".join(f"line number {i}" if i % 3 else f"other {i} and more" for i in range(300))),
        (9, "\x85wide blank\x85\n wide blank \n\x0bwide blanks\r"), (10, "WIDE BLANKS\ntwo words\nword " + "word " * 30000)]
    return rows + [(100 + i, f"very common line here\nown line {i} of this") for i in range(3000)]


@pytest.mark.parametrize("often", [1, 16, 10 ** 9])
def test_line_dedup(spark, monkeypatch, often):
    monkeypatch.setattr(lines, "FREQUENT", often)  # all keys, some keys, no key on the way of the frequent ones
    rows = line_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_lines(rows)
    got = sorted((tuple(r) for r in lines.report(df).collect()), key=str)
    assert got == sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in want), key=str)
    assert lines.report(df.limit(0)).collect() == []


def test_kept_carries_columns_of_any_name(spark):
    rows = line_corpus()[:13]
    names = ["k1", "k2", "row", "keep", "rest", "n_dropped", "h1", "h2", "pos", "line", "key", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = lines.kept(df)
    assert got.columns == df.columns
    found = got.collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in found if r["doc_id"] is not None) == sorted(
        (d, t) for d, _, _, t in plain_lines(rows) if d is not None)
    assert all(r[n] == n for r in found for n in names)
    assert [r["text"] for r in found if r["doc_id"] == 4] == [None]


def test_ranges_are_met_by_one_shuffle_of_the_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = lines.dropped(lines.hashes(docs))._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Window"):]
    assert "rangepartitioning(h1" in above and "hashpartitioning(h1" not in above
