"""What the pipeline's stages share: columns of any name come through, and near copies are found."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docattr.llm import mixing, near, pii, simhash, toxicity

#: Working names of the operators and of their helpers.
WORKING = [
    "_key", "_a", "_b", "_taken", "_size", "_cut", "_cuts", "_h", "_hi", "_words", "_finish", "_end", "_part", "k1", "k2", "row", "cut", "taken",
    "size", "rest", "fp", "root", "found", "base", "terms", "kind", "value", "term", "severity", "grade", "toxic", "label", "words", "rank", "target",
    "epoch", "position", "source_size", "s1", "s2", "n", "bands", "x1", "text_", "score", "levels", "component_id", "a.b"]


def test_columns_of_any_name_come_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in WORKING})
    model = toxicity.fit(docs, labels)
    stages = {
        "accepted": lambda d: toxicity.accepted(d, model), "representatives": simhash.representatives, "near": near.representatives,
        "redact": pii.redact, "mix": mixing.mix}
    for name, stage in stages.items():
        got = stage(wide)
        assert got.columns == wide.columns, name
        bad = [F.col(f"`{n}`") != F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in WORKING]
        rows = got.select("doc_id", "text", F.array(*bad).alias("bad")).collect()
        assert not any(any(r["bad"]) for r in rows), name
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in stage(docs).collect()), name


def similar_pairs(texts):
    """All pairs of distinct shingle sets of a similarity of 0.8 or more, by an index on the first fifth of each sorted set."""
    sets = sorted({tuple(near.shingles(t).tolist()) for t in texts} - {()}, key=len)
    held, pairs = {}, []
    for i, s in enumerate(sets):
        first = s[:len(s) - -(-4 * len(s) // 5) + 1]
        met = {j for h in first for j in held.get(h, ())}
        mine = set(s)
        for j in met:
            common = len(mine.intersection(sets[j]))
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common):
                pairs.append((sets[j], s))
        for h in first:
            held.setdefault(h, []).append(i)
    return pairs


def test_recall_of_near_copies(spark, sf_dir):
    large = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    docs = spark.read.parquet(f"{large if os.path.isdir(large) else sf_dir}/documents.parquet").select("doc_id", "text")
    found = near.classes(docs).join(docs, "doc_id").select("text", "root").collect()
    root = {tuple(near.shingles(r["text"]).tolist()): r["root"] for r in found}
    pairs = similar_pairs([r["text"] for r in found])
    together = sum(root[a] == root[b] for a, b in pairs)
    print(f"near copies at 0.8: {together} of {len(pairs)} pairs in one class")
    assert together >= 0.9 * len(pairs)


def test_similar_texts_of_large_bands_are_linked_whoever_the_heads_are(spark):
    """90 families of two: all share 92 words, so bands hold many families; the two of one are similar at 0.82, others at 0.79."""
    def text(i, j):
        return " ".join([f"common{k}" for k in range(92)] + [f"of{i}x{k}" for k in range(2)] + [f"at{i}x{j}x{k}" for k in range(10)])

    rows = [(2 * i + j, text(i, j)) for i in range(90) for j in (0, 1)]
    pairs = similar_pairs([t for _, t in rows])
    assert len(pairs) == 90
    found = near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root = {r["doc_id"]: r["root"] for r in found}
    assert [i for i in range(90) if root[2 * i] != root[2 * i + 1]] == []


def test_the_rest_of_a_band_is_paired_once_between_groups(spark):
    sets = spark.createDataFrame([(i, -i, 100 if i else 10, i // 4, [7]) for i in range(12)], "s1 long, s2 long, n long, root long, bands array<long>")
    each = near.in_bands(sets)
    first = near.candidates(each)
    got = sorted(map(tuple, first.unionByName(near.rest(each, first)).collect()))
    # the first is too small for the others
    assert got == [(a, -a, b, -b) for a in range(1, 12) for b in range(a + 1, 12) if a // 4 != b // 4]


def edited(n: int, edits: tuple[int, int], words: int | None, seed: int, length: int = 60) -> list[tuple[int, str]]:
    """Copies of one text with some words replaced, by one of ``words`` or else by words of their own."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = [f"w{k}" for k in range(length)]
        for j, at in enumerate(draw.sample(range(length), draw.randint(*edits))):
            text[at] = f"e{draw.randrange(words)}" if words else f"e{i}x{j}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("edits", "words"), [((1, 4), 3), ((2, 5), 1), ((1, 3), None)])
def test_near_copies_of_one_text_are_linked_as_by_all_pairs(spark, edits, words):
    rows = edited(90, edits, words, 5)
    hashes, fps = [near.shingles(t) for _, t in rows], [simhash.simhash(t) for _, t in rows]
    bands = [set(near.bands(h)) for h in hashes]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(hashes[i], hashes[j]))
            similar = 9 * both >= 4 * (len(hashes[i]) + len(hashes[j])) and bands[i] & bands[j]
            if similar or bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    found = near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {(tuple(sorted(r["doc_id"] for r in found if r["root"] == x["root"]))) for x in found}
    assert groups == {tuple(i for i in range(len(rows)) if root[i] == r) for r in root}
    assert 1 < len(groups) < len(rows)


def test_pairs_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    made, verified = [], near.verified

    def counted(*args):
        made.append(args[-1].count())
        return verified(*args)

    monkeypatch.setattr(near, "verified", counted)
    rows = edited(240, (4, 6), None, 3, 100)
    assert near.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("root").distinct().count() > 200
    # all pairs are 28680
    assert sum(made) < 4000, made


def test_words_met_are_bounded_and_stay_in_the_task(monkeypatch):
    import pickle

    model = toxicity.Model({"bad": 2.0, "wors*": 1.0}, (0.5, 1.0), 0.5)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + " bad worst" for i in range(20)]
    want = [model.severity(t) for t in texts]
    assert len(model.met) > 50 and pickle.loads(pickle.dumps(model)).met == {}
    monkeypatch.setattr(toxicity, "WORDS", 50)
    small = pickle.loads(pickle.dumps(model))
    assert [small.severity(t) for t in texts] == want and len(small.met) <= 50


def test_final_pieces_are_those_of_the_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema if stage is not corpus_pipeline.pack_sequences else None)
    want = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in docs.collect())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
