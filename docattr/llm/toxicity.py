"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity grades 0 < 1 < ... < K are predicted with one weight vector w and K ordered thresholds:
P(grade > j) = sigmoid(w x - t_j). The expected severity is the sum of these probabilities over j, so a
score between two grades says how far a document is from either.

Features are counts, as log(1 + n), of words (lower case, letters only at both ends) and of the first
``STEMS`` letters of longer words, which stand for inflected forms. The model is fitted on a bounded sample of
the labelled rows (``FIT_ROWS`` of each class, drawn by a hash of the id) and on the ``FEATURES`` features whose
document frequencies differ most between the classes; a part of the sample is held out to set
the limit above which a document is rejected. Scoring reads every whole text where it lies;
only the model, bounded by ``FEATURES``, is sent to the tasks.

Labels say toxic or not. Toxic rows are graded by how dense their characteristic words are: above the
median of the toxic sample is the higher grade. That makes ``GRADES`` ordered levels of labelled data.

Defined cases: a null or blank text has no features and severity near the prior, which is not
rejected; null ids and repeated rows are scored like others; labels that are null are ignored, an id
with several labels counts as toxic if one is; without rows of both classes every severity is 0;
an empty table gives an empty result; other columns are kept by ``accepted`` and ignored by ``score``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 3000
FEATURES = 2048
STEMS = (4, 5, 6, 7, 8)
GRADES = 2
HELD_OUT = 4
WORDS = 50_000
MIN_DOCS = 3
MIN_GAP = 2.5
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def word_features(word: str) -> list[str]:
    """The word and its stems."""
    word = EDGES.sub("", word).lower()
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]] if word else []


def features(text: str | None) -> Counter:
    """Counts of the words and of the stems of longer words."""
    found: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        for feature in word_features(word):
            found[feature] += n
    return found


@dataclass(frozen=True, eq=False)
class Model:
    """Shared weights, ordered thresholds, and the expected severity above which a document is rejected."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    limit: float
    #: Known features of words met, at most ``WORDS``; goes with the model when its task ends and is not sent.
    met: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"met": {}}

    def known(self, word: str) -> tuple[str, ...]:
        found = self.met.get(word)
        if found is None:
            if len(self.met) >= WORDS:
                self.met.clear()
            found = self.met[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def severity(self, text: str | None) -> float:
        if not self.thresholds:
            return 0.0
        known: Counter = Counter()
        for word, n in Counter((text or "").split()).items():
            for feature in self.known(word):
                known[feature] += n
        z = sum(self.weights[f] * math.log1p(n) for f, n in sorted(known.items()))
        return float(sum(1 / (1 + math.exp(min(700.0, t - z))) for t in self.thresholds))


NOTHING = Model({}, (), math.inf)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, text): at most ``rows`` labelled documents of each class."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit(3), "doc_id")
    picked = [known.filter(c).orderBy(draw).limit(rows) for c in ("toxic > 0", "toxic <= 0")]
    chosen = picked[0].unionByName(picked[1])
    # at most 2 x ``rows`` ids: bounded, so broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("text").alias("text"))


def _counts(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, feature, n) of the sample."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("feature", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = features(text)
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * size, pa.int64()), pa.array([toxic] * size, pa.int64()),
                     pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    typed = sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"), "text")
    return typed.mapInArrow(run, "doc_id long, toxic long, feature string, n long")


def _fit_ordinal(x: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, width: int, levels: int,
                 steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood of the cumulative links, by Adam."""
    row = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    col = np.concatenate([i for i, _ in x]) if len(row) else np.zeros(0, np.int64)
    val = np.concatenate([v for _, v in x]) if len(row) else np.zeros(0)
    above = grades[:, None] > np.arange(levels)[None, :]
    balance = np.where(above[:, 0], 0.5 / max(1, above[:, 0].sum()), 0.5 / max(1, (~above[:, 0]).sum()))
    # thresholds are the first one plus positive gaps, which keeps them in order
    p = np.zeros(width + levels)
    p[width] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[width + 1:])
        t = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, val * p[col], len(x))
        off = (1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30))) - above) * balance[:, None]
        g = np.zeros_like(p)
        g[:width] = np.bincount(col, val * off.sum(axis=1)[row], width) + ridge * p[:width]
        per = -off.sum(axis=0)
        g[width] = per.sum()
        g[width + 1:] = gaps * np.cumsum(per[::-1])[::-1][1:]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(p[width + 1:])
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, width: int = FEATURES) -> Model:
    """Fit on the bounded sample; what reaches the driver is at most 2 x ``rows`` times ``width`` counts."""
    sample = labelled_sample(docs, labels, rows).withColumn(
        "held", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(HELD_OUT)) == 0)
    keyed = sample.select("doc_id", (F.col("toxic") > 0).cast("long").alias("toxic"), "held", "text").persist()
    counts = _counts(keyed.select("doc_id", "toxic", "text")).persist()
    try:
        ids = keyed.select("doc_id", "toxic", "held").toPandas()
        train = ids[~ids.held]
        bad, good = int((train.toxic == 1).sum()), int((train.toxic == 0).sum())
        if not bad or not good:
            return NOTHING
        one = F.col("toxic") == 1
        seen = counts.join(F.broadcast(keyed.filter("NOT held").select("doc_id")), "doc_id").groupBy("feature").agg(
            F.count(F.when(one, 1)).alias("bad"), F.count(F.when(~one, 1)).alias("good"))
        p, q = F.col("bad") / bad, F.col("good") / good
        pooled = (F.col("bad") + F.col("good")) / (bad + good)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / good))
        gap = F.when(spread > 0, (p - q) / spread).otherwise(0.0)
        ranked = seen.filter(F.col("bad") + F.col("good") >= MIN_DOCS).select("feature", gap.alias("gap"))
        ranked = ranked.filter(F.abs("gap") >= MIN_GAP)
        top = ranked.orderBy(F.abs("gap").desc(), "feature").limit(width).toPandas()
        names = top.feature.tolist()
        place = {f: i for i, f in enumerate(names)}
        strong = set(top.feature[top.gap > 0])
        # an Arrow table goes to the JVM as it is; rows or pandas may take Python workers of their own on the executors
        chosen = docs.sparkSession.createDataFrame(pa.table({"feature": pa.array(names, pa.string())}))
        kept = counts.join(F.broadcast(chosen), "feature") if names else None
        table = kept.select("doc_id", "feature", "n").toPandas() if names else None
    finally:
        counts.unpersist()
        keyed.unpersist()
    if not names:
        return NOTHING
    vectors = {i: ([], []) for i in ids.doc_id}
    dense = dict.fromkeys(ids.doc_id, 0)
    for key, feature, n in table.sort_values(["doc_id", "feature"]).itertuples(index=False):
        vectors[key][0].append(place[feature])
        vectors[key][1].append(math.log1p(n))
        dense[key] += n * (feature in strong)
    ids = ids.sort_values("doc_id", ignore_index=True)
    x = [(np.array(vectors[i][0], np.int64), np.array(vectors[i][1])) for i in ids.doc_id]
    density = np.array([dense[i] for i in ids.doc_id], float)
    toxic, held = ids.toxic.to_numpy() == 1, ids.held.to_numpy()
    middle = np.median(density[toxic & ~held])
    grades = np.where(toxic, 1 + (density > middle), 0)
    use = np.flatnonzero(~held)
    weights, thresholds = _fit_ordinal([x[i] for i in use], grades[use], len(names), GRADES)
    model = Model(dict(zip(names, weights.tolist(), strict=True)), tuple(thresholds.tolist()), 0.5)
    check = np.flatnonzero(held) if (toxic & held).any() and (~toxic & held).any() else use
    scores = np.array([sum(1 / (1 + np.exp(np.clip(t - (x[i][1] * weights[x[i][0]]).sum(), -700, 700))) for t in thresholds)
                       for i in check])
    return Model(model.weights, model.thresholds, _limit(scores, toxic[check]))


def _limit(scores: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap below which the held-out F1 score is best."""
    best, limit = -1.0, math.inf
    values = np.unique(scores)
    for low, high in zip(np.concatenate([[-1.0], values[:-1]]), values, strict=True):
        hit = scores >= high
        right = int((hit & toxic).sum())
        f1 = 2 * right / max(1, int(hit.sum()) + int(toxic.sum()))
        if f1 > best:
            best, limit = f1, float((low + high) / 2)
    return limit


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every row; ``grade`` is the expectation rounded to the next grade, ``toxic`` whether it is above the fitted limit."""
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.severity(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_severity double")
    return scored.withColumn("grade", F.round("expected_severity").cast("int")).withColumn(
        "toxic", F.col("expected_severity") > F.lit(model.limit))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected.

    Rows go to the workers a hundred at a time, so what a task holds does not grow with the
    length of the texts as an Arrow batch of 10,000 rows would.
    """
    return docs.filter(F.udf(lambda text: model.severity(text) <= model.limit, "boolean", useArrow=False)("text"))
