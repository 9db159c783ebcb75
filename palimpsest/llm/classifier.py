"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's features are indicators of its n-grams: runs of one and two tokens as written (words and
single symbols, case kept) and runs of one to three token shapes (small, capital, capitalised,
number, the symbol itself, the same word again).  Each indicator is scaled by the logarithm of
the ratio of its shares in the two classes; a linear model with hinge loss is then fitted to the
scaled indicators by dual coordinate descent.  Margins of rows outside the fit (folds) give the
logistic curve that turns a margin into a probability.

Bounded: at most ``max_rows`` labelled rows, drawn by a hash of their ids, fit the model in one
task, whatever the size of the corpus; scores are computed for every row.  Plan: labels -> sample
(broadcast, at most max_rows ids) -> join with the scan -> features -> one task -> one number per
bucket, broadcast -> scan, map.  No exchange of texts but of the sample's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved, slices, text_or_empty
from .hashing import mix, sorted_distinct

#: The most labelled rows that a model is fitted to.
MAX_ROWS = 8000
BUCKETS = 1 << 18
#: Added to the counts of an indicator in each class.
SMOOTH = 1.0
#: Weight of a row's hinge loss against the norm, passes over the rows, folds for the curve.
COST, PASSES, FOLDS = 0.05, 12, 5
#: Rows with crc32(doc_id) modulo HELD_OUT 0 are never learnt from.
HELD_OUT = 5
PREDICT = 0.3
#: Bits of a feature's hash that hold its kind.
_TOKENS, _SHAPES = np.uint64(1), np.uint64(2)

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Distinct buckets of a text's n-grams, ascending."""
    tokens = _TOKEN.findall(text)
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint32)
    held = "\0".join(tokens).encode().split(b"\0")
    if len(held) != n:  # the text holds the separator
        held = [t.encode() for t in tokens]
    one = list(map(crc32, held))
    names = np.array(one, np.uint64)
    lower, upper, letters = (np.fromiter(map(f, tokens), bool, n) for f in (str.islower, str.isupper, str.isalpha))
    long = np.fromiter(map(len, tokens), np.int64, n) > 1
    number = np.fromiter(map(str.isnumeric, tokens), bool, n)
    shape = np.select([lower, upper & long, letters, number], [np.uint64(1), np.uint64(2), np.uint64(3), np.uint64(4)], names + np.uint64(16))
    again = np.append(False, (names[1:] == names[:-1]) & letters[1:])
    shape = np.where(again, np.uint64(5), shape)
    step = np.uint64(0x9E3779B97F4A7C15)
    pairs = shape[:-1] * step + shape[1:]
    triples = (pairs[:-1] * step + shape[2:]) if n > 2 else pairs[:0]
    words = (np.concatenate([names, names[:-1] * step + names[1:]]) << np.uint64(2)) | _TOKENS
    shapes = (np.concatenate([shape, pairs * np.uint64(3), triples * np.uint64(5)]) << np.uint64(2)) | _SHAPES
    return sorted_distinct((mix(np.concatenate([words, shapes])) % np.uint64(buckets)).astype(np.uint32))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, smooth: float = SMOOTH) -> np.ndarray:
    """Logarithm of the ratio of each indicator's share among the rows of class 1 to that among the rows of class 0."""
    count = {c: np.full(buckets, smooth) for c in (True, False)}
    for x, label in zip(rows, y.tolist(), strict=True):
        count[bool(label)][x] += 1
    return np.log(count[True] / count[True].sum()) - np.log(count[False] / count[False].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of the indicators (ratios included) and the offset of the hinge-loss model, by dual coordinate descent.

    The rarer class's losses weigh more, so that both classes weigh alike.  A row's vector is
    scaled to length one; the offset is one more feature of every row.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([max(1, (y <= 0).sum()), max(1, (y > 0).sum())])
    most = cost * len(y) / (2 * share[(y > 0).astype(int)])
    values = [ratio[x] for x in rows]
    norms = np.array([max(1e-12, float(np.sqrt(v @ v))) for v in values])
    w, offset, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    rnd = np.random.default_rng(seed)
    for _ in range(passes):
        for k in rnd.permutation(len(y)):
            x, v = rows[k], values[k]
            gradient = sign[k] * ((w[x] @ v) / norms[k] + offset) - 1
            now = min(max(alpha[k] - gradient / 2, 0.0), most[k])  # the vector and the offset have length one each
            if now != alpha[k]:
                step = (now - alpha[k]) * sign[k]
                w[x] += step * v / norms[k]
                offset += step
                alpha[k] = now
    return w * ratio, offset


def margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray, offset: float) -> np.ndarray:
    return np.array([weight[x].sum() / max(1e-12, float(np.sqrt(ratio[x] @ ratio[x]))) + offset for x in rows])


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the curve 1 / (1 + exp(-(a m + b))) with the least log loss, a above 0, by Newton steps on smoothed labels."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fitted(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS) -> dict:
    """The model of labelled rows: ratio and weight of each bucket, offset and curve.  With one class or none, every score is its share, smoothed."""
    if len(set((y > 0).tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return {"ratio": np.zeros(buckets), "weight": np.zeros(buckets), "offset": 0.0, "a": 1.0, "b": float(np.log(share / (1 - share)))}

    def model(take: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [rows[k] for k in take]
        ratio = log_ratios(own, y[take], buckets)
        return ratio, *dual_descent(own, y[take], ratio)

    fold = np.arange(len(y)) % FOLDS
    outside = np.zeros(len(y))
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(own) and len(set((y[rest] > 0).tolist())) == 2:
            ratio, weight, offset = model(rest)
            outside[own] = margins([rows[k] for k in own], ratio, weight, offset)
    ratio, weight, offset = model(np.arange(len(y)))
    a, b = logistic(outside, y)
    return {"ratio": ratio, "weight": weight, "offset": offset, "a": a, "b": b}


def held_out(doc_id):
    """Whether crc32 of the id's digits is 0 modulo HELD_OUT; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, y, text of at most max_rows labelled documents that are not held out.

    An id whose labels contradict each other is left out; of rows that share a doc_id the one
    whose text has the least digest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("most")).where("y = most").select("doc_id", F.col("y").cast("int").alias("y"))
    n = known.count()
    if n > max_rows:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        known = known.where(place < int(0.97 * max_rows / n * (1 << 30)))
    drawn = saved(known.limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min_by("text", F.sha2(F.col("text"), 256)).alias("text"))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> dict:
    """The model of a label: features where the texts are, the fit in one task over max_rows rows at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t, buckets).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "grams"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((d, y, g) for b in batches for d, y, g in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = fitted([np.frombuffer(g, "<u4") for _, _, g in held], np.array([y for _, y, _ in held], np.int64), buckets)
        numbers = [model[k] for k in ("offset", "a", "b")]
        yield pa.RecordBatch.from_pydict({"ratio": [model["ratio"].astype("<f4").tobytes()], "weight": [model["weight"].astype("<f4").tobytes()], "numbers": [np.array(numbers, "<f8").tobytes()]})

    cut_rows = mapped(training_rows(docs, labels, label, max_rows), cut, "doc_id long, y int, grams binary")
    ratio, weight, numbers = (bytes(x) for x in mapped(cut_rows.repartition(1), fit, "ratio binary, weight binary, numbers binary").first())
    offset, a, b = np.frombuffer(numbers, "<f8").tolist()
    return {"ratio": np.frombuffer(ratio, "<f4"), "weight": np.frombuffer(weight, "<f4"), "offset": offset, "a": a, "b": b}


def scored(docs: DataFrame, model: dict, threshold: float = PREDICT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    The score is the probability of label 1.  Null and empty texts have no features and get the
    score of the model's offset alone; a null doc_id stays null; repeated rows are scored each for
    itself; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            rows = [features(t, len(m["weight"])) for t in batch.column(2).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(m["a"] * margins(rows, m["ratio"], m["weight"], m["offset"]) + m["b"], -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return mapped(asked, score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, threshold: float = PREDICT) -> DataFrame:
    """``scored`` by the model that the labels of docs give; without labels every score is one half, with one class its smoothed share."""
    return scored(docs, learned(docs, labels, label, max_rows), threshold)
