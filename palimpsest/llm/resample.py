"""Target-distribution importance resampling over hashed n-grams.

Identical texts are collapsed by grouping the full text.  Each distinct text's n-gram buckets are
computed once and kept; its counts enter the corpus histogram times its number of copies.  The
gain of a bucket compares the target's share with the corpus's, a text's weight is the sum of its
gains, and the weights go back to the documents by the text's digest before any document-specific
noise is added.  Gumbel noise on the weight and a cut at the highest scores is sampling without
replacement in proportion to the weights' exponentials.

Plan: scan -> exchange of texts (copies merge in each task first) -> checkpoint of buckets -> one
row per bucket and task -> narrow pass for weights -> join of (doc_id, digest) with weights, where
copies that exceed a partition's share are dealt over cells -> range exchange of 41 bytes a
document -> checkpoint -> ranks from partition totals.  The driver holds two numbers per bucket
and one per partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved, slices, text_or_empty
from .hotjoin import _fans, with_summary

BUCKETS = 10_000
#: Documents of fewer words are scored but never drawn.
LEAST_WORDS = 20
#: Of the documents with enough words, so many per cent (rounded down) are drawn.
PER_CENT = 5
SEED = 42
#: Gains, weights and scores are whole thousandths of a natural logarithm.
SCALE = 1000

#: Bytes outside words (U+0000-2F, 3A-60, 7B-7F after A-Z became a-z) become spaces; bytes from 80 on belong to words.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def ngram_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of every run of 1 to 3 words (repeats counted)."""
    words = text.translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0, np.zeros(0, np.uint32)
    spaced = [b" " + w for w in words]
    one = list(map(crc32, words))
    two = list(map(crc32, spaced[1:], one))  # a checksum goes on where the shorter run's ended
    three = list(map(crc32, spaced[2:], two))
    return len(words), np.array(one + two + three, np.uint32) % np.uint32(buckets)


def collapsed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """digest, n, n_words, grams of each distinct text of docs (text): its copies, its words and the buckets of its n-grams as 16- or 32-bit numbers."""
    wide = "<u2" if buckets <= 1 << 16 else "<u4"

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [ngram_buckets(t, buckets) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([g.astype(wide).tobytes() for _, g in found], pa.binary())], names=["digest", "n", "n_words", "grams"]
            )

    grouped = docs.groupBy(text_or_empty().alias("text")).agg(F.count("*").alias("n"))
    return mapped(grouped.select(F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "n", "text"), grams, "digest binary, n long, n_words long, grams binary")


def _buckets_of(blob: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if buckets <= 1 << 16 else "<u4")


def histogram(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all copies of the collapsed texts: each task sums its own, an exchange sums the tasks'."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += n * np.bincount(_buckets_of(blob, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in mapped(texts.select("n", "grams"), sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row per bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: the logarithm of the target's share over the corpus's, both with one added to every bucket."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log(((t + 1) * (s_all + buckets)) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n, n_words, n_features, weight of the collapsed texts."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams = [_buckets_of(x, len(gain)) for x in batch.column(3).to_pylist()]
            weights = [int(shared.value[g].sum()) for g in grams]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(g) for g in grams], pa.int64()), pa.array(weights, pa.int64())], names=["digest", "n", "n_words", "n_features", "weight"]
            )

    return mapped(texts, weigh, "digest binary, n long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int = SEED):
    """Gumbel noise of a document: a hash of its id as a number in (0, 1), twice through the logarithm."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text).

    rank counts the drawn documents from the highest score, ties to the smaller doc_id; undrawn
    ones have null.  Null and empty texts have no features and weight 0 and are never drawn; a
    null doc_id takes the noise of an empty id and comes first among ties; repeated rows are
    documents of their own; an empty target or an empty table is allowed; other columns are
    ignored.
    """
    texts = saved(collapsed(docs, buckets))
    weights = saved(weighted(texts, gains(histogram(texts, buckets), histogram(collapsed(target, buckets), buckets))))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))
    fans = _fans(docs.sparkSession, weights.select("digest", "n"), "digest")
    back = with_summary(keyed, weights.drop("n"), "digest", fans)
    scored = back.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc()]
    ordered = saved(scored.repartitionByRange(*order).sortWithinPartitions(*order))

    part = F.spark_partition_id()
    before, first = 0, []
    able = 0
    for p, rows, n in sorted(map(tuple, ordered.groupBy(part.alias("part")).agg(F.count("*"), F.sum(F.col("able").cast("long"))).collect())):
        first.append((p, before))
        before, able = before + rows, able + n
    starts = docs.sparkSession.createDataFrame(first, "part int, before long")
    placed = ordered.withColumn("part", part).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rank = F.col("before") + F.col("at") + 1
    return placed.join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= F.lit(per_cent * able // 100)), rank).alias("rank"))
