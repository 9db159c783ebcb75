"""Operators 11, 12 and 13 against brute force, held-out accuracy and the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import classifier, hotjoin, resample

from . import corpus

# --- 12: hot-key equi join ---------------------------------------------------------------------


def _sides(spark, n=600, seed=3):
    """Two tables with a key that holds a third of each, keys of one side only, nulls, doubled rows and clashing names."""
    rnd = random.Random(seed)
    key = lambda: rnd.choice([7, 7, 7, None, *range(20, 26), rnd.randrange(1000)])
    left = [(k, key(), f"l{k}", 1) for k in range(n)]
    right = [(k, key() if k % 3 else 5000 + k, f"r{k}", 2) for k in range(n // 2)]
    left, right = left + left[:40] * 3, right + right[:9] * 2
    return left, right, spark.createDataFrame(left, "id long, k long, name string, may int"), spark.createDataFrame(right, "id long, k long, name string, _row int")


def _full(left, right):
    met_r = set()
    out = []
    for x in left:
        found = [j for j, y in enumerate(right) if x[1] is not None and x[1] == y[1]]
        met_r.update(found)
        out += [(x, right[j]) for j in found] or [(x, None)]
    return out + [(None, y) for j, y in enumerate(right) if j not in met_r]


@pytest.mark.parametrize("words", [64, 1 << 12])  # the small filter lets many false positives through
def test_hot_key_join_gives_the_pairs(spark, words):
    left, right, l, r = _sides(spark)
    full = Counter(_full(left, right))
    for how, keep in (("full", lambda x, y: True), ("left", lambda x, y: x is not None), ("inner", lambda x, y: x is not None and y is not None)):
        got = Counter((tuple(a) if a else None, tuple(b) if b else None) for a, b in hotjoin.hot_key_join(l, r, "k", how, words).collect())
        assert got == Counter({p: n for p, n in full.items() if keep(*p)}), how


@pytest.mark.parametrize("words", [64, 1 << 12])
def test_hot_key_partners_fold_the_same_pairs(spark, words):
    from pyspark.sql import functions as F

    left, right, l, r = _sides(spark, seed=4)
    a, b = hotjoin.hot_key_partners(l, r, "k", {"ids": F.sum("id"), "first": F.min("name")}, {"ids": F.sum("id"), "first": F.min("name")}, words)
    full = _full(left, right)
    for rows, own, of in ((a, left, 0), (b, right, 1)):
        want = Counter()
        for x in own:
            met = [p[1 - of] for p in full if p[of] == x and p[1 - of] is not None]
            copies = sum(y == x for y in own)
            met = sorted(met)[::copies]  # the pairs of all copies of x were gathered
            want[(*x, len(met), sum(p[0] for p in met) if met else None, min(p[2] for p in met) if met else None)] += 1
        assert Counter(map(tuple, rows.collect())) == want


def test_the_filter_merges_and_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    ids = spark.range(3000).withColumn("k", F.col("id") * 3)
    whole = {r[0]: list(r[1]) for r in hotjoin.key_filter(ids, "k", 1024).collect()}
    parts = [{r[0]: list(r[1]) for r in hotjoin.key_filter(ids.where(F.col("id") % 2 == p), "k", 1024).collect()} for p in (0, 1)]
    none = [0] * hotjoin.ROW_WORDS
    assert whole == {row: [x | y for x, y in zip(parts[0].get(row, none), parts[1].get(row, none))] for row in parts[0].keys() | parts[1].keys()}
    assert len(whole) <= 1024 // hotjoin.ROW_WORDS
    told = hotjoin.marked(spark.range(20_000).withColumnRenamed("id", "k"), "k", hotjoin.key_filter(ids, "k", 4096), "may", 4096)
    may = {k for k, m in told.collect() if m}
    assert may >= {3 * i for i in range(3000)}
    assert len(may) < 3000 + 0.05 * 17_000
    with pytest.raises(ValueError):
        hotjoin.key_filter(ids, "k", 100)


def test_hot_keys_are_dealt_over_cells(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    fans = hotjoin._fans(spark, rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert [r[0] for r in fans.collect()] == [7] and fans.first()[1] > 2
    dealt = hotjoin._dealt(rows, "k", fans, hotjoin._no_fans(fans), ("cell", "one"))
    held = Counter(r[0] for r in dealt.where("k = 7").select("cell").collect())
    assert dealt.count() == 4000 and max(held.values()) < 1.2 * 1334 / len(held)


def test_hot_key_join_of_empty_tables(spark):
    _, right, l, r = _sides(spark)
    nothing = l.limit(0)
    assert hotjoin.hot_key_join(nothing, r, "k").count() == len(right)
    assert hotjoin.hot_key_join(nothing, r.limit(0), "k").count() == 0
    a, b = hotjoin.hot_key_partners(nothing, r, "k", {}, {})
    assert a.count() == 0 and b.where("n_partners = 0").count() == len(right)


def test_digest_counts_join_rows(spark):
    rnd = random.Random(8)
    clicks = [(k, rnd.choice([None, 1, 2, 3, 9, k]), rnd.choice([None, -0.0, 12.345, 99.995, -3.21])) for k in range(300)]
    sales = [(k, rnd.choice([None, 1, 2, 4, 9, 10_000 + k]), rnd.choice([None, 5.0, 0.125])) for k in range(200)]
    clicks, sales = clicks + clicks[:20] * 2, sales + sales[:7]

    def keyed(rows):
        out = []
        for number, client, amount in rows:
            h = zlib.crc32(str(number).encode())
            cents = "" if amount is None else str(math.floor(100 * amount + 0.5))
            out.append((number, h // 10 % 3 if h % 10 < 2 else client, zlib.crc32(f"{number}:{cents}".encode())))
        return out

    want = {}
    left, right = keyed(clicks), keyed(sales)
    for side, own, other in (("click", left, right), ("sale", right, left)):
        for number, client, _ in own:
            met = [c for _, k, c in other if k is not None and k == client]
            copies, inner, lefts, fulls, crc = want.get((side, number, client), (0, 0, 0, 0, 0))
            full = max(1, len(met))
            want[side, number, client] = (copies + 1, inner + len(met), lefts + (full if side == "click" else len(met)), fulls + full, crc + sum(met))
    got = hotjoin.digest(spark.createDataFrame(clicks, "click_id long, client_id long, value double"), spark.createDataFrame(sales, "sale_id long, client_id long, total double"), 64).collect()
    assert {(r.side, r.id, r.client_id): (r.copies, r.inner_rows, r.left_rows, r.full_rows, r.partner_crc) for r in got} == want


# --- 13: importance resampling -----------------------------------------------------------------


def _plain_features(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _plain_resample(docs, target, per_cent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in _plain_features(t)[1])
    t = Counter(bucket(f) for x in target for f in _plain_features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for d, text in docs:
        w, f = _plain_features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = {(r[0], r[2], r[3]): k + 1 for k, r in enumerate(able[: per_cent * len(able) // 100])}
    return out, drawn


@pytest.mark.parametrize("per_cent", [5, 60])
def test_resampling_matches_brute_force(spark, per_cent):
    rows = corpus.rows(n=80)
    target = [rows[5][1], rows[9][1], "The MIT license of été", None, ""]
    got = resample.resampled(corpus.frame(spark, n=80), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), per_cent).collect()
    want, drawn = _plain_resample([(r[0], r[1]) for r in rows], target, per_cent, resample.LEAST_WORDS)
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in want)
    assert {(r.doc_id, r.weight, r.score): r["rank"] for r in got if r["rank"] is not None} == drawn and drawn


def test_identical_texts_are_collapsed_once(spark):
    df = spark.createDataFrame([(k, "one two three" if k % 3 else f"text {k}") for k in range(90)], "doc_id long, text string")
    texts = resample.collapsed(df)
    assert texts.count() == 31 and max(r.n for r in texts.collect()) == 60
    assert resample.histogram(texts).sum() == 60 * 6 + 30 * 3


def test_resampling_of_empty_tables(spark):
    empty, items = corpus.empty(spark), spark.createDataFrame([], "text string")
    assert resample.resampled(empty, items).count() == 0
    got = resample.resampled(corpus.frame(spark), items, 50).collect()
    assert len(got) == len(corpus.rows()) and any(r["rank"] == 1 for r in got)


# --- 11: quality classifier --------------------------------------------------------------------


def _labelled(n=400, seed=2):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 120))).capitalize()
        bad = k % 4 == 0
        if bad:
            text = rnd.choice([text.upper(), " | ".join(text.split()), "*** ".join(text.split()), " ".join(w + " " + w for w in text.split())])
        docs.append((k, text))
        labels.append((k, 0 if bad else 1, 0))
    return docs, labels


def test_classifier_tells_unseen_documents_apart(spark):
    docs, labels = _labelled()
    df = spark.createDataFrame([*docs, (None, None), (900, ""), (901, "z" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in classifier.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    out = [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(out) > 40 and {k for k in got if k is not None and got[k].held_out} - {900, 901} == set(out)
    truth = {k: q for k, q, _ in labels}
    assert sum(got[k].predicted == truth[k] for k in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == len(docs) + 3


def test_held_out_labels_teach_nothing(spark):
    docs, labels = _labelled(120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, 0) for k, q, _ in labels]
    a, b = (sorted(map(tuple, classifier.quality_scores(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, turned))
    assert a == b


def test_training_rows_are_bounded_and_consistent(spark):
    docs, labels = _labelled(200)
    df = spark.createDataFrame([*docs, (1, "another text of document one")], "doc_id long, text string")
    told = spark.createDataFrame([*labels, (2, 1 - labels[2][1], 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.training_rows(df, told, "quality").collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 2 not in ids and all(zlib.crc32(str(k).encode()) % 5 for k in ids)
    assert 10 <= classifier.training_rows(df, told, "quality", 30).count() <= 30


def test_classifier_without_two_classes(spark):
    docs, labels = _labelled(40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.quality_scores(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    assert min(r.score for r in classifier.quality_scores(df, one).collect()) > 0.9
    assert classifier.quality_scores(df.limit(0), none).count() == 0


def test_dual_descent_reaches_the_optimum():
    """On two features the dual's answer has no better neighbour in the primal."""
    rnd = np.random.default_rng(1)
    rows = [np.array([k], np.int64) if k < 2 else np.array([0, 1], np.int64) for k in rnd.integers(0, 3, 60)]
    y = np.array([1 if (0 in x) != (rnd.random() < 0.1) else 0 for x in rows])
    ratio = np.array([1.0, 0.5])
    weight, offset = classifier.dual_descent(rows, y, ratio, cost=1.0, passes=500)
    share = {c: 60 / (2 * (y == c).sum()) for c in (0, 1)}
    sign = np.where(y > 0, 1.0, -1.0)
    units = np.array([[(ratio[k] if k in x else 0.0) for k in (0, 1)] for x in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(share[int(c)] * max(0, 1 - s * (u @ w + b)) for u, s, c in zip(units, sign, y))

    w = weight / ratio
    best = loss(w, offset)
    assert all(loss(w + d[:2], offset + d[2]) >= best - 1e-3 for d in rnd.normal(0, 0.05, (300, 3)))
