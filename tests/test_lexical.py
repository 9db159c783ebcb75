"""The score-bounded index against plain BM25, and what it reads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lexical


def _corpus(n=400, seed=1):
    """Documents in topics of their own rare words, stop words everywhere, lengths from 0 to 400."""
    rnd = random.Random(seed)
    stop = [f"stop{k}" for k in range(12)]
    docs = []
    for k in range(n):
        topic = [f"t{k % 20}w{j}" for j in range(30)]
        size = rnd.choice([0, 3, 20, 20, 60, 400])
        docs.append((k % 2, k, [rnd.choice(stop) if rnd.random() < 0.7 else rnd.choice(topic) for _ in range(size)]))
    docs.append((0, 10_000, None))
    queries = []
    for q in range(30):
        queries.append((q % 2, q, [rnd.choice(stop) for _ in range(6)] + [f"t{q % 20}w{rnd.randrange(30)}" for _ in range(rnd.randrange(4))]))
    queries += [(0, 100, ["stop1"]), (1, 101, ["unknown"]), (1, 102, []), (7, 103, ["stop1"])]
    return docs, queries


def _plain(docs, queries, k, distinct=False, bounded=False):
    out = []
    for scope, query, words in queries:
        own = [(d, t or []) for s, d, t in docs if s == scope]
        if not own:
            continue
        avgdl = max(1.0, sum(len(t) for _, t in own) / len(own))
        df = Counter(w for _, t in own for w in set(t))
        asked = Counter(words)
        scored = []
        for d, t in own:
            tf = Counter(t)
            parts = [
                math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * (1 if distinct else 1 + math.log(n)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
                for w, n in asked.items()
                if tf[w]
            ]
            if parts:
                score = sum(parts)
                scored.append((1 - math.exp(-score / len(asked)) if bounded else score, d))
        scored.sort(key=lambda x: (-round(x[0], 9), x[1]))
        out += [(scope, query, d, round(s, 6), rank + 1) for rank, (s, d) in enumerate(scored[:k])]
    return sorted(out)


def _frames(spark, docs, queries):
    return spark.createDataFrame(docs, "scope int, doc_id long, t array<string>"), spark.createDataFrame(queries, "scope int, query_id long, q array<string>")


def _rows(df):
    return sorted((r.scope, r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 50])
def test_top_k_is_exact(spark, k):
    docs, queries = _corpus()
    d, q = _frames(spark, docs, queries)
    assert _rows(lexical.top_k(d, q, F.col("t"), F.col("q"), k)) == _plain(docs, queries, k)


def test_bounded_top_k_is_exact(spark):
    docs, queries = _corpus(seed=2)
    d, q = _frames(spark, docs, queries)
    assert _rows(lexical.bounded_top_k(d, q, F.col("t"), F.col("q"), 4)) == _plain(docs, queries, 4, distinct=True, bounded=True)


def test_many_queries_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_PART", 7)
    docs, queries = _corpus(seed=3)
    d, q = _frames(spark, docs, queries)
    assert _rows(lexical.top_k(d, q, F.col("t"), F.col("q"), 3)) == _plain(docs, queries, 3)


def test_empty_tables(spark):
    docs, queries = _corpus(20)
    d, q = _frames(spark, docs, queries)
    assert lexical.top_k(d.limit(0), q, F.col("t"), F.col("q"), 3).count() == 0
    assert lexical.top_k(d, q.limit(0), F.col("t"), F.col("q"), 3).count() == 0


def test_bounds_keep_postings_from_the_token_join(spark):
    """Stop words stand in nearly every document: a plain join meets them all, the bounds leave a hundredth."""
    docs, queries = _corpus(3000, seed=4)
    d, q = _frames(spark, docs, [x for x in queries if len(x[2]) > 6])
    index = lexical.build(d, F.col("t"), block_docs=16)
    asked = lexical.asked_terms(index, q, F.col("q"))
    plain = asked.join(index.postings, ["scope", "token"]).count()
    first = lexical.first_lists(index, asked, 3)
    met = lexical.block_matches(index, lexical.needed_terms(asked, lexical.thresholds(index, asked, 3)))
    assert first.count() + met.count() < plain / 10
    pairs = q.join(index.postings.select("scope", "block").distinct(), "scope").count()
    assert lexical.live_blocks(met).count() < 0.6 * pairs  # and many blocks are skipped whole
