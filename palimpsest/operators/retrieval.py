"""Batch retrieval: every operator answers a table of queries against a table of documents at once.

Documents and queries may carry a ``scope`` (a conversation, a snapshot): statistics, matches and
ranks stay within it.  Token matches are equi-joins on (scope, token) of pre-aggregated term
counts, so a pair of query and document exists only where they share a term.  Ranks use
row_number() <= k, which Spark plans as a group limit ahead of the exchange; ties go to the
smaller id.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The retrieval defaults.
K1, B = 1.5, 0.75
RRF_K = 60
WEIGHTS = {"semantic": 0.40, "bm25": 0.30, "keyword": 0.15, "structured": 0.15, "source": 0.35}
ENTITY_MULTIPLIER, CURRENT_MULTIPLIER, VALID_MULTIPLIER, MISMATCH_MULTIPLIER = 1.10, 1.05, 1.20, 0.50
CANDIDATES, RESULTS, MAX_RESULTS, MAX_DEPTH = 30, 8, 24, 3
STRATEGIES = ("semantic", "bm25", "keyword", "structured", "source", "hybrid")
ALIASES = {"vector": "semantic", "lexical": "bm25", "exact": "keyword", "temporal": "structured"}
#: Decimals at which scores are compared, so that sums in another order rank alike.
DECIMALS = 9
#: Rows whose hash vectors a task makes at once (3 kB each).
VECTOR_ROWS = 2048


def strategy(name: Column) -> Column:
    lowered = F.lower(F.trim(name))
    for alias, real in ALIASES.items():
        lowered = F.when(lowered == alias, real).otherwise(lowered)
    return F.when(lowered.isin(*STRATEGIES), lowered).otherwise("hybrid")


def depth(value: Column) -> Column:
    text = F.lower(value.cast("string"))
    number = F.when(text == "shallow", 1).when(text == "standard", 2).when(text == "deep", 3).otherwise(F.coalesce(text.try_cast("int"), F.lit(1)))
    return F.least(F.lit(MAX_DEPTH), F.greatest(F.lit(1), number))


def top_k(value: Column) -> Column:
    return F.least(F.lit(MAX_RESULTS), F.greatest(F.lit(1), value))


def ranked(scored: DataFrame, k: int, partition: list[str], score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best of each partition with their rank."""
    w = Window.partitionBy(*partition).orderBy(F.round(score, DECIMALS).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def terms(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """scope, key, token, tf of the token arrays."""
    return docs.select("scope", key, F.explode(tokens).alias("token")).groupBy("scope", key, "token").agg(F.count("*").alias("tf"))


def boosted(fields: list[tuple[Column, int]]) -> Column:
    """One token array of several fields, each repeated as often as it weighs."""
    return F.concat(*[f for field, times in fields for f in [field] * times])


def corpus_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """scope, n_docs, avgdl (at least 1)."""
    return docs.groupBy("scope").agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.size(tokens)), F.lit(1.0)).alias("avgdl"))


def scoped_by_kinds(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and queries whose scope also names the kinds that a query asks for, so that any route filters by kind before its statistics.

    docs: scope, doc_id, kind; queries: scope, query_id, kinds (array; null or empty: all).  Each
    distinct set of kinds of a scope sees its own documents; sets are the stated side.  Further
    columns pass through.
    """
    wanted = F.array_sort(F.array_distinct(F.coalesce("kinds", F.array().cast("array<string>"))))
    asked = queries.withColumn("kinds", wanted).withColumn("scope", F.struct("scope", "kinds"))
    sets = asked.select("scope").distinct().select(F.col("scope").alias("of"), F.col("scope.scope").alias("scope"))
    fits = (F.size("of.kinds") == 0) | F.array_contains("of.kinds", F.col("kind"))
    return docs.join(sets, "scope").where(fits).drop("scope").withColumnRenamed("of", "scope"), asked


def bm25(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, distinct_query: bool = False) -> DataFrame:
    """scope, query_id, doc_id, score of all pairs that share a term; docs: scope, doc_id; queries: scope, query_id.

    A term that a query repeats weighs 1 + ln(count), or 1 if ``distinct_query``.
    """
    tf = terms(docs, doc_tokens)
    df = tf.groupBy("scope", "token").agg(F.count("*").alias("df"))
    lengths = docs.select("scope", "doc_id", F.size(doc_tokens).alias("dl")).join(corpus_statistics(docs, doc_tokens), "scope")
    asked = terms(queries, query_tokens, "query_id").withColumnRenamed("tf", "qf")
    weight = F.lit(1.0) if distinct_query else 1.0 + F.log(F.col("qf"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * weight
    met = asked.join(df, ["scope", "token"]).join(tf, ["scope", "token"]).join(lengths, ["scope", "doc_id"])
    return met.groupBy("scope", "query_id", "doc_id").agg(F.sum(part).alias("score"))


def bounded_bm25(scored: DataFrame, n_query_tokens: Column) -> DataFrame:
    """Scores as 1 - exp(-score / number of distinct query tokens)."""
    return scored.withColumn("score", 1.0 - F.exp(-F.col("score") / F.greatest(n_query_tokens, F.lit(1))))


def row_max_bm25(scored: DataFrame) -> DataFrame:
    """Scores over the query's best one."""
    best = F.max("score").over(Window.partitionBy("scope", "query_id"))
    return scored.withColumn("score", F.col("score") / F.greatest(best, F.lit(1e-12)))


def keyword_score(phrases: Column, text: Column, query_tokens: Column, text_tokens: Column) -> Column:
    """2 + a quarter per word (at most 4) for each phrase that the text holds, plus the share of query tokens in it."""
    words = lambda p: F.size(F.array_remove(F.split(p, r"\s+"), ""))
    exact = F.aggregate(
        F.filter(phrases, lambda p: F.contains(F.lower(text), F.lower(p))), F.lit(0.0), lambda a, p: a + 2.0 + F.least(words(p), F.lit(4)) * 0.25
    )
    return exact + overlap_share(query_tokens, text_tokens)


def overlap_share(query_tokens: Column, text_tokens: Column) -> Column:
    return F.size(F.array_intersect(query_tokens, text_tokens)) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1))


def time_valid(mode: Column, target: Column, target_end: Column, start: Column, end: Column, current: Column) -> Column:
    """Validity of [start, end) under a time mode; times are texts and compare as such."""
    point = (F.coalesce(start, F.lit("")) <= target) & (target < F.coalesce(end, F.lit("z")))
    reach = (F.coalesce(start, F.lit("")) <= F.coalesce(target_end, target)) & (F.coalesce(end, F.lit("z")) >= target)
    return (
        F.when(mode == "none", F.lit(True))
        .when(mode == "current", current)
        .when(F.coalesce(target, F.lit("")) == "", F.lit(True))
        .when(mode == "point", point)
        .when(mode == "before", F.coalesce((start != "") & (start < target), F.lit(False)))
        .when(mode == "after", F.coalesce((start != "") & (start >= target), F.lit(False)))
        .when(mode == "range", reach)
        .otherwise(F.lit(True))
    )


def time_score(mode: Column, target: Column, target_end: Column, start: Column, end: Column, current: Column) -> Column:
    valid = time_valid(mode, target, target_end, start, end, current)
    graded = lambda good: F.when(valid, F.lit(good)).otherwise(F.lit(0.0))
    return (
        F.when(mode == "none", F.lit(0.0))
        .when(mode == "current", graded(1.0))
        .when(F.coalesce(target, F.lit("")) == "", F.lit(0.1))
        .when(mode.isin("point", "range"), graded(1.0))
        .when(mode.isin("before", "after"), graded(0.8))
        .otherwise(F.lit(0.0))
    )


def entity_score(entities: Column, doc_entities: Column, subject: Column, content: Column) -> Column:
    """For each wanted entity 1 if the document names it, else 0.8 in its subject, else 0.4 in its content."""
    return F.aggregate(
        F.transform(entities, F.lower),
        F.lit(0.0),
        lambda a, e: a
        + F.when(F.array_contains(F.transform(doc_entities, F.lower), e), 1.0).when(F.contains(F.lower(subject), e), 0.8).when(F.contains(F.lower(content), e), 0.4).otherwise(0.0),
    )


def fused(routes: list[tuple[str, DataFrame, float]], rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked routes (scope, query_id, doc_id, rank): score and matched paths in the order of the routes."""
    every = None
    for order, (path, hits, weight) in enumerate(routes):
        part = hits.select("scope", "query_id", "doc_id", (F.lit(weight) / (rrf_k + F.col("rank"))).alias("share"), F.lit(order).alias("route"), F.lit(path.split(":")[0]).alias("path"))
        every = part if every is None else every.unionByName(part)
    paths = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("route", "path"))), lambda x: x["path"]))
    return every.groupBy("scope", "query_id", "doc_id").agg(F.sum("share").alias("score"), paths.alias("matched_paths"))


def deduplicated(hits: DataFrame, logical: str) -> DataFrame:
    """The best hit of each logical id of a query."""
    w = Window.partitionBy("scope", "query_id", logical).orderBy(F.round("score", DECIMALS).desc(), "doc_id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def multiplied(score: Column, entity_hit: Column, mode: Column, target: Column, current: Column, valid: Column) -> Column:
    """The score after the entity, current and time multipliers."""
    out = score * F.when(entity_hit, ENTITY_MULTIPLIER).otherwise(1.0)
    out = out * F.when((mode == "current") & current, CURRENT_MULTIPLIER).otherwise(1.0)
    timed = (mode != "none") & (F.coalesce(target, F.lit("")) != "")
    return out * F.when(timed & valid, VALID_MULTIPLIER).when(timed, MISMATCH_MULTIPLIER).otherwise(1.0)


def hash_embedding(docs: DataFrame, tokens: Column, key: str, dim: int = 384) -> DataFrame:
    """key, idx, value: the non-zero places of each text's L2-normalised hash vector.

    A token's place is the first 4 bytes of its SHA-256 modulo ``dim``, its sign the parity of the fifth.
    """
    digest = F.sha2(F.col("token"), 256)
    one = docs.select(key, F.explode(tokens).alias("token")).select(
        key,
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).alias("idx"),
        F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"),
    )
    summed = one.groupBy(key, "idx").agg(F.sum("sign").alias("x")).where("x <> 0")
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return summed.withColumn("value", F.col("x") / F.greatest(length, F.lit(1e-12))).drop("x")


def hash_vectors(docs: DataFrame, tokens: Column, keys: list[str], dim: int = 384) -> DataFrame:
    """keys, v: the places of ``hash_embedding`` as one array of (idx, value) for each row; rows without any are left out.

    A task makes each row's vector from its own tokens, so no token leaves it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, VECTOR_ROWS):
                batch = whole.slice(first, VECTOR_ROWS)
                n, words = batch.num_rows, batch.column(len(keys)).flatten().dictionary_encode()
                distinct, at = words.dictionary.cast(pa.binary()), words.indices.to_numpy(zero_copy_only=False)
                ends, data = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset :][: len(distinct) + 1].tolist(), (distinct.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
                digests = np.frombuffer(b"".join([hashlib.sha256(data[a:b]).digest()[:5] for a, b in itertools.pairwise(ends)]), np.uint8).reshape(-1, 5)
                place, sign = (digests[:, :4].astype(np.int64) @ (1 << np.array([24, 16, 8, 0]))) % dim, 1.0 - 2.0 * (digests[:, 4] % 2)
                rows = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(batch.column(len(keys))), 0).to_numpy(zero_copy_only=False))
                x = np.bincount(rows * dim + place[at], sign[at], n * dim).reshape(n, dim)
                row, idx = np.nonzero(x)
                sizes = np.bincount(row, minlength=n)
                value = x[row, idx] / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[row]
                places = pa.StructArray.from_arrays([pa.array(idx, pa.int64()), pa.array(value)], ["idx", "value"])
                held = pa.array(sizes > 0)
                v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]), pa.int32()), places)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(held) for c in range(len(keys))], v], [*keys, "v"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "v array<struct<idx: bigint, value: double>>"])
    return docs.select(*keys, tokens.alias("tokens")).mapInArrow(run, schema)


def query_profile(question: Column, stop_words: list[str], pattern: str) -> Column:
    """struct(keywords: at most 12 distinct tokens, entities: at most 8 capitalised words)."""
    tokens = F.transform(F.regexp_extract_all(question, F.lit(pattern), F.lit(0)), F.lower)
    keywords = F.slice(F.array_distinct(F.filter(tokens, lambda t: ~t.isin(stop_words))), 1, 12)
    entities = F.slice(F.array_distinct(F.regexp_extract_all(question, F.lit(r"\b[A-Z][A-Za-z0-9'-]+"), F.lit(0))), 1, 8)
    return F.struct(keywords.alias("keywords"), entities.alias("entities"))
