"""BM25 top-k over an inverted index whose lists are cut into blocks with their largest contributions.

The index deals the documents of a scope into blocks of about BLOCK_DOCS documents of like length,
the same blocks for all tokens.  It holds the postings with the part of the score that needs no
query (term frequency against length), and for each (scope, token, block) the largest part in it.

A search first scores the documents of each query's rarest terms in full; the k-th of them is a
score that the answer must reach.  Terms whose largest contributions together stay below it (stop
words above all) are then optional: what they can add is one number, and their lists are not
looked at.  The other terms meet the block summaries, never the postings: one row per (query term,
block) instead of one per (query term, document).  A block whose bound stays below the threshold
is skipped.  A block that is left meets its queries in one group, where NumPy scores its postings
exactly; postings move once, not once per query, and only the k best of a block come out.

Nothing is approximate: every bound is an upper one, and SLACK keeps what lies within the rounding
of sums.  A group holds BLOCK_DOCS documents and QUERY_PART queries at most; more queries are
dealt over several groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as rt
from .graph import cut

#: Documents that share a block, on average, and queries that meet a block in one group.
BLOCK_DOCS, QUERY_PART = 256, 4096
#: Classes of length per doubling; the documents of a block are of one class, which keeps its largest contributions close to the others.
LENGTH_CLASSES = 2
#: The first pass reads a query's rarest terms until their lists hold this many times k documents.
FIRST_LISTS = 4
#: Sums in another order differ by less; scores are compared at nine decimals.
SLACK = 1e-8


class Index(NamedTuple):
    """postings (kept): scope, token, block, doc_id, part; blocks: scope, token, block, most; terms: scope, token, df, idf, most."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame


def build(docs: DataFrame, tokens: Column, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of docs (scope, doc_id) by their token arrays.

    Null arrays count as empty; a scope without tokens has no postings.  doc_id is unique in a
    scope.
    """
    held = docs.select("scope", "doc_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
    held = held.withColumn("dl", F.size("t")).withColumn("class", F.floor(F.log2(F.col("dl") + 1) * LENGTH_CLASSES).cast("long"))
    sizes = held.groupBy("scope", "class").agg(F.count("*").alias("n"), F.sum("dl").alias("size"))
    scope = Window.partitionBy("scope")
    sizes = sizes.withColumns({"n_docs": F.sum("n").over(scope), "avgdl": F.greatest(F.sum("size").over(scope) / F.sum("n").over(scope), F.lit(1.0))})
    sizes = cut(sizes.select("scope", "class", "n_docs", "avgdl", F.ceil(F.col("n") / block_docs).alias("n_blocks")))
    tf = held.select("scope", "doc_id", "dl", "class", F.explode("t").alias("token")).groupBy("scope", "doc_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("class").alias("class"))
    part = F.col("tf") * (rt.K1 + 1) / (F.col("tf") + rt.K1 * (1 - rt.B + rt.B * F.col("dl") / F.col("avgdl")))
    block = F.shiftleft("class", 40) + F.pmod(F.xxhash64("doc_id"), F.col("n_blocks"))
    postings = cut(tf.join(sizes, ["scope", "class"]).select("scope", "token", block.alias("block"), "doc_id", part.alias("part")))
    blocks = postings.groupBy("scope", "token", "block").agg(F.max("part").alias("most"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.groupBy("scope", "token").agg(F.count("*").alias("df"), F.max("part").alias("most")).join(sizes.select("scope", "n_docs").distinct(), "scope")
    return Index(postings, blocks, terms.select("scope", "token", "df", idf.alias("idf"), "most"))


def asked_terms(index: Index, queries: DataFrame, tokens: Column, distinct: bool = False) -> DataFrame:
    """scope, query_id, token, w, m, df, n: weight and largest contribution of each known term of a query, and the query's number of distinct terms."""
    counts = rt.terms(queries, tokens, "query_id")
    n = F.count("*").over(Window.partitionBy("scope", "query_id"))
    weight = F.lit(1.0) if distinct else 1.0 + F.log(F.col("tf"))
    known = counts.withColumn("n", n).join(index.terms, ["scope", "token"])
    return cut(known.select("scope", "query_id", "token", (F.col("idf") * weight).alias("w"), (F.col("idf") * weight * F.col("most")).alias("m"), "df", "n"))


def first_lists(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The postings that the first pass reads: those of each query's rarest terms."""
    rare = Window.partitionBy("scope", "query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    few = asked.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < FIRST_LISTS * k)
    return few.select("scope", "query_id", "token", "w").join(index.postings, ["scope", "token"])


def thresholds(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """scope, query_id, theta: a score that at least k documents reach, for the queries of which the first pass finds as many."""
    partial = first_lists(index, asked, k).groupBy("scope", "query_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))
    wanted = rt.ranked(partial, k, ["scope", "query_id"]).select("scope", "query_id", "doc_id").join(asked.select("scope", "query_id", "token", "w"), ["scope", "query_id"])
    exact = wanted.join(index.postings, ["scope", "token", "doc_id"]).groupBy("scope", "query_id", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))
    return exact.groupBy("scope", "query_id").agg(F.min("score").alias("theta"), F.count("*").alias("found")).where(F.col("found") >= k).drop("found")


def needed_terms(asked: DataFrame, theta: DataFrame, saturating: bool = False) -> DataFrame:
    """The terms whose blocks must be looked at, with bar (what a document has to reach) and rest (what the query's other terms can add together).

    ``saturating``: documents are ranked by 1 - exp(-score / n), where scores that differ more tie at nine decimals; the bar is lowered by as much.
    """
    query = Window.partitionBy("scope", "query_id")
    slack = F.lit(SLACK) + (2e-9 * F.col("n") * F.exp(F.col("theta") / F.col("n")) if saturating else F.lit(0.0))
    told = asked.join(theta, ["scope", "query_id"], "left").withColumn("bar", F.coalesce(F.col("theta") - slack, F.lit(0.0)))
    optional = told.withColumn("optional", F.sum("m").over(query.orderBy("m", "token")) < F.col("bar"))
    rest = F.coalesce(F.sum(F.when(F.col("optional"), F.col("m"))).over(query), F.lit(0.0))
    return optional.withColumn("rest", rest).where(~F.col("optional")).select("scope", "query_id", "token", "w", "bar", "rest")


def block_matches(index: Index, needed: DataFrame) -> DataFrame:
    """The block summaries that needed terms meet."""
    return needed.join(index.blocks, ["scope", "token"])


def live_blocks(met: DataFrame) -> DataFrame:
    """scope, query_id, block, bar of the blocks whose bound reaches a query's bar; met: block_matches."""
    bound = met.groupBy("scope", "query_id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("reach"), F.first("rest").alias("rest"), F.first("bar").alias("bar"))
    return bound.where(F.col("reach") + F.col("rest") >= F.col("bar") - SLACK).select("scope", "query_id", "block", "bar")


def _scored_block(postings: pa.Table, queries: pa.Table, k: int, saturating: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of queries, rows of doc table, scores) of the documents of a block that a query may keep; postings: token, doc, part."""
    tokens = postings.column("token").combine_chunks().dictionary_encode()
    place = {t: k for k, t in enumerate(tokens.dictionary.to_pylist())}
    code, doc, part = tokens.indices.to_numpy(), postings.column("doc").to_numpy(), postings.column("part").to_numpy()
    order = np.argsort(code, kind="stable")
    doc, part = doc[order], part[order]
    ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(place))))
    docs = int(doc.max()) + 1 if len(doc) else 0
    for row, (own, weights, bar) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("tokens", "weights", "bar")), strict=True)):
        score = np.zeros(docs)
        for token, w in zip(own, weights, strict=True):
            at = place.get(token)
            if at is not None:
                span = slice(ends[at], ends[at + 1])
                score[doc[span]] += w * part[span]  # a document has a token once
        best = np.flatnonzero((score >= bar) & (score > 0))
        if len(best) > k:
            kth = np.partition(score[best], len(best) - k)[len(best) - k]
            slack = SLACK + (2e-9 * len(own) * np.exp(min(700.0, kth / len(own))) if saturating else 0.0)
            best = best[score[best] >= kth - slack]
        if len(best):
            yield row, best, score[best]


def matches(index: Index, asked: DataFrame, k: int, saturating: bool = False) -> DataFrame:
    """scope, query_id, doc_id, score of every document that can be among a query's k best, and of few others."""
    needed = needed_terms(asked, thresholds(index, asked, k), saturating)
    live = cut(live_blocks(block_matches(index, needed)))
    whole = asked.groupBy("scope", "query_id").agg(F.collect_list(F.struct("token", "w")).alias("of"))
    parts = -(-whole.count() // QUERY_PART)
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))).cast("int").alias("query_part")
    met = live.join(whole, ["scope", "query_id"]).select("scope", "block", part, "query_id", "bar", F.col("of.token").alias("tokens"), F.col("of.w").alias("weights"))
    held = index.postings.join(live.select("scope", "block").distinct(), ["scope", "block"], "left_semi")
    held = held.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *index.postings.schema]}
    schema = f"scope {kinds['scope']}, query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"

    def score(postings: pa.Table, queries: pa.Table) -> pa.Table:
        scope, query, doc, scores = [], [], [], []
        if postings.num_rows and queries.num_rows:
            ids = postings.column("doc_id").combine_chunks().dictionary_encode()
            rows = pa.table({"token": postings.column("token"), "doc": ids.indices, "part": postings.column("part")})
            for row, best, value in _scored_block(rows, queries, k, saturating):
                query.append(pa.repeat(queries.column("query_id")[row], len(best)))
                scope.append(pa.repeat(queries.column("scope")[row], len(best)))
                doc.append(ids.dictionary.take(pa.array(best)))
                scores.append(value)
        types = [queries.schema.field(n).type for n in ("scope", "query_id")] + [postings.schema.field("doc_id").type]
        columns = [pa.chunked_array(x, t) for x, t in zip((scope, query, doc), types, strict=True)]
        return pa.table([*columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["scope", "query_id", "doc_id", "score"])

    keys = ["scope", "block", "query_part"]
    return held.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(score, schema)


def top_k(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, k: int, distinct_query: bool = False) -> DataFrame:
    """scope, query_id, doc_id, score, rank of the k best documents of each query that share a term with it; ties at nine decimals go to the smaller doc_id.

    docs: scope, doc_id (unique in a scope); queries: scope, query_id.  Queries without a known
    term have no rows; empty tables give none.
    """
    index = build(docs, doc_tokens)
    return rt.ranked(matches(index, asked_terms(index, queries, query_tokens, distinct_query), k), k, ["scope", "query_id"])


def bounded_top_k(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """The k best by 1 - exp(-score / number of distinct query terms)."""
    index = build(docs, doc_tokens)
    asked = asked_terms(index, queries, query_tokens, True)
    sizes = asked.groupBy("scope", "query_id").agg(F.first("n").alias("n"))
    scored = rt.bounded_bm25(matches(index, asked, k, True).join(sizes, ["scope", "query_id"]), F.col("n"))
    return rt.ranked(scored, k, ["scope", "query_id"])
