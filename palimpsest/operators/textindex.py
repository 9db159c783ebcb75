"""A positional text index in segments, one for each commit, and phrase search with an as-of predicate.

A segment holds, for the documents that a commit opened, each token with its positions, and each
document's length.  Adding a commit writes its own segment and reads no other; segments merge by
union (``sources.commits.compact`` rewrites them sorted by token, so that a search prunes files).

A phrase is looked up by its rarest token first; its other tokens are then looked up by (token,
document) and the starts that all of them agree on are intersected, so a stop word's list is never
read as a whole.  Hits are ordered by BM25 with the phrase as one term (fixed values below); the
statistics cover the whole index, the as-of predicate comes after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as rt

# The full-text ranking's parameters, and the weight of a phrase that most documents hold.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def segment(docs: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(postings: scope, token, doc_id, positions; lengths: scope, doc_id, size) of docs (scope, doc_id); null token arrays count as empty."""
    held = docs.select("scope", "doc_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
    places = held.select("scope", "doc_id", F.posexplode("t").alias("at", "token"))
    postings = places.groupBy("scope", "token", "doc_id").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    return postings, held.select("scope", "doc_id", F.size("t").alias("size"))


def places(postings: DataFrame, phrases: DataFrame, tokens: Column) -> DataFrame:
    """scope, query_id, doc_id, n: how often a document holds a query's whole phrase (scope, query_id); empty phrases are held by none."""
    asked = phrases.select("scope", "query_id", tokens.alias("t")).where(F.size("t") > 0)
    words = asked.select("scope", "query_id", F.size("t").alias("words"), F.posexplode("t").alias("k", "token"))
    df = postings.join(words.select("scope", "token").distinct(), ["scope", "token"], "left_semi").groupBy("scope", "token").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("scope", "query_id").orderBy("df", "k")
    known = words.join(df, ["scope", "token"])  # an unknown token leaves the phrase without one of its words
    whole = F.count("*").over(Window.partitionBy("scope", "query_id")) == F.col("words")
    known = known.withColumn("whole", whole).where("whole").withColumn("place", F.row_number().over(rare)).drop("whole", "df")
    starts = lambda: F.transform("positions", lambda p: p - F.col("k"))
    first = known.where("place = 1").join(postings, ["scope", "token"]).select("scope", "query_id", "doc_id", "words", starts().alias("starts"))
    rest = first.select("scope", "query_id", "doc_id").join(known.where("place > 1").select("scope", "query_id", "token", "k"), ["scope", "query_id"])
    others = rest.join(postings, ["scope", "token", "doc_id"]).select("scope", "query_id", "doc_id", starts().alias("more"))
    met = others.groupBy("scope", "query_id", "doc_id").agg(F.collect_list("more").alias("more"))  # as many as the phrase has words
    both = first.join(met, ["scope", "query_id", "doc_id"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<array<int>>"))).where(F.size("more") == F.col("words") - 1)
    n = F.size(F.aggregate("more", F.col("starts"), lambda a, x: F.array_intersect(a, x)))
    return both.select("scope", "query_id", "doc_id", n.alias("n")).where("n > 0")


def phrase_hits(postings: DataFrame, lengths: DataFrame, versions: DataFrame, phrases: DataFrame, tokens: Column, as_of: Column | None, k: int, include_history: bool = False) -> DataFrame:
    """scope, query_id, doc_id, n, score, rank: the k best documents in force at a commit (or now) that hold a query's phrase.

    versions: doc_id, system_from, system_to; with ``include_history`` those already closed by
    then count too.  Ties at nine decimals go to the smaller doc_id.  An index without documents
    has no hits.
    """
    from .store import visible

    found = places(postings, phrases, tokens)
    whole = lengths.agg(F.count("*").alias("all"), F.avg("size").alias("avgdl"))  # one row
    holding = found.groupBy("scope", "query_id").agg(F.count("*").alias("df"))
    idf = F.log((F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))
    scored = found.join(holding, ["scope", "query_id"]).join(lengths, ["scope", "doc_id"]).join(F.broadcast(whole))
    scored = scored.select("scope", "query_id", "doc_id", "n", (F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)) * tf).alias("score"))
    in_force = versions.where((F.col("system_from") <= as_of) if as_of is not None else F.lit(True)) if include_history else versions.where(visible(as_of))
    return rt.ranked(scored.join(in_force.select("doc_id"), "doc_id", "left_semi"), k, ["scope", "query_id"])
