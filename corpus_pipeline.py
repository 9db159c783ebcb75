"""The corpus pipeline: quality rules, near duplicates, benchmark items, secrets, packing.

Each stage works on all that its predecessor kept.  The first three drop rows, the fourth masks
live-looking secrets in place, the last packs what is left into token windows.

Awkward rows: a null or empty text has no words and goes with the first stage, so later stages
meet it only when they are run on tables of their own, where it has no near copies, items or
secrets and packs as the end id alone.  A null doc_id stays null; rows that share a doc_id are
rows of their own but for exact repeats, of which the second stage keeps one.  Of equal texts the
least doc_id stays.  Further columns, whatever their names, pass through all stages but the last.
Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, ngram, pack, quality, secrets
from palimpsest.llm.common import saved, table
from palimpsest.llm.queries import PACK_END_ID


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and very short texts go, every other row is judged for itself."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id (null only if all are); texts without words all stay."""
    return ngram.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or with few edits; null texts hold none, without items all stay."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that look live masked; a null text stays null, a null source is one owner."""
    return secrets.mask_live(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 4096; a null or empty text is its end id alone, an empty table gives no rows."""
    return pack.with_checksum(pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: Jaccard links, edit distances and token packing have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
