"""Commits over several tables: a log of manifests, each of which names the files of all tables.

A commit first writes the rows of every table it changes to folders of their own, which no reader
knows of, and then publishes one manifest under the next number.  Publishing is a rename that
fails if the name is taken, so of two writers on one base one wins and the other gets
``CommitConflict``; a writer that dies before it leaves folders that nothing names.  A reader
picks a manifest (the last or any earlier one) and sees all tables as of that commit, whatever is
written meanwhile.  ``vacuum`` removes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, DATA, DIGITS = "_log", "data", 12


class CommitConflict(RuntimeError):
    """Another commit was made on the same base."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file as a whole under a name that must be free; false if it is taken."""
    fs, at = _fs(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(at), options)  # fails if the name exists
    except Exception:
        taken = fs.exists(at)
        fs.delete(staged, False)
        if taken:
            return False
        raise
    return True


def _text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    held = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def head(spark: SparkSession, path: str) -> int:
    """The number of the last commit, 0 if there is none."""
    return max((int(n[:-5]) for n in _names(spark, f"{path}/{LOG}") if n.endswith(".json") and n[:-5].isdigit()), default=0)


def manifest(spark: SparkSession, path: str, commit: int | None = None) -> dict:
    """commit, tables (name to its folders and schema) and note of a commit (the last if none is named)."""
    at = head(spark, path) if commit is None else commit
    return json.loads(_text(spark, f"{path}/{LOG}/{at:0{DIGITS}d}.json")) if at else {"commit": 0, "tables": {}, "note": {}}


def commit(spark: SparkSession, path: str, appended: Mapping[str, DataFrame], base: int, replaced: Mapping[str, DataFrame] | None = None, note: Mapping | None = None) -> int:
    """Adds rows to tables, or puts new contents in their place, as one commit on ``base``; its number.

    Raises CommitConflict if ``base`` is not the last commit, before or after the rows are written.
    """
    replaced = replaced or {}
    both = appended.keys() & replaced.keys()
    if both:
        raise ValueError(f"appended and replaced at once: {sorted(both)}")
    now = manifest(spark, path)
    if now["commit"] != base:
        raise CommitConflict(f"the store is at {now['commit']}, not at {base}")
    tables = dict(now["tables"])
    for name, df in (*appended.items(), *replaced.items()):
        folder = f"{DATA}/{name}/{base + 1}-{uuid.uuid4().hex}"
        held = tables.get(name, {"folders": []})["folders"] if name in appended else []
        df.write.mode("errorifexists").parquet(f"{path}/{folder}")
        tables[name] = {"folders": [*held, folder], "schema": tables[name]["schema"] if held else df.schema.json()}
    log = f"{path}/{LOG}"
    fs, at = _fs(spark, log)
    fs.mkdirs(at)
    if not put_if_absent(spark, f"{log}/{base + 1:0{DIGITS}d}.json", json.dumps({"commit": base + 1, "tables": tables, "note": dict(note or {})}, sort_keys=True)):
        raise CommitConflict(f"commit {base + 1} was made by another writer")
    return base + 1


def read(spark: SparkSession, path: str, table: str, commit: int | None = None) -> DataFrame:
    """A table as of a commit (the last if none is named); KeyError if the commit does not know it."""
    from pyspark.sql.types import StructType

    held = manifest(spark, path, commit)["tables"][table]
    return spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(*[f"{path}/{f}" for f in held["folders"]])


def compact(spark: SparkSession, path: str, table: str, keys: list[str], partitions: int) -> int:
    """Rewrites a table's folders as one, sorted by ``keys`` within ranges of them; a commit that changes no row."""
    base = head(spark, path)
    rows = read(spark, path, table, base)
    return commit(spark, path, {}, base, {table: rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)}, {"compacted": table})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes the folders that none of the last ``keep`` manifests names, and older manifests; no writer may be at work."""
    last = head(spark, path)
    kept = [manifest(spark, path, n) for n in range(max(1, last - keep + 1), last + 1)]
    named = {f for m in kept for t in m["tables"].values() for f in t["folders"]}
    gone = []
    for table in _names(spark, f"{path}/{DATA}"):
        for folder in _names(spark, f"{path}/{DATA}/{table}"):
            at = f"{DATA}/{table}/{folder}"
            if at not in named:
                fs, p = _fs(spark, f"{path}/{at}")
                fs.delete(p, True)
                gone.append(at)
    for name in _names(spark, f"{path}/{LOG}"):
        if name.endswith(".tmp") or (name[:-5].isdigit() and int(name[:-5]) <= last - keep):
            fs, p = _fs(spark, f"{path}/{LOG}/{name}")
            fs.delete(p, False)
    return gone


# --- the bitemporal store on top of it -----------------------------------------------------------


def commit_plan(spark: SparkSession, path: str, decisions: DataFrame, conversation: str, base: int, tokens=None) -> int:
    """Applies a plan of decisions to the store at ``base`` and publishes what it opens and closes as one commit.

    Tables: opened (versions as they began), closed (version_id, system_to, end_reason,
    world_end), events, parents, decisions and, with ``tokens``, the text index of what was
    opened.  A commit adds its own rows only; nothing that is stored is written again.
    """
    from ..operators import store, textindex
    from ..operators.graph import cut

    held = versions(spark, path, base)
    before = held if held is not None else spark.createDataFrame([], store.VERSIONS)
    result = store.apply_plan(before, decisions, conversation, base + 1, base, head(spark, path))
    after = cut(result["versions"])
    old = before.select("version_id", F.col("system_to").alias("was"))
    told = after.join(old.withColumn("known", F.lit(True)), "version_id", "left")
    opened = cut(told.where("known IS NULL").drop("was", "known"))
    closed = told.where("known AND was IS NULL AND system_to IS NOT NULL").select("version_id", "system_to", "end_reason", "world_end")
    rows = {"opened": opened, "closed": closed, "events": result["events"], "parents": result["parents"], "decisions": decisions.withColumn("commit_id", F.lit(base + 1).cast("long"))}
    if tokens is not None:
        postings, lengths = textindex.segment(opened.select(F.col("conversation_id").alias("scope"), F.col("version_id").alias("doc_id"), "content"), tokens(F.col("content")))
        rows |= {"postings": postings, "lengths": lengths}
    return commit(spark, path, rows, base, note={"conversation": conversation})


def versions(spark: SparkSession, path: str, commit: int | None = None) -> DataFrame | None:
    """All versions as of a commit: what was opened, with the end that a later commit gave it; None before the first commit."""
    if not (head(spark, path) if commit is None else commit):
        return None
    ends = read(spark, path, "closed", commit).select("version_id", *[F.col(c).alias(f"_{c}") for c in ("system_to", "end_reason", "world_end")], F.lit(True).alias("_ended"))
    opened = read(spark, path, "opened", commit)
    both = opened.join(ends, "version_id", "left")
    now = {c: F.when(F.col("_ended"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("system_to", "end_reason", "world_end")}
    return both.withColumns(now).select(*opened.columns)
