"""Files of runs, banks and packages: scans with their checks, manifests, caches and exports."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks

SIDES = ("access", "construction")


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """What a glob pattern matches, in the file system that the pattern names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(f.getPath()) for f in found or [])


def run_rows(spark: SparkSession, root: str, run: str, name: str, schema: str) -> DataFrame:
    """A run's JSON lines with their conversation's folder: the combined file, else nested conv-* folders, else sibling runs <run>_conv-*.

    Raises FileNotFoundError if there is none of them.
    """
    for pattern in (f"{root}/{run}/{name}", f"{root}/{run}/conv-*/{name}", f"{root}/{run}_conv-*/{name}"):
        if paths := _paths(spark, pattern):
            folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
            return spark.read.schema(schema).json(paths).withColumn("folder", folder)
    raise FileNotFoundError(f"no rows of {run}")


def single_conversation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one conversation of a demonstration file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).limit(1)


def payloads(points: DataFrame, columns: list[str]) -> DataFrame:
    """The payload columns of a vector store's points; the vectors are never read."""
    return points.select("point_id", *columns)


def scoped(memories: DataFrame, namespace: str, conversation: Column, most: int = 10_000) -> DataFrame:
    """The external memories of a conversation's scope, at most ``most`` by id, as the interface states."""
    scope = F.concat_ws(":", F.nullif(F.lit(namespace), F.lit("")), conversation)
    return memories.where(F.col("scope_id") == scope).orderBy("id").limit(most)


def sessions_held(sessions: DataFrame, memories: DataFrame, namespace: str) -> DataFrame:
    """The sessions (conversation_id, session_id) of which an external memory exists; memories: scope_id, session_id."""
    scope = F.concat_ws(":", F.nullif(F.lit(namespace), F.lit("")), "conversation_id")
    return sessions.withColumn("scope_id", scope).join(memories.select("scope_id", "session_id").distinct(), ["scope_id", "session_id"], "left_semi").select(*sessions.columns)


def bank(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A published bank: one JSON file for each side; raises ValueError unless both are there once, agree in version and hold their own side only."""
    found = []
    for side in SIDES:
        paths = _paths(spark, f"{path}/{side}*.json")
        if len(paths) != 1:
            raise ValueError(f"{len(paths)} files of the {side} side")
        found.append(spark.read.schema(schema).json(paths).withColumn("_file", F.lit(side)))
    both = found[0].unionByName(found[1])
    state = both.agg(F.count_distinct("bank_version").alias("n"), F.count_if(~F.col("side").eqNullSafe(F.col("_file"))).alias("wrong")).first()
    if state.n > 1 or state.wrong:
        raise ValueError("the sides differ in version" if state.n > 1 else f"{state.wrong} rows of the other side")
    return both.drop("_file")


def packages(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All package files packages/<conversation>/<qa>.json with folder and file name, in a stable position for keep-first rules."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/packages/*/*.json").withColumn("position", F.input_file_name())
    return rows.withColumn("folder", F.element_at(F.split("position", "/"), -2))


def substituted(value, environment: Mapping[str, str] | None = None):
    """A configuration tree with its ${NAME} filled from the environment; an unset name raises KeyError."""
    environment = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: substituted(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, environment) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: environment[m[1]], value)
    return value


def settings(spark: SparkSession, path: str, environment: Mapping[str, str] | None = None) -> dict:
    """A YAML (or JSON) configuration file with its environment names filled."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml

        tree = yaml.safe_load(text)
    except ImportError:
        import json

        tree = json.loads(text)
    return substituted(tree, environment)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file under a path, and by ``directory_hash`` of the whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def directory_hash(hashes: DataFrame) -> str:
    """One hash of all (path, sha256), whatever order they come in; both are digests of bounded size per file."""
    named = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "sha256")
    return hashes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(named)), "\n"), 256)).first()[0]


def manifest(spark: SparkSession, run: str, inputs: dict[str, str], state: str, now: datetime | None = None) -> DataFrame:
    """One row: the run, its state, when, and the hashes of its inputs."""
    at = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return spark.createDataFrame([(run, state, at, inputs)], "run string, state string, at string, inputs map<string,string>")


@F.pandas_udf(T.BinaryType())
def encoded(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(blob: pd.Series) -> pd.Series:
    return blob.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


def fresh_vectors(cache: DataFrame, wanted: DataFrame, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(version_id, v) that the cache holds for the same text, model and dimension, and what is to be embedded anew.

    cache: version_id, fingerprint, model, dim, v; wanted: version_id, fingerprint.
    """
    valid = cache.where((F.col("model") == model) & (F.col("dim") == dim) & (F.size("v") == dim)).select("version_id", "fingerprint", "v").dropDuplicates(["version_id", "fingerprint"])
    return wanted.join(valid, ["version_id", "fingerprint"]).select("version_id", "v"), wanted.join(valid, ["version_id", "fingerprint"], "left_anti")


def compatible(vectors: DataFrame, model: str, dim: int) -> None:
    """Raises ValueError unless all stored vectors are of one model and dimension, the given ones."""
    kinds = vectors.select("dim", "model").distinct().limit(3).collect()
    if [k for k in kinds if (k.dim, k.model) != (dim, model)]:
        raise ValueError(f"stored vectors are {[tuple(k) for k in kinds]}, not {(dim, model)}")


def export(skills: DataFrame, path: str) -> None:
    """A bank by side; an existing export is never overwritten."""
    skills.write.partitionBy("side").mode("errorifexists").json(path)


def variants(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """Banks that take the new records on both sides, or on one and the old on the other."""
    of = lambda df, side: df.where(F.col("side") == side)
    return {"full": new, "access-only": of(new, "access").unionByName(of(old, "construction")), "construction-only": of(old, "access").unionByName(of(new, "construction"))}


def publish_bank(skills: DataFrame, path: str, version: int, transaction_id: str) -> None:
    """Writes the next snapshot and its transaction, then moves the pointer; a transaction that is already logged does nothing."""
    spark = skills.sparkSession
    log = f"{path}/transactions"
    if _paths(spark, log) and not spark.read.json(log).where(F.col("transaction_id") == transaction_id).isEmpty():
        return
    sinks.publish_version(skills, path, version)
    sinks.append(spark.createDataFrame([(transaction_id, version)], "transaction_id string, bank_version int"), log)


def holding(banks: DataFrame, wanted: DataFrame) -> DataFrame:
    """skill_id, version, bank_version: the latest bank that holds each wanted version; banks: bank_version, skill_id, version."""
    return wanted.select("skill_id", "version").distinct().join(banks, ["skill_id", "version"]).groupBy("skill_id", "version").agg(F.max("bank_version").alias("bank_version"))


def revised(log: DataFrame) -> DataFrame:
    """The latest revision of each candidate and how many there were; log: candidate_id, seq, more."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc("seq"))
    n = F.count("*").over(Window.partitionBy("candidate_id"))
    return log.withColumns({"revisions": n, "_n": F.row_number().over(w)}).where("_n = 1").drop("_n")


def publish_reports(reports: DataFrame, path: str) -> None:
    """Appends diagnosis reports to their sinks: progress for all, errors, and packages where there is a problem and a package.

    reports: diagnosis_id, status, problem_found, error, package.
    """
    sinks.append(reports.select("diagnosis_id", "status"), f"{path}/progress")
    sinks.append(reports.where("error IS NOT NULL").select("diagnosis_id", "error"), f"{path}/errors")
    sinks.append(reports.where("problem_found AND package IS NOT NULL").select("diagnosis_id", "package"), f"{path}/packages")


def clone(spark: SparkSession, source: str, target: str) -> int:
    """Starts a run from a published state: its current version becomes version 0 of a new, empty place; returns the version taken."""
    version = sinks.current_version(spark, source)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {source}")
    if sinks.current_version(spark, target) is not None:
        raise FileExistsError(f"{target} is in use")
    sinks.publish_version(sinks.read_current(spark, source), target, 0)
    return version


def publish_checkpoint(spark: SparkSession, partial: str, expected: DataFrame, target: str, key: str = "qa_id") -> None:
    """Makes a finished checkpoint the result: rows are complete and ordered by key, written at once, and the checkpoint goes.

    ``partial`` holds appended JSON lines; a key that was written twice counts once if the rows are equal.
    """
    rows = spark.read.json(partial).distinct()
    sinks.complete(rows, expected, key)
    sinks.create(rows.orderBy(key), target)
    at = spark._jvm.org.apache.hadoop.fs.Path(partial)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
