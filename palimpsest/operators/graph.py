"""Operators on graphs and between snapshots."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of a task's forest; about 200 bytes each.
FOREST_NODES = 500_000
#: Rows of a narrow table that a task sorts or groups.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine (tests) a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a folder of one machine would lose tables with its executor")
    return (at or "/tmp/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage: written as a table to the shared folder and read from there.

    A scan of files knows its size (a checkpoint keeps the size that its plan was estimated at,
    which joins in a loop multiply until planning takes all memory), reads only the columns it
    needs, and is lost with no executor.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to a task for every TASK_ROWS of ``rows``, so that what a task sorts or groups does not grow with the input; a single task's rows are left to the planner.

    Grouping after it has no partial sums before the exchange, which keys that hardly repeat only pay for.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > 1 else df


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node with the least node that its edges here tie it to (union-find).

    After FOREST_NODES nodes the stars are handed on and a new forest begins, so a task's memory
    does not grow with its edges; the rounds join what lies in several forests.
    """
    above: dict = {}

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = iter(above)
        while some := list(itertools.islice(nodes, 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array(some, types[0]), pa.array([root(x) for x in some], types[1])], names=["u", "v"])

    types = None
    for batch in batches:
        types = [f.type for f in batch.schema]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) >= FOREST_NODES:
            yield from stars()
            above.clear()
    yield from stars()


def _settled(stars: DataFrame, rows: int) -> bool:
    """Whether every node has one least node, which has none itself: then each star is a whole component."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return dealt(ends, rows, "node").groupBy("node").agg(F.sum("below").alias("b"), F.max("above").alias("a")).where("b > 1 OR (b > 0 AND a > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node) for edges a, b; a node tied to itself alone is its own root.

    Each task first turns its edges into stars of its own, so at most one row per node and task is
    exchanged.  Then every node hands its least neighbour to its larger neighbours (large star)
    and to its smaller ones (small star), which are grouped minima and equi-joins, so the
    neighbours of a hub never meet in one task; the rounds grow with the logarithm of what the
    tasks left of the diameter.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    pair = "u", "v"
    stars = cut(pairs.mapInArrow(_forest, f"u {kind}, v {kind}"))
    stars = cut(dealt(stars, stars.count(), *pair).distinct())
    rows = stars.count()
    now = stars.where("u <> v")
    while not _settled(now, rows):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = dealt(both, rows, "u").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = dealt(both.where("v > u"), rows, "u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(dealt(large, rows, *pair).distinct())
        first = dealt(large, rows, "u").groupBy("u").agg(F.min("v").alias("m"))
        small = dealt(large, rows, "u").join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(first.select("u", F.col("m").alias("v")))
        now = cut(dealt(small, rows, *pair).distinct())
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    every = dealt(stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))), rows, "node").distinct()
    return dealt(every, rows, "node").join(dealt(ends, rows, "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, state (new, changed or tombstone) of the rows in which two snapshots differ."""
    a = old.select(key, F.struct(*values).alias("_old"))
    b = new.select(key, F.struct(*values).alias("_new"))
    state = F.when(F.col("_new").isNull(), "tombstone").when(F.col("_old").isNull(), "new").otherwise("changed")
    return a.join(b, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, state.alias("state"))
