"""URL filters: allow and block rules on host and path prefixes, by a sort-merge range join.

A rule's key is its host with the labels reversed (``com.example.``), a separator and its path.
A url is probed once for each suffix of its host, with that suffix's key and the whole path, so
a rule fits exactly when its key is a prefix of a probe's key: rules are intervals of the key
order.  A sweep over both sides in key order keeps the rules that contain the current key on a
stack; its top is the longest.

* Up to ``BROADCAST_RULES`` rules of ``BROADCAST_BYTES`` (counted first): every task sorts the
  probes of its own rows and sweeps them against the sorted rules.  No exchange of pages.
* More rules: probes and rules are range-partitioned by key together and swept in place; the
  rules still open at the end of a partition (at most one per prefix of a key) are carried to
  the next.  Equal probes are merged before the sort, so a url that a third of all rows share
  is one probe.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved, slices

BROADCAST_RULES = 200_000
BROADCAST_BYTES = 32_000_000
SEPARATOR = "\x00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # key, rule text, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." + SEPARATOR


def suffixes(host: str) -> Iterator[str]:
    """The host, its parent domain and so on."""
    while host:
        yield host
        _, _, host = host.partition(".")


def sweep(probes: Iterable[str], rules: list[Rule], stack: list[Rule] | None = None) -> Iterator[Rule | None]:
    """For each probe key, in order, the longest rule whose key is a prefix of it; rules in order of their keys."""
    stack = [] if stack is None else stack
    at = 0
    for key in probes:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        yield stack[-1] if stack else None


def _rank(rule: Rule) -> tuple[int, int, str]:
    """Longest rule text first; of equal length the longer host, then the text."""
    return len(rule[1]), rule[1].find("/") if "/" in rule[1] else len(rule[1]), rule[1]


def _judged_by_task(pages: DataFrame, rules: list[Rule], default: str, columns: str) -> DataFrame:
    hosts = {r[0].partition(SEPARATOR)[0] for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            probes: dict[str, list[int]] = {}
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            for row, (host, path) in enumerate(pairs):
                for suffix in suffixes(host):
                    key = host_key(suffix)
                    if key[:-1] in hosts:
                        probes.setdefault(key + path, []).append(row)
            found: list[Rule | None] = [None] * batch.num_rows
            ordered = sorted(probes)
            for key, rule in zip(ordered, sweep(ordered, rules), strict=True):
                if rule:
                    for row in probes[key]:
                        if found[row] is None or _rank(rule) > _rank(found[row]):
                            found[row] = rule
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r[1] for r in found], pa.string()), pa.array([r[2] if r else default for r in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return mapped(pages, run, f"{columns}, rule string, verdict string")


def _judged_by_ranges(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The sweep over range partitions, for rule sets of any size."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            rows = [(h, p, host_key(s) + p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in suffixes(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["host", "path", "key"])

    targets = pages.select("host", "path").distinct()
    probes = mapped(targets, exploded, "host string, path string, key string").join(
        rules.select(F.split("key", SEPARATOR)[0].alias("rule_host")).distinct(), F.split("key", SEPARATOR)[0] == F.col("rule_host"), "left_semi"
    )
    both = rules.select(
        "key", F.lit(0).alias("side"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.col("rule"), F.col("verdict")
    ).unionByName(probes.select("key", F.lit(1).alias("side"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))
    # A host and path lie with their key so that equal keys of different probes can be dealt out.
    ranged = saved(both.repartitionByRange("key", "side", "host", "path").sortWithinPartitions("key", "side", "host", "path"))

    def passed(batches: Iterator[pa.RecordBatch], stack: list[Rule]) -> Iterator[tuple[str, str, Rule | None]]:
        for batch in slices(batches, 8192):
            for key, side, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if side == 0:
                    stack.append((key, rule, verdict))
                else:
                    yield host, path, stack[-1] if stack else None

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Rule] = []
        last = ""
        for batch in slices(batches, 8192):
            keys = batch.column("key").to_pylist()
            for _ in passed(iter([batch]), stack):
                pass
            last = keys[-1] if keys else last
        opened = [*stack] or [(last, None, None)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()] * len(opened), pa.int32()), pa.array([last] * len(opened), pa.string()), *(pa.array([o[k] for o in opened], pa.string()) for k in range(3))],
            names=["part", "last", "key", "rule", "verdict"],
        )

    # One row per partition and open rule: at most as many as a key has prefixes.
    ends: dict[int, tuple[str, list[Rule]]] = {}
    for part, last, key, rule, verdict in mapped(ranged, edges, "part int, last string, key string, rule string, verdict string").collect():
        ends.setdefault(part, (last, []))[1].extend([(key, rule, verdict)] if rule is not None else [])
    carried: dict[int, list[Rule]] = {}
    stack: list[Rule] = []
    for part in sorted(ends):
        carried[part] = stack
        last, opened = ends[part]
        stack = [r for r in stack if last.startswith(r[0])] + sorted(opened, key=lambda r: len(r[0])) if last else stack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(h, p, r) for h, p, r in passed(batches, [*carried.get(TaskContext.get().partitionId(), [])]) if r]
        for at in range(0, len(rows), 8192):
            some = rows[at : at + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some]), pa.array([x[1] for x in some]), pa.array([x[2][1] for x in some]), pa.array([x[2][2] for x in some])], names=["host", "path", "rule", "verdict"]
            )

    found = mapped(ranged, run, "host string, path string, rule string, verdict string")
    rank = F.struct(F.length("rule").alias("n"), F.when(F.col("rule").contains("/"), F.expr("locate('/', rule) - 1")).otherwise(F.length("rule")).alias("h"), F.col("rule").alias("r"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return (
        pages.join(best, ["host", "path"], "left")
        .withColumn("rule", F.col("best.rule"))
        .withColumn("verdict", F.coalesce("best.verdict", F.lit(default)))
        .drop("best")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    rules: host, path, verdict.  A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest rule text (host and path) wins, of equal length the one
    with the longer host.  Rules with a null or empty host fit nothing; of rules with one host
    and path the smallest verdict counts ("allow" before "block").  Urls that no rule fits, null
    urls and urls without ``://`` get ``default`` and a null rule.  Repeated page_ids are judged
    each for itself, other columns are ignored, empty tables give empty results.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    reverse = F.concat(F.concat_ws(".", F.reverse(F.split("host", r"\."))), F.lit("." + SEPARATOR), F.col("path"))
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(reverse.alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    )
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("rule") + 100), F.lit(0))).first()
    if n <= broadcast_rules and size <= broadcast_bytes:
        held = sorted(map(tuple, rules.collect()))
        return _judged_by_task(pages, held, default, "page_id long, host string, path string")
    return _judged_by_ranges(pages, rules, default).select("page_id", "host", "path", "rule", "verdict")
