"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

One pass finds the spans; a value's hash is then counted over the distinct owners and
repositories (an owner's documents) of the whole corpus.  A value that several owners carry, or
that one strews over very many repositories, is a copied example; one that stays with few owners
and repositories looks live.

Plan: scan -> project (spans only) -> checkpoint -> explode -> aggregate by (hash, owner) and
then by hash, so a value in a third of all rows is one row per task before any exchange -> join
of the candidates with the counts (sort-merge, whose hot partitions AQE splits) -> aggregate by
row.  Texts are never shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, text_or_empty
from .native import let, running

# The patterns and lengths of the base.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex")
# What the method adds, by the prefixes that services give their keys.
VENDOR = (
    r"(?:gh[opsru]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{16,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
)
#: Texts without any of these parts (the first in lower case) and without a hexadecimal run hold no span.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
PARTS = ("AKIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "xox", "AIza", "k_live_", "eyJ", "-----BEGIN ")
RUN = "[0-9a-f]{24}"

#: A value that more owners, or more repositories, than this carry is an example.
MAX_LIVE_OWNERS = 2
MAX_LIVE_REPOSITORIES = 50


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, rank, end, kind, value, at, to>> of a pattern's leftmost non-overlapping matches: places in code points, and the value's in bytes."""

    def placed(hits: Column, values: Column, gaps: Column) -> Column:
        ends = lambda length: F.transform(hits, lambda h, i: length(F.get(gaps, i)) + length(h))
        before = lambda length: running(ends(length), F.lit(0), lambda a, x: a + x)

        def span(c: Column, b: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                start, value = F.get(c, i) + F.length(F.get(gaps, i)), F.get(values, i)
                end = start + F.length(h)
                to = F.get(b, i) + F.octet_length(F.get(gaps, i)) + F.octet_length(h)
                return F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"), (to - F.octet_length(value)).alias("at"), to.alias("to"))

            return F.filter(F.transform(hits, one), lambda s: F.length(s["value"]) >= least)

        return let(before(F.length), lambda c: let(before(F.octet_length), lambda b: span(c, b)))

    found = let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"), F.split(text, pattern).alias("gaps")),
        lambda m: placed(m["hits"], m["values"], m["gaps"]),
    )
    return F.when(text.rlike(pattern), found).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,value:string,at:int,to:int>>)")


def _maybe(text: Column) -> Column:
    """Whether a text may hold a span: plain searches, which cost a fraction of the patterns."""
    any_of = lambda t, parts: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in parts])
    return any_of(text, PARTS) | let(F.lower(text), lambda t: any_of(t, WORDS)) | text.rlike(RUN)


def all_spans(text: Column) -> Column:
    """Spans of all kinds by start, then in the order of the kinds (the method's last); offsets in code points, end exclusive."""
    found = F.concat(_spans(text, "assign", 0, ASSIGN, 2, MIN_ASSIGN), _spans(text, "access", 1, ACCESS, 0, 20), _spans(text, "hex", 2, HEX, 0, 24), _spans(text, "vendor", 3, VENDOR, 0, 1))
    return F.when(_maybe(text), F.array_sort(found)).otherwise(_no_spans())


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _statuses(base: DataFrame, max_live_owners: int, max_live_repositories: int) -> DataFrame:
    """row_no and, for each span of it in order, how far its value is spread; base: row_no, owner, repository, spans."""
    found = base.where(F.size("spans") > 0).select("row_no", "owner", "repository", F.posexplode("spans").alias("k", "span")).withColumn("hash", F.sha2(F.col("span.value"), 256))
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    corpus = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    live = (F.col("n_owners") <= max_live_owners) & (F.col("n_repositories") <= max_live_repositories)
    status = F.struct("k", "n_owners", "n_repositories", live.alias("live"))
    return found.select("row_no", "k", "hash").join(corpus, "hash").groupBy("row_no").agg(F.array_sort(F.collect_list(status)).alias("statuses"))


def _owner(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00")).alias("owner")


def _repository() -> Column:
    """A document of an owner is a repository; rows without doc_id are one each by their text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x00"), F.xxhash64(text_or_empty()).cast("string"))).alias("repository")


def scan_secrets(docs: DataFrame, owner: str = "source", max_live_owners: int = MAX_LIVE_OWNERS, max_live_repositories: int = MAX_LIVE_REPOSITORIES) -> DataFrame:
    """One row per row of docs (doc_id, text, an owner): row_no, doc_id, spans and statuses.

    ``statuses`` holds, for each span in order, n_owners and n_repositories of its value in the
    whole corpus and whether it looks live (at most ``max_live_owners`` distinct owners and
    ``max_live_repositories`` distinct documents; copies of one document count once).
    Null text counts as empty (no spans); a null owner counts as one owner of its own; repeated
    rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
    row_no numbers the rows of this scan, so null and repeated doc_ids stay apart.
    """
    base = saved(
        docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), _owner(owner), _repository(), all_spans(text_or_empty()).alias("spans"))
    )
    none = F.expr("cast(array() as array<struct<k:int,n_owners:bigint,n_repositories:bigint,live:boolean>>)")
    return base.join(_statuses(base, max_live_owners, max_live_repositories), "row_no", "left").select("row_no", "doc_id", "spans", F.coalesce("statuses", none).alias("statuses"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span's value replaced; values that overlap are replaced together.

    Pieces are cut by bytes, which needs no walk through the text, and joined once.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"))))

    def pieces(held: Column, s: Column, done: Column) -> Column:
        piece = lambda a, b: F.substring(held, a + 1, b - a).cast("string")
        ahead = F.transform(s, lambda x, i: F.when(x["at"] >= F.get(done, i), F.concat(piece(F.get(done, i), x["at"]), F.lit(mask))).otherwise(F.lit("")))
        last = F.greatest(F.get(done, F.size(done) - 1), F.get(s, F.size(s) - 1)["to"])
        return F.concat(F.array_join(ahead, ""), piece(last, F.octet_length(held)))

    done = lambda s: running(F.transform(s, lambda x: x["to"]), F.lit(0), lambda a, x: F.greatest(a, x))
    return let(text.cast("binary"), lambda held: let(ordered, lambda s: let(done(s), lambda d: pieces(held, s, d))))


def mask_live(docs: DataFrame, owner: str = "source", max_live_owners: int = MAX_LIVE_OWNERS, mask: str = "[SECRET]", max_live_repositories: int = MAX_LIVE_REPOSITORIES) -> DataFrame:
    """docs, all rows and columns, with the values that look live replaced by ``mask``; n_chars, if there, follows.

    Rows without a span pass unchanged (a null text stays null) and are never shuffled; one cheap
    pattern lets most of them by.  The cases are those of scan_secrets; columns of any name stay.
    """
    columns = docs.columns
    own, row_no, found, told = fresh(docs, "spans", "row_no", "row", "statuses")
    spotted = docs.withColumn(own, all_spans(text_or_empty()))
    hit = saved(spotted.where(F.size(own) > 0).withColumn(row_no, F.monotonically_increasing_id()))
    judged = _statuses(hit.select(F.col(row_no).alias("row_no"), _owner(owner), _repository(), F.col(own).alias("spans")), max_live_owners, max_live_repositories)
    both = hit.join(judged.select(F.col("row_no").alias(found), F.col("statuses").alias(told)), F.col(row_no) == F.col(found))
    live = F.filter(own, lambda s, k: F.get(F.col(told), k)["live"])
    masked = both.withColumn("text", F.when(F.size(live) > 0, _masked(F.col("text"), live, mask)).otherwise(F.col("text")))
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    quoted = [f"`{c}`" for c in columns]
    return spotted.where(F.size(own) == 0).select(*quoted).unionByName(masked.select(*quoted))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "vendor")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("statuses", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("statuses", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
