"""Equi-joins with hot keys: Bloom semi-join reduction both ways, then a split-hot-key shuffle-hash join.

Each side's keys go into a Bloom filter of fixed size, one 64-bit word per key with four bits set.
Filters merge by OR, so tasks build parts and one grouped ``bit_or`` joins them; no key is sent
anywhere.  The right filter parts the left rows, the filter of the left survivors parts the right
rows.  A row that its filter rules out has no partner for certain and goes straight to the outer
output; no exchange ever sees it.  What survives (partners, and false positives) meets in an exact
shuffle-hash join, which sends the false positives to the outer output after all.

A key with more rows than a partition's fair share is hot: its rows are dealt over several cells
by their place in the scan, and the other side's rows of that key are repeated in each of them.
At most as many keys as there are partitions can be hot, so their table is broadcast.

Two forms share these steps.  ``hot_key_join`` writes out the pairs.  ``hot_key_partners`` gives
each row of either side the number of its partners and folds over them: the partners of a key are
aggregated first, in each task before any exchange, so n rows of one side and m of the other never
become n x m rows.

Plan: three scans of each side (filter, counts, join); exchanges of filter words, of one row per
key and task, and of the surviving rows by (key, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, shuffle_width

#: 64-bit words of a filter (a power of two, 64 at least); 2^17 are 1 MB, which tells about a million keys apart.  Further keys only let more rows through to the join.
FILTER_WORDS = 1 << 17
#: Bits that a key sets in its word.
KEY_BITS = 4
#: Words that share a row of the broadcast filter.
ROW_WORDS = 64
#: The most keys that are split, and the most cells of one key and side.
MOST_HOT = 4096


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _word(key: Column, words: int) -> Column:
    return _hash(key).bitwiseAND(F.lit(words - 1))


def _bits(key: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(1, KEY_BITS + 1):
        place = F.shiftrightunsigned(_hash(key), 64 - 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def key_filter(rows: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """_row, _masks: the Bloom filter of the non-null keys of rows, ``words / 64`` rows at most; the parts of two tables merge by OR."""
    if words < ROW_WORDS or words & (words - 1):
        raise ValueError(f"words must be a power of two, {ROW_WORDS} at least: {words}")
    k = F.col(key)
    merged = rows.where(k.isNotNull()).select(_word(k, words).alias("w"), _bits(k).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    row = merged.groupBy((F.col("w") / ROW_WORDS).cast("long").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w") % ROW_WORDS, F.col("m")))).alias("by"))
    return row.select("_row", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ROW_WORDS - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long"))).alias("_masks"))


def marked(rows: DataFrame, key: str, other: DataFrame, flag: str, words: int = FILTER_WORDS) -> DataFrame:
    """rows with the column ``flag``: false where the filter ``other`` proves that no partner exists (null keys too)."""
    at = fresh(rows, "row", "masks")
    own = other.select(F.col("_row").alias(at[0]), F.col("_masks").alias(at[1]))
    k = F.col(f"`{key}`")
    mask = F.get(F.col(at[1]), (_word(k, words) % ROW_WORDS).cast("int"))
    told = rows.join(F.broadcast(own), (_word(k, words) / ROW_WORDS).cast("long") == F.col(at[0]), "left")
    return told.withColumn(flag, k.isNotNull() & F.coalesce(mask.bitwiseAND(_bits(k)) == _bits(k), F.lit(False))).drop(*at)


def _fans(spark: SparkSession, counts: DataFrame, key: str) -> DataFrame:
    """key and fan of the hot keys of counts (key, n): in how many cells its rows are dealt; at most MOST_HOT rows."""
    width = min(MOST_HOT, shuffle_width(spark))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * width > total).select(key, F.least(F.lit(MOST_HOT), F.ceil(2 * F.col("n") * width / F.lit(max(1, total)))).cast("int").alias("fan"))
    found = hot.collect()  # fewer than width rows: each has more than a width-th of all
    return spark.createDataFrame(found, hot.schema)


def _dealt(rows: DataFrame, key: str, own: DataFrame, other: DataFrame, cells: tuple[str, str]) -> DataFrame:
    """rows, each in one cell of its own fan and repeated over the other side's; cells: names of the own and the other coordinate."""
    a, b, k1, k2 = fresh(rows, "a", "b", "k1", "k2")
    k = F.col(f"`{key}`")
    wide = rows.withColumn(cells[0], F.monotonically_increasing_id())
    wide = wide.join(F.broadcast(own.select(F.col(key).alias(k1), F.col("fan").alias(a))), k == F.col(k1), "left")
    wide = wide.join(F.broadcast(other.select(F.col(key).alias(k2), F.col("fan").alias(b))), k == F.col(k2), "left")
    wide = wide.withColumn(cells[0], F.pmod(F.xxhash64(cells[0]), F.coalesce(F.col(a), F.lit(1))).cast("int"))
    return wide.withColumn(cells[1], F.explode(F.sequence(F.lit(0), F.coalesce(F.col(b), F.lit(1)) - 1))).drop(a, b, k1, k2)


def _no_fans(fans: DataFrame) -> DataFrame:
    return fans.sparkSession.createDataFrame([], fans.schema)


def with_summary(rows: DataFrame, summary: DataFrame, key: str, fans: DataFrame) -> DataFrame:
    """rows left-joined to the one row per key of ``summary`` by a shuffle-hash join; rows of the keys in ``fans`` are dealt over cells in which their summary is repeated."""
    s, _ = cells = fresh(rows, "cell", "one")
    dealt = _dealt(rows, key, fans, _no_fans(fans), cells).drop(cells[1])
    kept = [c for c in summary.columns if c != key]
    other, fan, cell = fresh(rows, "summary_key", "fan", "summary_cell")
    spread = summary.join(F.broadcast(fans.select(F.col(key).alias(other), F.col("fan").alias(fan))), F.col(key) == F.col(other), "left")
    spread = spread.withColumn(cell, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(fan), F.lit(1)) - 1))).select(F.col(key).alias(other), cell, *kept)
    return dealt.join(spread.hint("shuffle_hash"), (F.col(f"`{key}`") == F.col(other)) & (F.col(s) == F.col(cell)), "left").drop(other, cell, s)


def _reduced(left: DataFrame, right: DataFrame, key: str, flag: str, words: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``flag``, false where a row can go to the outer output at once."""
    left = marked(left, key, saved(key_filter(right, key, words)), flag, words)
    return left, marked(right, key, saved(key_filter(left.where(flag), key, words)), flag, words)


def _counts(rows: DataFrame, key: str, folds: dict[str, Column] | None = None) -> DataFrame:
    return saved(rows.groupBy(key).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in (folds or {}).items()]))


def hot_key_partners(left: DataFrame, right: DataFrame, key: str, of_left: dict[str, Column], of_right: dict[str, Column], words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """(left, right), each row once, with n_partners and folds over its partners in the full outer join on ``key``.

    ``of_right`` are aggregates of right columns that left rows get, ``of_left`` those that right
    rows get.  Rows without a partner have n_partners 0 and null folds; a null key matches nothing;
    repeated rows all count; empty tables give empty results.  Names of the two sides may clash
    with each other, but not with n_partners and the folds.
    """
    flag = max(fresh(left, "may")[0], fresh(right, "may")[0], key=len)  # clashes with neither
    lefts, rights = _reduced(left, right, key, flag, words)
    counted = {"l": _counts(lefts.where(flag), key, of_left), "r": _counts(rights.where(flag), key, of_right)}

    def told(rows: DataFrame, own: DataFrame, partners: DataFrame, folds: dict[str, Column]) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in rows.columns if c != flag]
        kinds = {f.name: f.dataType for f in partners.schema.fields}
        alone = rows.where(~F.col(flag)).select(*columns, F.lit(0).cast("long").alias("n_partners"), *[F.lit(None).cast(kinds[name]).alias(name) for name in folds])
        met = with_summary(rows.where(flag), partners.withColumnRenamed("n", "n_partners"), key, _fans(rows.sparkSession, own, key))
        return alone.unionByName(met.select(*columns, F.coalesce("n_partners", F.lit(0).cast("long")).alias("n_partners"), *folds))

    return told(lefts, counted["l"], counted["r"], of_right), told(rights, counted["r"], counted["l"], of_left)


def hot_key_join(left: DataFrame, right: DataFrame, key: str, how: str = "full", words: int = FILTER_WORDS) -> DataFrame:
    """left, right: the joined rows as two structs, null where a row has no partner; how: inner, left or full.

    A key that is hot on either side is dealt over a grid of cells (own rows over one coordinate,
    repeated over the other), so every pair meets in exactly one cell.  A hot key has rows on its
    side for certain, so the other side's rows of it have partners and a repeated row that finds
    none in its cell is dropped.  Null keys match nothing; repeated rows all take part; clashing
    names do no harm; empty tables are allowed.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"how: {how}")
    spark = left.sparkSession
    packed = lambda df, name: df.select(F.col(f"`{key}`").alias("k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    lefts, rights = _reduced(packed(left, "left"), packed(right, "right"), "k", "may", words)
    a, b = (_fans(spark, _counts(x.where("may"), "k"), "k") for x in (lefts, rights))
    dealt_left = _dealt(lefts.where("may").drop("may"), "k", a, b, ("u", "v")).select("k", "u", "v", "left")
    dealt_right = _dealt(rights.where("may").drop("may"), "k", b, a, ("v", "u")).select(F.col("k").alias("k2"), F.col("u").alias("u2"), F.col("v").alias("v2"), "right")
    met = dealt_left.join(dealt_right.hint("shuffle_hash"), (F.col("k") == F.col("k2")) & (F.col("u") == F.col("u2")) & (F.col("v") == F.col("v2")), {"full": "full"}.get(how, how))
    if how != "inner":
        only_left, only_right = F.col("right").isNull(), F.col("left").isNull()
        met = met.join(F.broadcast(b.select(F.col("k").alias("kb"), F.lit(True).alias("hot_right"))), F.col("k") == F.col("kb"), "left")
        met = met.join(F.broadcast(a.select(F.col("k").alias("ka"), F.lit(True).alias("hot_left"))), F.col("k2") == F.col("ka"), "left")
        met = met.where(~(only_left & F.col("hot_right").isNotNull()) & ~(only_right & F.col("hot_left").isNotNull()))
    out = met.select("left", "right")
    if how in ("left", "full"):
        out = out.unionByName(lefts.where("not may").select("left", F.lit(None).cast(out.schema["right"].dataType).alias("right")))
    if how == "full":
        out = out.unionByName(rights.where("not may").select(F.lit(None).cast(out.schema["left"].dataType).alias("left"), "right"))
    return out


def digest(clicks: DataFrame, sales: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows of the registered query: for each id of either table, its rows in the joins and the sum of its partners' checksums.

    Of copies of one id that differ in client_id (there are none in the tables) the least is shown.
    """

    def sided(rows: DataFrame, number: str, amount: str) -> DataFrame:
        digits = F.col(number).cast("string")
        h = F.crc32(digits.cast("binary"))
        cents = F.floor(F.lit(100.0) * F.col(amount) + F.lit(0.5)).cast("long").cast("string")
        client = F.when(h % 10 < 2, F.floor(h / 10) % 3).otherwise(F.col("client_id")).cast("long")
        return rows.select(F.col(number).cast("long").alias("id"), client.alias("client_id"), F.crc32(F.concat(digits, F.lit(":"), F.coalesce(cents, F.lit(""))).cast("binary")).alias("crc"))

    def by_id(rows: DataFrame, side: str) -> DataFrame:
        n, zero = F.col("n_partners"), F.lit(0).cast("long")
        full = F.greatest(n, F.lit(1).cast("long"))
        sums = rows.groupBy("id").agg(
            F.min("client_id").alias("client_id"), F.count("*").alias("copies"), F.sum(n).alias("inner_rows"), F.sum(full).alias("full_rows"), F.sum(F.coalesce("partner_crc", zero)).alias("partner_crc")
        )
        return sums.select(F.lit(side).alias("side"), "id", "client_id", "copies", "inner_rows", F.col("full_rows" if side == "click" else "inner_rows").alias("left_rows"), "full_rows", "partner_crc")

    crc = {"partner_crc": F.sum("crc")}
    left, right = hot_key_partners(sided(clicks, "click_id", "value"), sided(sales, "sale_id", "total"), "client_id", crc, crc, words)
    return by_id(left.drop("crc"), "click").unionByName(by_id(right.drop("crc"), "sale"))
