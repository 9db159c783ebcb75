"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is an expression of the text that is true where the rule rejects.  A bounded sample
gives each rule's cost (time to evaluate, read in the tasks) and selectivity (share rejected); the rules are then
tried in the order of rejection per cost inside one CASE, so a row that an early rule rejects
never pays for a later one.  The order changes the cost only: a document is kept if no rule
rejects it, whatever the order.

Plan: scan -> project -> (filter), no exchange, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .native import SPACE, let, words

SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 400
SAMPLE_PARTS, ROUNDS = 4, 5

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # per cent of the words that stand in repeated 3-word windows
MAX_SYMBOLS_SHARE = 30  # symbols per 100 words
MAX_DUP_LINES_SHARE = 40  # per cent of the lines that have a word
MAX_UPPER_SHARE = 50  # per cent of the letters
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 20  # mean characters of a word
MIN_LETTER_SHARE = 50  # per cent of the characters in words


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS + "+", ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))


def n_dup_lines(of_lines: Column) -> Column:
    return (F.size(of_lines) - F.size(F.array_distinct(of_lines))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Each window becomes one long: hash bits above, its position below.  After a sort equal
    windows are neighbours; neighbours with equal hash bits are compared word by word.
    """

    def packed(bits: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
        )

    def marked(s: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        position = lambda x: x.bitwiseAND(mask).cast("int")

        def same(x: Column, y: Column) -> Column:
            close = F.call_function("shiftrightunsigned", x, bits) == F.call_function("shiftrightunsigned", y, bits)
            equal = [F.get(w, position(x) + k) == F.get(w, position(y) + k) for k in range(3)]
            return F.coalesce(close & equal[0] & equal[1] & equal[2], F.lit(False))

        found = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | (F.when(j > 0, same(x, F.get(s, j - 1))).otherwise(F.lit(False))))
        return F.sort_array(F.transform(found, position))

    def covered(r: Column) -> Column:
        steps = F.transform(r, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(r, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    counted = let(F.length(F.bin(F.size(w).cast("long"))), lambda bits: let(F.sort_array(packed(bits)), lambda s: let(marked(s, bits), covered)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(counted)


def base_failed(n: Column, repeats: Column) -> Column:
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_SHARE * n)


#: Rules of the verdict beside the base ones: name to an expression of the text, true where it rejects.
METHOD_RULES: dict[str, Callable[[Column], Column]] = {
    "symbols": lambda t: let(F.size(words(t)), lambda n: 100 * n_symbols(t) > MAX_SYMBOLS_SHARE * n),
    "duplicate_lines": lambda t: let(lines(t), lambda x: 100 * n_dup_lines(x) > MAX_DUP_LINES_SHARE * F.size(x)),
    "upper_case": lambda t: let(
        F.regexp_replace(t, r"[^\p{L}]+", ""), lambda x: 100 * F.length(F.regexp_replace(x, r"[^\p{Lu}]+", "")) > MAX_UPPER_SHARE * F.length(x)
    ),
    "word_length": lambda t: let(
        F.struct(word_chars(t).alias("c"), F.size(words(t)).alias("n")),
        lambda x: (x["c"] < MIN_WORD_CHARS * x["n"]) | (x["c"] > MAX_WORD_CHARS * x["n"]),
    ),
    "letters": lambda t: 100 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < MIN_LETTER_SHARE * word_chars(t),
}
BASE_RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda t: F.size(words(t)) < MIN_WORDS,
    "repeated_words": lambda t: let(words(t), lambda w: 100 * n_repeat_words(w) > MAX_REPEAT_SHARE * F.size(w)),
}


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[Column], Column]], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by rejections per cost, most first, as a sample of about ``sample_rows`` texts tells them.

    The sample is drawn in every partition of the scan at the rate that its size needs; only the
    drawn rows are then dealt to few tasks.  A rule's cost is the time between two readings of the
    clock around it, taken in the task for each text, the least of ROUNDS readings: neither jobs
    and tasks nor other work on the machine enter it.  Costs count in doublings of the cheapest
    rule's, so that small differences don't turn the order.
    """
    texts = docs.select(text_or_empty().alias("text"))
    n = texts.count()
    if not n:
        return sorted(rules)
    sample = saved(texts.sample(min(1.0, sample_rows / n), seed=1).repartition(SAMPLE_PARTS).withColumn("row", F.monotonically_increasing_id()))
    rounds = sample.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")

    rejected, cost, rows = {}, {}, 0
    for name, rule in rules.items():
        read = rounds.select("row", F.struct(clock().alias("a"), F.coalesce(rule(F.col("text")), F.lit(False)).alias("hit"), clock().alias("b")).alias("x"))
        least = read.groupBy("row").agg(F.min(F.col("x.b") - F.col("x.a")).alias("t"), F.max("x.hit").alias("hit"))
        rows, rejected[name], cost[name] = least.agg(F.count("*"), F.coalesce(F.count_if("hit"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    cheapest = max(1, min(cost.values()))
    score = {name: (rejected[name] + 1) / (rows + 2) / 2 ** round(math.log2(max(1.0, cost[name] / cheapest))) for name in rules}
    return sorted(rules, key=lambda name: (-score[name], name))


def verdict(text: Column, rules: dict[str, Callable[[Column], Column]], order: list[str]) -> Column:
    """True where no rule rejects; rules are tried in the given order and the first rejection ends it."""
    out = F.lit(True)
    for name in reversed(order):
        out = F.when(rules[name](text), F.lit(False)).otherwise(out)
    return out


def keep_good(docs: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    Null and empty texts have no words and are rejected by the word count; an empty table stays
    empty; repeated rows get the same verdict.
    """
    rules = {**BASE_RULES, **METHOD_RULES} if rules is None else rules
    return docs.where(verdict(text_or_empty(), rules, cascade_order(docs, rules, sample_rows)))


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the measures of the base rules and the verdict of every row of docs (doc_id, text).

    Null text counts as empty: all measures 0, base_failed true, kept false.  A null doc_id stays
    null; repeated rows are measured each for itself; an empty table gives no rows; other columns
    are ignored.
    """
    order = cascade_order(docs, METHOD_RULES, sample_rows)
    measured = docs.select(F.col("doc_id"), text_or_empty().alias("text")).select(
        "doc_id",
        "text",
        let(
            words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words"))
        ).alias("m"),
        n_symbols(F.col("text")).alias("n_symbols"),
        let(lines(F.col("text")), n_dup_lines).alias("n_dup_lines"),
    )
    failed = measured.select("doc_id", "text", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words").withColumn(
        "base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))
    )
    return failed.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(F.col("text"), METHOD_RULES, order))).drop("text")
