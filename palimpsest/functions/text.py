"""Tokenizers, answer normalising and token scores, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import porter

# The lexical stop words, the token patterns and ASCII punctuation.
STOP_WORDS = (
    "a an and are as at be been but by did do does for from had has have he her hers him his how i in is it its "
    "me my of on or our she that the their them they this to was we were what when where which who why with would you your"
).split()
LEXICAL = r"[A-Za-z0-9]+(?:['_-][A-Za-z0-9]+)*|[㐀-䶿一-鿿]"
SIMPLE = r"[a-z0-9_]+|[㐀-鿿]"
ALNUM = r"[a-z0-9]+"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
REFUSALS = ("no information available", "not mentioned")


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Words with inner ' _ - joins or single CJK characters, lower-cased, without stop words; not stemmed."""
    return F.filter(F.transform(_found(text, LEXICAL), F.lower), lambda t: ~t.isin(STOP_WORDS))


def simple_tokens(text: Column) -> Column:
    return _found(F.lower(text), SIMPLE)


def set_tokens(text: Column) -> Column:
    return F.array_distinct(_found(F.lower(text), ALNUM))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pa.Array) -> pa.Array:
    """Each plain English token's stem; tokens with digits, joins or other scripts stay.

    The words stay in Arrow; Python meets each distinct word of a batch once.
    """
    words = tokens.flatten().dictionary_encode()
    known = pa.array([porter.stem(t) if t is not None and t.isascii() and t.isalpha() else t for t in words.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), known.take(words.indices))


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and "and"; single spaces."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the|and)\b", " "), r"(?U)\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.array_remove(F.split(normalize_answer(text), " "), "")


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))


def token_f1(predicted: Column, reference: Column) -> Column:
    """Multiset token F1: 1 if both are empty, 0 if one is."""
    same, p, r = shared_count(predicted, reference), F.size(predicted), F.size(reference)
    score = F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (p + r))
    return F.when((p == 0) & (r == 0), F.lit(1.0)).when((p == 0) | (r == 0), F.lit(0.0)).otherwise(score)


def answer_f1(prediction: Column, reference: Column, category: Column | None = None, stem: bool = True) -> Column:
    """Category-aware score of an answer.

    5: 1 if the prediction refuses; 3: the reference before the first semicolon; 1: mean over the
    comma parts of the reference of the best part of the prediction; else plain token F1.
    """
    single = (lambda p, r: _stemmed_parts(normalize_answer(p), normalize_answer(r))) if stem else (lambda p, r: token_f1(answer_tokens(p), answer_tokens(r)))
    plain = single(prediction, reference)
    if category is None:
        return plain
    lowered = F.lower(F.coalesce(prediction, F.lit("")))
    refusal = F.when(F.greatest(*[lowered.contains(x) for x in REFUSALS]), F.lit(1.0)).otherwise(F.lit(0.0))
    first = F.trim(F.split(F.coalesce(reference, F.lit("")), ";")[0])
    return (
        F.when(category == 5, refusal)
        .when(category == 3, single(prediction, first))
        .when(category == 1, _parts_f1(prediction, reference, stem))
        .otherwise(plain)
    )


@F.pandas_udf(T.DoubleType())
def _stemmed_parts(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """Mean over the reference's parts of the best stemmed F1; normalised parts arrive joined by a unit separator."""
    from collections import Counter

    def single(p: str, r: str) -> float:
        a, b = ([porter.stem(w) for w in x.split()] for x in (p, r))
        if not a or not b:
            return float(not a and not b)
        return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))

    return pd.Series([sum(max(single(p, r) for p in ps.split("\x1f")) for r in rs.split("\x1f")) / len(rs.split("\x1f")) for ps, rs in zip(prediction, reference, strict=True)], dtype="float64")


def _parts_f1(prediction: Column, reference: Column, stem: bool) -> Column:
    parts = lambda t: F.split(F.coalesce(t, F.lit("")), ",")
    if stem:
        flat = lambda t: F.array_join(F.transform(parts(t), normalize_answer), "\x1f")
        return _stemmed_parts(flat(prediction), flat(reference))
    scores = F.transform(
        parts(reference), lambda r: F.array_max(F.transform(parts(prediction), lambda p: token_f1(answer_tokens(p), answer_tokens(r))))
    )
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
