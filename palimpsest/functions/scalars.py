"""Scalar helpers: ids, hashes, bounded numbers, tolerant JSON, vectors, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time formats of conversation logs, tried in order.
TIME_FORMATS = ("h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy-MM", "d MMMM, yyyy", "MMMM d, yyyy")
SOURCE_PREFIX, EXTERNAL_PREFIX = "source:", "mem0:"


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def stable_hash(fields: dict[str, Column]) -> Column:
    """A digest of a record that does not depend on the order of its fields."""
    return content_hash(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])))


def reference_answer(reference: Column, answer: Column) -> Column:
    """The reference unless it is empty, else the answer, else the empty reference; a row with neither raises."""
    chosen = F.coalesce(F.nullif(F.trim(reference), F.lit("")), answer, reference)
    return F.when(chosen.isNull(), F.raise_error(F.lit("neither reference nor answer")).cast("string")).otherwise(chosen)


def message_id(conversation: Column, session: Column, turn: Column) -> Column:
    return F.format_string("%s_s%02d_m%03d", conversation.cast("string"), session.cast("long"), turn.cast("long"))


def parsed_message_id(message: Column) -> Column:
    """struct(conversation, session, turn) of a made message id, nulls where it is none."""
    part = lambda k: F.nullif(F.regexp_extract(message, r"^(.*)_s(\d+)_m(\d+)$", k), F.lit(""))
    return F.struct(part(1).alias("conversation"), part(2).try_cast("int").alias("session"), part(3).try_cast("int").alias("turn"))


def id_kind(evidence: Column) -> Column:
    return F.when(evidence.startswith(SOURCE_PREFIX), "source").when(evidence.startswith(EXTERNAL_PREFIX), "external").otherwise("version")


def bare_id(evidence: Column) -> Column:
    return F.regexp_replace(evidence, f"^({SOURCE_PREFIX}|{EXTERNAL_PREFIX})", "")


def without_version(skill: Column) -> Column:
    return F.split(skill, "_v")[0]


def conversation_of(qa: Column) -> Column:
    return F.substring_index(qa, "_", 1)


def bounded(value: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull(), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), number)))


def optional_text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def json_array(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def json_object_text(reply: Column) -> Column:
    """The JSON object in a reply: a fenced block's if there is one, else from the first { to the last }."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.coalesce(F.nullif(fenced, F.lit("")), F.regexp_extract(reply, r"(?s)\{.*\}", 0)), F.lit(""))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with its {named} places filled; other braces stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def clean_list(values: Column, limit: int) -> Column:
    """Trimmed, without empty ones, first occurrences, at most ``limit``."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")), 1, limit)


def score_label(score: Column) -> Column:
    return F.when(score >= 4, "C").when(score == 3, "P").when(score <= 2, "I")


def parsed_label(label: Column, allowed: tuple[str, ...]) -> Column:
    upper = F.upper(F.trim(label))
    return F.when(upper.isin(*allowed), upper).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null")))).cast("string"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise(F.lit("n/a"))


def timestamp(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def clipped(text: Column, chars: int = 320) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


def recovery_query(question: Column, contents: Column) -> Column:
    """The text that routes after a first search: the question and what its hits say, without ids and scores; blank hits count but are not shown."""
    shown = F.filter(F.transform(F.coalesce(contents, F.array().cast("array<string>")), lambda x: clipped(F.coalesce(x, F.lit("")))), lambda x: x != "")
    lines = F.when(F.size(shown) == 0, F.array(F.lit("(none)"))).otherwise(shown)
    head = F.concat(F.lit("Question: "), F.trim(F.coalesce(question, F.lit(""))), F.lit("\nFirst retrieval returned "), F.coalesce(F.size(contents), F.lit(0)).cast("string"), F.lit(" memories.\nReturned memory contents:\n"))
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))


def session_text(turns: Column) -> Column:
    """A session's turns (speaker, content), in order, a line each; a missing speaker is unknown."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(F.nullif(t["speaker"], F.lit("")), F.lit("unknown")), F.lit(": "), F.coalesce(t["content"], F.lit("")))), "\n")


def reference_or_answer(reference: Column, answer: Column) -> Column:
    """The reference unless it is empty, else the answer, else the empty reference; null if a row has neither, which ``require`` turns into an error."""
    return F.coalesce(F.nullif(reference, F.lit("")), answer, reference)


def require(value: Column, message: str) -> Column:
    """The value; a null raises when the row is read."""
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def first_problem(checks: list[tuple[Column, str]], fine: str = "ok") -> Column:
    """The name of the first check that holds; an unknown outcome does not hold."""
    out = F.lit(fine)
    for bad, name in reversed(checks):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    length = F.array(F.greatest(norm(v), F.lit(1e-12)))  # taken once, not for each place
    return F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))))
