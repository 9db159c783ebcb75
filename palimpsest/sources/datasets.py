"""Scans of conversation datasets in three JSON layouts, to messages and questions.

Every loader gives two DataFrames: messages (conversation_id, session_id, session_index,
session_time, turn, message_id, role, speaker, content, occurred_at) and questions (qa_id,
conversation_id, question, reference, category, evidence: array of struct(session_id,
message_id)).  JSON of varying shape is read as text or variant-free maps, so no inference pass
decides the types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN = "array<struct<speaker:string,text:string,dia_id:string>>"
QA = "array<struct<question:string,answer:string,category:string,evidence:array<string>>>"
HAYSTACK = "question_id string, question string, answer string, question_type string, haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>"
MESSAGE = "struct<message_id:string,role:string,content:string,time:string>"
SESSION = f"struct<session_id:string,time:string,messages:array<{MESSAGE}>>"
FILE_QA = "struct<qa_id:string,question:string,answer:string,type:string>"


def layout(spark: SparkSession, path: str) -> str:
    """"files" for a folder of conversation files, "sessions" for samples with a conversation and qa, else "haystack"."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return "files"
    columns = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).columns
    return "sessions" if {"conversation", "qa"} <= set(columns) else "haystack"


def _objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_sessions_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples whose conversation holds session_<n> and session_<n>_date_time keys.

    Sessions come in the order of their numbers, the first speaker is the user, ids carry the
    conversation's name, a category that is no whole number is null.
    """
    raw = _objects(spark, path, "sample_id string, conversation string, qa string").withColumn("_n", F.monotonically_increasing_id())
    # Only samples without a name need their place in the file.
    at = F.row_number().over(Window.orderBy("_n")) - 1
    samples = raw.withColumn("conversation_id", F.coalesce("sample_id", F.concat(F.lit("conv_"), at.cast("string")))).withColumn("c", F.from_json("conversation", "map<string,string>"))
    entries = samples.select("conversation_id", "c", F.explode(F.map_entries("c")).alias("e"))
    number = F.nullif(F.regexp_extract("e.key", r"^session_(\d+)$", 1), F.lit("")).cast("int")
    sessions = entries.select("conversation_id", "c", number.alias("n"), F.from_json("e.value", TURN).alias("turns")).where("n IS NOT NULL AND turns IS NOT NULL")
    turns = sessions.select(
        "conversation_id",
        F.format_string("%s_s%02d", "conversation_id", "n").alias("session_id"),
        F.col("n").alias("session_index"),
        F.element_at("c", F.concat(F.lit("session_"), F.col("n").cast("string"), F.lit("_date_time"))).alias("session_time"),
        F.element_at("c", F.lit("speaker_a")).alias("first"),
        F.posexplode("turns").alias("turn", "m"),
    )
    speaker = F.coalesce("m.speaker", F.lit("unknown"))
    local = F.coalesce("m.dia_id", F.format_string("s%02d_m%03d", "session_index", "turn"))
    messages = turns.select(
        "conversation_id", "session_id", "session_index", "session_time", "turn", F.concat_ws(":", "conversation_id", local).alias("message_id"),
        F.when(speaker == F.col("first"), "user").otherwise("assistant").alias("role"), speaker.alias("speaker"), F.coalesce("m.text", F.lit("")).alias("content"), F.col("session_time").alias("occurred_at"),
    )
    asked = samples.select("conversation_id", F.posexplode(F.from_json("qa", QA)).alias("k", "q"))
    ids = F.transform(F.filter(F.coalesce("q.evidence", F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.struct(F.lit("").alias("session_id"), F.concat_ws(":", "conversation_id", x).alias("message_id")))
    questions = asked.select(
        F.format_string("%s_qa_%04d", "conversation_id", "k").alias("qa_id"), "conversation_id", F.coalesce("q.question", F.lit("")).alias("question"), F.coalesce("q.answer", F.lit("")).alias("reference"),
        F.col("q.category").try_cast("int").alias("category"), ids.alias("evidence"),
    )
    return messages, questions


def read_haystack_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One question per row with its sessions' ids and dates: sessions without messages; missing dates are null; evidence names sessions."""
    raw = _objects(spark, path, HAYSTACK)
    sessions = raw.select(F.col("question_id").alias("conversation_id"), "haystack_dates", F.posexplode_outer("haystack_session_ids").alias("k", "sid")).select(
        "conversation_id",
        F.coalesce("sid", F.concat(F.lit("session_"), F.coalesce("conversation_id", F.lit("unknown")))).alias("session_id"),
        F.coalesce("k", F.lit(0)).alias("session_index"),
        F.get("haystack_dates", F.coalesce("k", F.lit(0))).alias("session_time"),
    )
    questions = raw.select(
        F.col("question_id").alias("qa_id"), F.col("question_id").alias("conversation_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("reference"),
        F.col("question_type").try_cast("int").alias("category"),
        F.transform(F.coalesce("answer_session_ids", F.array().cast("array<string>")), lambda s: F.struct(s.alias("session_id"), F.lit("").alias("message_id"))).alias("evidence"),
    )
    return sessions, questions


def read_files_layout(spark: SparkSession, path: str, pattern: str = "qa_*.json") -> tuple[DataFrame, DataFrame]:
    """A folder with one conversation per file; sessions and qas may be an object or a list; a message without a time has its session's."""
    raw = spark.read.option("multiLine", True).option("pathGlobFilter", pattern).schema("id string, sessions string, qas string").json(path)
    listed = lambda c, item: F.coalesce(F.from_json(c, f"array<{item}>"), F.array(F.from_json(c, item)))
    named = raw.withColumn("conversation_id", F.coalesce("id", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)))
    sessions = named.select("conversation_id", F.posexplode(listed("sessions", SESSION)).alias("session_index", "s"))
    messages = sessions.select("conversation_id", "session_index", "s.session_id", F.col("s.time").alias("session_time"), F.posexplode("s.messages").alias("turn", "m")).select(
        "conversation_id", "session_id", "session_index", "session_time", "turn", "m.message_id", "m.role", F.col("m.role").alias("speaker"), F.coalesce("m.content", F.lit("")).alias("content"),
        F.coalesce("m.time", "session_time").alias("occurred_at"),
    )
    questions = named.select("conversation_id", F.explode(listed("qas", FILE_QA)).alias("q")).select(
        "q.qa_id", "conversation_id", "q.question", F.col("q.answer").alias("reference"), F.col("q.type").try_cast("int").alias("category"),
        F.array().cast("array<struct<session_id:string,message_id:string>>").alias("evidence"), F.col("q.type").alias("type"),
    )
    return messages, questions


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    readers = {"files": read_files_layout, "sessions": read_sessions_layout, "haystack": read_haystack_layout}
    return readers[layout(spark, path)](spark, path)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line fails the read if ``strict`` and is dropped otherwise."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line: what a lenient read drops."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where(F.trim("value") != "")
    parsed = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(parsed["_corrupt_record"].isNotNull())
