"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, hotjoin, licenses, quality, resample, secrets, shards, substrings
from .common import table
from .ngram import near_duplicates
from .pack import pack_documents, with_checksum
from .shards import shard_documents
from .tokens import token_counts
from .urls import judge_urls

PACK_END_ID = 2
TOKEN_LIMIT = 1024
#: The rules of the query on urls: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_checksum(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACK_END_ID))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hot_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotjoin.digest(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_token_counts": op2_token_counts,
        "op3_url_filters": op3_url_filters,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_secret_scans": op5_secret_scans,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_license_scans": op7_license_scans,
        "op8_sharding": op8_sharding,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_quality_classifier": op11_quality_classifier,
        "op12_hot_key_join": op12_hot_key_join,
        "op13_importance_resampling": op13_importance_resampling,
    }


_URL_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP3_SQL = rf"""WITH r AS (SELECT * FROM (VALUES {_URL_RULES_SQL}) t(h, p, v)),
s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
f AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND n = 1"""

_GAP = r"[ \t\n\x0B\f\r]"
OP10_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_GAP}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_GAP[1:-1]}]')) AS l,
  length(regexp_replace(t, '{_GAP}+', '', 'g')) AS chars, length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) AS symbols,
  length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper FROM d),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m) x),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) x WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) x GROUP BY doc_id),
f AS (SELECT m.doc_id, len(w) AS n_words, chars AS word_chars, symbols AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS lines, letters, upper FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_SHARE} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > {quality.MAX_SYMBOLS_SHARE} * n_words OR 100 * n_dup_lines > {quality.MAX_DUP_LINES_SHARE} * lines OR 100 * upper > {quality.MAX_UPPER_SHARE} * letters
    OR word_chars < {quality.MIN_WORD_CHARS} * n_words OR word_chars > {quality.MAX_WORD_CHARS} * n_words OR 100 * letters < {quality.MIN_LETTER_SHARE} * word_chars) AS kept FROM b"""


#: One row with the table of the byte-wise checksum.
_CRC_TABLE = "z AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z)"


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255)::INT + 1])), 4294967295)"


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"


def _joined_side(number: str, amount: str, name: str) -> str:
    keyed = f"SELECT {number}::BIGINT AS id, client_id, {_crc(_ascii(f'{number}::VARCHAR'))} AS h, {number} || ':' || coalesce(floor(100 * {amount} + 0.5)::BIGINT::VARCHAR, '') AS shown FROM {name}, z"
    return f"SELECT id, CASE WHEN h % 10 < 2 THEN h // 10 % 3 ELSE client_id END AS client_id, {_crc(_ascii('shown'))} AS crc FROM ({keyed}) t, z"


OP12_SQL = f"""WITH {_CRC_TABLE}, c AS ({_joined_side("click_id", "value", "clicks")}), s AS ({_joined_side("sale_id", "total", "sales")}),
cn AS (SELECT client_id, count(*) AS n, sum(crc) AS crc FROM c GROUP BY client_id), sn AS (SELECT client_id, count(*) AS n, sum(crc) AS crc FROM s GROUP BY client_id),
a AS (SELECT 'click' AS side, id, c.client_id, coalesce(n, 0) AS n, coalesce(sn.crc, 0) AS p FROM c LEFT JOIN sn ON c.client_id = sn.client_id
  UNION ALL SELECT 'sale', id, s.client_id, coalesce(n, 0), coalesce(cn.crc, 0) FROM s LEFT JOIN cn ON s.client_id = cn.client_id)
SELECT side, id, min(client_id) AS client_id, count(*) AS copies, sum(n)::BIGINT AS inner_rows, sum(CASE WHEN side = 'click' THEN greatest(n, 1) ELSE n END)::BIGINT AS left_rows, sum(greatest(n, 1))::BIGINT AS full_rows, sum(p)::BIGINT AS partner_crc
FROM a GROUP BY side, id"""

_OCTETS = "list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)"
_RUNS = "list_transform(range(1, len(w) + 1), lambda i: w[i]) || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
_TOKENS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP13_SQL = rf"""WITH {_CRC_TABLE}, d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT {_TOKENS} AS w FROM benchmark),
df AS (SELECT r, unnest({_RUNS}) AS f FROM d), bf AS (SELECT unnest({_RUNS}) AS f FROM b),
h AS (SELECT f, {_crc(_OCTETS)} % {resample.BUCKETS} AS k FROM (SELECT f FROM df UNION SELECT f FROM bf) x, z),
s AS (SELECT k, count(*) AS s FROM df JOIN h USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bf JOIN h USING (f) GROUP BY k),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + {resample.BUCKETS})) / ((s + 1) * (t_all + {resample.BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), n),
v AS (SELECT r, sum(gain)::BIGINT AS weight FROM df JOIN h USING (f) JOIN g USING (k) GROUP BY r),
o AS (SELECT d.r, doc_id, len(w) AS n_words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT AS u FROM d LEFT JOIN v ON v.r = d.r),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_words >= {resample.LEAST_WORDS} AS able FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS rank FROM q)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND rank <= (SELECT {resample.PER_CENT} * count(*) FILTER (able) // 100 FROM q) THEN rank END AS rank FROM p"""


_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}+'), lambda x: x <> '')"
OP4_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT node, b FROM r JOIN e ON a = reached)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""
OP9_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d) t), l AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x) t WHERE k > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at_word FROM d),
c AS (SELECT p.*, max(l.i) OVER (PARTITION BY p.doc_id ORDER BY at_word ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.i = at_word),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY at_word) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_BYTES = "flatten(list_transform(string_split(t, ''), lambda c: list_transform(range(strlen(c)), lambda i: ('0x' || substr(hex(encode(c)), 2 * i + 1, 2))::BIGINT)))"
OP8_SQL = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, strlen(t) + {shards.ROW_BYTES} AS size, {_crc(_BYTES)} AS text_crc32 FROM d, z), r AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST) AS ends, sum(size) OVER () AS total FROM s),
p AS (SELECT *, least({shards.SHARDS - 1}, (2 * ends - size) * {shards.SHARDS} // (2 * total))::INT AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM p"""


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    found = f"SELECT doc_id, owner, regexp_extract_all(t, {quoted}, 0) AS hits, regexp_extract_all(t, {quoted}, {group}) AS vals, string_split_regex(t, {quoted}) AS gaps FROM d WHERE regexp_matches(t, {quoted})"
    at = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_prepend(0, list_transform(hits[1:i - 1], lambda x: length(x))))"
    return f"SELECT doc_id, owner, '{kind}' AS kind, {rank} AS rank, ({at})::BIGINT AS start, ({at} + length(hits[i]))::BIGINT AS stop, vals[i] AS value FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({found}) f) g WHERE length(vals[i]) >= {least}"


_ALL_SPANS = " UNION ALL ".join(
    _spans_sql(*x) for x in (("assign", 0, secrets.ASSIGN, 2, secrets.MIN_ASSIGN), ("access", 1, secrets.ACCESS, 0, 20), ("hex", 2, secrets.HEX, 0, 24), ("vendor", 3, secrets.VENDOR, 0, 1))
)
OP5_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner FROM documents), s AS ({_ALL_SPANS}),
c AS (SELECT value, count(DISTINCT owner) <= {secrets.MAX_LIVE_OWNERS} AND count(DISTINCT (owner, doc_id)) <= {secrets.MAX_LIVE_REPOSITORIES} AS live FROM s GROUP BY 1),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'vendor') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM s JOIN c USING (value) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_secret_scans": OP5_SQL, "op8_sharding": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL, "op12_hot_key_join": OP12_SQL, "op13_importance_resampling": OP13_SQL}
