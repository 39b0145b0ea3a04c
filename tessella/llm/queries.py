"""One query per operator, over its whole table, and the SQL that checks it.

Each callable takes (spark, sf_dir). The contract of a query's columns is in its docstring's
operator module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, chat_format, decontaminate, license_scan, multiset_hash, rule_ensemble, secrets, sentencepiece_viterbi, suffix_tree, warc
from .common import Scratch, remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), warc.folder_for(spark, scratch), scratch=scratch)
    out = warc.read(index, payloads=False)
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = suffix_tree.score(docs, docs.where(remainder("doc_id", 7) != 2))
    return out.select(F.col("id").alias("doc_id"), (remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id")


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = rule_ensemble.learn(docs, labels.where(remainder("doc_id", 5) != 0))
    out = rule_ensemble.classify(docs, rules, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.with_neighbours(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = chat_format.windows(turns.select("conv_id", "turn", "role", "text").unionByName(more))
    return chat_format.digests(chat_format.read_back(formatted))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan.scan(docs).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_suffix_tree, op3_secrets, op4_decontaminate, op5_sentencepiece, op6_bag_minhash, op7_rule_ensemble, op8_multiset_hash, op9_chat_format, op10_license_scan)
}
#: Base32 of the SHA-1 in hexadecimal: every five digits are twenty bits, four characters.
_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)) AS c FROM d)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, array_to_string(c, '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b"""

#: The rules of the windows (budget 512, history 64) and of the template, stated again.
_OP9 = """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) t(i)),
t AS (SELECT *, 4 + CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, row_number() OVER w - 1 AS place FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (SELECT *, coalesce(sum(tokens) OVER before, 0) AS start, 2 * sum(CAST(tokens > 112 AS INT)) OVER here - CAST(tokens > 112 AS INT) AS segment,
        max(CASE WHEN place = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system,
        8 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;')) + 5 + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars
    FROM t WINDOW before AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), here AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, greatest(336 - system, 112) AS span, CAST(start // greatest(336 - system, 112) AS BIGINT) AS k FROM u),
windows AS (SELECT DISTINCT conv_id, segment, k FROM v),
history AS (SELECT v.conv_id, sum(v.chars) AS chars FROM v JOIN windows n ON n.conv_id = v.conv_id AND n.segment = v.segment AND n.k = v.k + 1
    WHERE NOT (place = 0 AND role = 'system') AND tokens <= 112 AND (v.k + 1) * span - start <= 64 GROUP BY v.conv_id),
later AS (SELECT n.conv_id, sum(s.chars) AS chars FROM windows n JOIN v s ON s.conv_id = n.conv_id AND s.place = 0 AND s.role = 'system' WHERE n.segment != s.segment OR n.k != s.k GROUP BY n.conv_id),
whole AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
        coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM v GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(chars + coalesce((SELECT h.chars FROM history h WHERE h.conv_id = whole.conv_id), 0) + coalesce((SELECT l.chars FROM later l WHERE l.conv_id = whole.conv_id), 0) AS BIGINT) AS formatted_chars
FROM whole"""

ORACLES: dict[str, str] = {"op1_warc": _OP1, "op9_chat_format": _OP9}
