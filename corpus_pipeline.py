"""The corpus pipeline: from raw documents to token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of their docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bag_minhash, decontaminate, rule_ensemble, secrets, sentencepiece_viterbi
from tessella.llm.common import Scratch, remainder

_used: list[Scratch] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Before a stage begins, the scratch tables of the stages before it are dropped: their
    results have been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _used:
            _used.pop().drop()
        before = list(Scratch.live)
        out = f(spark, docs, sf_dir)
        _used.extend(x for x in Scratch.live if x not in before)
        return out

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble rejects. It learns from the labels whose
    crc32(doc_id) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    return rule_ensemble.accepted(docs, rule_ensemble.learn(docs, labels))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each class of near-duplicates."""
    return bag_minhash.keep_one(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark passage is found."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by their kind; n_chars follows."""
    return secrets.redact(docs)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_chars, n_ids, ids, exact)."""
    return sentencepiece_viterbi.encode_texts(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("secrets", secrets_redacted), ("sentencepiece", encoded)]

#: Trees, signatures and the Viterbi search cannot be said in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.put(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
