"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

toxicity        rejects documents whose toxicity score reaches 0.3 (fitted on training labels only)
near_duplicates one document of each group of near copies stays (5-word shingles, Jaccard 0.8), the one of smallest id
decontamination rejects documents that hold a benchmark window (10 words)
secrets         replaces secrets in the text by a mark and updates n_chars
bpe             token ids; documents whose ids do not decode to their text would be rejected (none are, byte level)

Null texts pass as empty ones. Nothing is capped, sampled or cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, secrets, toxicity
from tessera.llm.queries import held_out, table, tokenizer_file
from tessera.llm.shared import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(4))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("score < 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs.select(*COLUMNS), n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.tokenize(docs.select(*COLUMNS), tokenizer_file(), keep=("text", "lang", "source"))
    return out.where(F.col("decoded") == F.coalesce("text", F.lit(""))).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("bpe", encode)]

#: SQL cannot express the fitted grammar nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
