"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import shared_folder


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are: TESSERA_TOKENIZERS, or the installed package."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def sha(text):
    return F.sha2(text, 256)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import suffixes

    out = suffixes.dedup(table(spark, sf_dir, "documents"), least=400, words=50)
    length = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", length("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), sha("kept").alias("kept_sha256"), length("passages").alias("n_passage_words"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import vectors

    codes = vectors.index(table(spark, sf_dir, "embeddings"))
    return vectors.search(codes, F.col("vec_id") % 20 == 0, k=20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import shards

    out = shards.assign(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import licenses

    found = licenses.scan(table(spark, sf_dir, "documents"))
    start = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.transform("notices", lambda n: n["label"])))
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["containment"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(4))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import jaccard

    out = jaccard.join(table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, lm.train(docs, ~held_out(7)))
    return out.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontaminate

    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import secrets

    ledger = f"{shared_folder(spark)}/tessera-ledger-{uuid.uuid4().hex[:12]}"  # a new one: every blob of the table is unseen
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    base = F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), sha(F.array_join(F.transform(base, line), ",")).alias("base_sha256"), F.array_join(F.transform("findings", line), ",").alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import bpe

    out = bpe.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join("ids", ",")).alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array_dedup, op2_nearest_neighbours, op3_sharding, op4_license_scans, op5_toxicity, op6_ngram_jaccard_join, op7_lm_scoring, op8_decontamination, op9_secret_scans, op10_bpe)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera.llm import sql

    return sql.oracle_sql()
