"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import (bpe, decontaminate, hard_negatives, infilling, licenses, near_dedup, oracles, quality, quotes, repeats, secrets, sharding,
               token_counts, token_shards)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_ratio", oracles.quality_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_feistel_shards", oracles.shards_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.placed(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_quote_threads", oracles.quotes_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_counts.CountParams(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # a cache of its own for each call, so that every call does the whole work
    return token_counts.counts(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", p)


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.matches(table(spark, sf_dir, "documents"))
    listed = F.transform("found", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"), x["percent"].cast("string")))
    return found.select("doc_id", "n_words", F.size("found").cast("bigint").alias("n_matches"), F.array_join(listed, ",").alias("matches"))


@query("op7_near_dedup", oracles.near_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents")).drop("k1", "k2")


@query("op8_token_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = token_counts.CountParams(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    placed = token_shards.shards(spark, f"{sf_dir}/documents.parquet", lambda: token_counts.encoder(p))
    # files of its own for each call; the rows are what these files hold
    folder = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    return token_shards.read_shards(token_shards.write_shards(placed, folder), folder)


@query("op9_secret_scan", oracles.secrets_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(kind).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op10_decontamination", oracles.contamination_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_repeated_passages", oracles.repeats_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_hard_negatives", oracles.negatives_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


@query("op13_fill_in_middle", oracles.infilling_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infilling.restored(infilling.infilled(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
