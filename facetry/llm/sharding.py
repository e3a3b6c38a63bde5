"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers.

Rows are numbered by (doc_id, text) and the number is permuted; the place gives the shard (modulo) and the slot in
it (quotient), so shard sizes differ by one row at most, slots have no gaps, and anybody can compute where a row
number lies, or lay, without data.  Only ids, sizes and hashes are moved; the texts are read once and stay.

Defined cases: null text has no bytes, size 1; null ids come first.  Equal rows are interchangeable and take
neighbouring numbers.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .permutation import numbered, permuted


@dataclass(frozen=True)
class ShardParams:
    shards: int = 8
    seed: int = 20240607


def placed(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """(doc_id, size, text_crc32, number, place, shard, slot) of each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    rows = numbered(rows, ["doc_id", "text_crc32", "size", "digest"], "number")
    rows = permuted(rows, "number", "place", rows.count(), p.seed)
    return rows.select("doc_id", "size", "text_crc32", "number", "place", (F.col("place") % p.shards).cast("int").alias("shard"),
                       F.floor(F.col("place") / p.shards).cast("bigint").alias("slot"))
