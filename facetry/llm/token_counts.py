"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens): the digest names a normalised text (null is empty), the
version names the tokenizer file and how it is used.  Texts are reduced to digests, the digests that the cache does
not hold are found by an anti-join, one text of each is encoded, and the counts are appended.  All counts then
come from the cache by a join.  Copies are dropped before a text is moved, so one text that fills a third of the table
is encoded once and overloads no task.  Where the missing digests are counted few, they are sent to the texts and only
missing texts move; a run over a full cache moves digests only.  Where most texts are new, distinct texts move once and
meet their digests there.  If two runs append at once, a digest may be held twice; it is read once.

Encoders: ``.json`` files by tokenizers, ``.model`` by sentencepiece.  If ``ranks`` names the same vocabulary as
tiktoken ranks, texts whose characters both libraries class alike are counted with it, which is four times faster.

Defined cases: null text is empty, 0 bytes, 0 tokens.  Rows that repeat a ``doc_id`` are counted each.  Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .bpe import NEWER
from .frames import by_batch


@dataclass(frozen=True)
class CountParams:
    tokenizer: str  # path of the vocabulary file, the same on all machines
    ranks: str | None = None  # the same vocabulary for tiktoken
    limit: int = 1024
    broadcast_rows: int = 200_000  # missing digests that are sent to every task


def version(p: CountParams) -> str:
    """Digest of the tokenizer file and of the way it is used."""
    return hashlib.sha256(Path(p.tokenizer).read_bytes() + b"|no special tokens added|whole text").hexdigest()


@lru_cache(2)
def _libraries(p: CountParams) -> tuple[Callable[[str], list[int]], Callable | None]:
    """(ids of a text by the vocabulary's own library, the same ids as an array by tiktoken, where ``ranks`` are given)."""
    if p.tokenizer.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=p.tokenizer).encode, None
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(p.tokenizer)
    library.no_truncation()
    library.no_padding()
    slow = lambda text: library.encode(text, add_special_tokens=False).ids
    if not p.ranks:
        return slow, None
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(p.ranks).read_bytes().splitlines())}
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return slow, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def counter(p: CountParams) -> Callable[[str], int]:
    slow, fast = _libraries(p)
    if fast is None:
        return lambda text: len(slow(text))
    return lambda text: len(slow(text)) if NEWER.search(text) else len(fast.encode(text, allowed_special="all"))


def encoder(p: CountParams) -> Callable[[list], list[bytes]]:
    """Encoder of texts (null is empty): ids as little-endian unsigned 32-bit integers."""
    slow, fast = _libraries(p)

    def ids(text: str) -> bytes:
        if fast is None or NEWER.search(text):
            return np.array(slow(text), "<u4").tobytes()
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    return lambda texts: [ids(t or "") for t in texts]


def _counted(p: CountParams, name: str):
    def kernel(batch):
        count = counter(p)
        found = [count(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(found)), batch.column("digest"), pa.array(found, pa.int64())],
                                          ["version", "digest", "n_tokens"])

    return kernel


def stored(docs: DataFrame, cache: str) -> DataFrame:
    """The cache, made empty where it does not exist yet."""
    spark, schema = docs.sparkSession, "version string, digest binary, n_tokens bigint"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache)


def counts(docs: DataFrame, cache: str, p: CountParams) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``; ``cache`` is a path all machines reach."""
    spark, name = docs.sparkSession, version(p)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), digest.alias("digest")))
    known = stored(docs, cache).filter(F.col("version") == name).select("digest")
    missing = stage(rows.select("digest").distinct().join(known, "digest", "left_anti"))
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(digest.alias("digest"), text.alias("text"))
        few = n_missing <= p.broadcast_rows
        if few:  # known texts stay where they are
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if not few:
            texts = texts.join(missing, "digest", "left_semi")
        texts.mapInArrow(
            by_batch(_counted(p, name)), "version string, digest binary, n_tokens bigint").write.mode("append").parquet(cache)
    held = spark.read.schema("version string, digest binary, n_tokens bigint").parquet(cache).filter(F.col("version") == name)
    held = held.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.join(held, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > p.limit).alias("over_limit"))
