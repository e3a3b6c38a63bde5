"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Lower-cased words and pairs of neighbouring words are hashed into ``buckets`` classes.  Two multinomials are
counted, one over the texts labelled good and one over the whole corpus; a bucket weighs the rounded logarithm
of their smoothed ratio in micro-nats.  A text's score is the sum of its weights over the number of its n-grams
(length-normalised).  Sums are integers, so the verdict ``sum >= threshold * n-grams`` is the same in any order
of addition, on any cluster.

Counting and scoring are two passes over the texts without a shuffle of texts: each task adds up its own bucket
table (``buckets`` rows at most), and only these tables are grouped.  The bucket weights are sent to the tasks;
their size is ``buckets * 8`` bytes whatever the corpus.  Every text labelled good counts for the target: up to
``broadcast_ids`` ids are sent to the tasks as well, more are joined by a shuffle of the texts.

Defined cases: null or empty text has no words and fails the base rules.  No good label at all: all weights are 0
and only the base rules decide.  Contradicting labels of one document: not good.  Rows that repeat a ``doc_id``
are scored each.  Other columns pass through ``keep_good`` unchanged and are not read elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as W
from .frames import by_batch, slices

# Characters that count as symbols, and the moduli of the bucket hash.
SYMBOLS = "#*$%&|<>"
PRIME = 2**31 - 1
PERIOD = 64  # code points after which the word hash repeats its multipliers
PAIR = 1000003


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    threshold: int = -250_000  # micro-nats for each n-gram
    broadcast_ids: int = 1_000_000  # good ids that are sent to every task; more are joined by a shuffle
    least_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30


def multipliers() -> np.ndarray:
    return np.array([pow(31, i + 1, PRIME) for i in range(PERIOD)], np.int64)


class _Words:
    """Words of a few texts: spans, rows and n-gram buckets."""

    def __init__(self, texts: list):
        self.points, first = W.code_points(texts)
        self.start, self.end = W.word_spans(W.is_space(self.points))
        self.row = np.searchsorted(first, self.start, side="right") - 1
        self.first, self.texts = first, texts

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, row) of every word and of every pair of neighbours."""
        if not len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
        point = W.lower_ascii(self.points)[within + np.repeat(self.start, size)].astype(np.int64)
        word = np.add.reduceat(point * multipliers()[within % PERIOD] % PRIME, begin) % PRIME
        near = self.row[1:] == self.row[:-1]
        pair = (word[:-1] * PAIR + word[1:]) % PRIME
        return np.concatenate((word, pair[near])) % buckets, np.concatenate((self.row, self.row[:-1][near]))


def _bucket_tables(p: QualityParams):
    def run(batches):
        total = np.zeros((2, p.buckets), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                good = part.column("good").to_numpy(zero_copy_only=False)
                bucket, row = _Words(part.column("text").to_pylist()).grams(p.buckets)
                total[1] += np.bincount(bucket, minlength=p.buckets)
                total[0] += np.bincount(bucket[good[row]], minlength=p.buckets)
        seen = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "target", "raw"])

    return run


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of all texts labelled good and not toxic."""
    return (labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
            .filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("bigint").alias("id")))


def bucket_counts(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """(bucket, target, raw): n-grams of the trusted target and of all texts in each bucket."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    ids = target_ids(labels)
    # a table of ids is built, never a sort of texts
    good = ids.withColumn("good", F.lit(True)).hint("broadcast" if ids.count() <= p.broadcast_ids else "shuffle_hash")
    tables = rows.join(good, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(
        _bucket_tables(p), "bucket bigint, target bigint, raw bigint")
    return tables.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def weights(counts: DataFrame, p: QualityParams = QualityParams()) -> np.ndarray:
    """Micro-nats of each bucket; ``counts`` has at most ``buckets`` rows."""
    got = counts.toPandas()
    table = np.zeros((2, p.buckets))
    table[:, got["bucket"].to_numpy(np.int64)] = got[["target", "raw"]].to_numpy(float).T
    if not table[0].sum():
        return np.zeros(p.buckets, np.int64)
    share = (table + p.smoothing) / (table.sum(axis=1, keepdims=True) + p.smoothing * p.buckets)
    return np.rint(1e6 * np.log(share[0] / share[1])).astype(np.int64)


def _measures(texts: list, weight: np.ndarray, p: QualityParams) -> dict[str, np.ndarray]:
    n = len(texts)
    words = _Words(texts)
    row, size = words.row, words.end - words.start
    bucket, owner = words.grams(p.buckets)
    count = np.bincount(row, minlength=n)
    symbol = np.isin(words.points, np.array([ord(c) for c in SYMBOLS], np.uint32))
    score = np.zeros(n, np.int64)
    np.add.at(score, owner, weight[bucket])
    lines = [[x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")] for t in texts]

    span = p.repeat_window
    value = W.word_hashes(words.points, words.start, words.end)
    long = max(0, len(value) - span + 1)
    total = np.zeros(long, np.uint64)
    for k, factor in enumerate(W.odd_numbers(span, 13)):
        total += value[k:k + long] * factor
    at = np.flatnonzero(row[:long] == row[span - 1:span - 1 + long])
    total = W.spread(total[at])
    order = np.lexsort((total, row[at]))
    same = (total[order][1:] == total[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    twice = at[order][np.append(same, False) | np.append(False, same)] if len(at) else at
    cover = np.zeros(len(value) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + span, -1)
    repeat = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)

    failed = (count < p.least_words) | (100 * repeat > p.repeat_percent * count)
    grams = np.bincount(owner, minlength=n)
    return {
        "n_words": count, "word_chars": np.bincount(row, size, minlength=n).astype(np.int64),
        "n_symbols": np.bincount(np.searchsorted(words.first, np.flatnonzero(symbol), side="right") - 1, minlength=n),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": repeat,
        "base_failed": failed, "kept": ~failed & (score >= p.threshold * grams), "n_grams": grams, "score_micro": score}


MEASURED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
            "kept boolean, n_grams bigint, score_micro bigint")


def measure(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Counts, base verdict, score and verdict of each text."""
    weight = docs.sparkSession.sparkContext.broadcast(weights(bucket_counts(docs, labels, p), p))

    def kernel(batch):
        found = _measures(batch.column("text").to_pylist(), weight.value, p)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(kernel), f"doc_id bigint, {MEASURED}")


def keep_good(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Rows of ``docs`` that pass, with all their columns."""
    weight = docs.sparkSession.sparkContext.broadcast(weights(bucket_counts(docs, labels, p), p))

    def kernel(batch):
        return batch.filter(pa.array(_measures(batch.column("text").to_pylist(), weight.value, p)["kept"]))

    return docs.mapInArrow(by_batch(kernel), docs.schema)
