"""MinHash near-duplicates by a multi-index Hamming join.

1. Each text becomes the set of its distinct five-word shingles and a signature of ``symbols`` MinHash values
   cut to 16 bits.  Texts with equal sets are one node from here on.
2. Signatures are split into ``chunks`` chunks.  If two signatures differ in at most
   ``chunks * (errors + 1) - 1`` of the indexed symbols, some chunk has at most ``errors`` differing symbols
   (pigeonhole), so the keys made by leaving out each choice of ``errors`` symbols of a chunk meet in an equi-join.
   At similarity 0.75 a pair beyond that distance is still found unless every chunk has more errors: 1 - 5e-5.
3. Buckets are compared in tiles of bounded size.  A tile returns a spanning forest of the pairs under the
   distance threshold, never the pairs themselves; the forests' components are the candidate families.
4. Families are confirmed on full shingle sets, again in tiles that return spanning forests.

Nothing is dropped: large buckets and families are cut into blocks and each pair of blocks meets in one tile, so
a family of n different sets costs n * n / block rows.  Copies with equal sets cost nothing, however many.

Defined cases: null text, no words: empty set, linked with nothing.  Fewer than five words: the whole sequence is
the only shingle.  Rows that repeat a ``doc_id`` each get a result row.  Null ``doc_id``: linked as any other row,
but never the smallest id; alone, its component is null and it is kept.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import stage
from . import wordarrays as W
from .frames import absorb, by_batch, group_starts, in_groups, packed, text_digest, unpacked


@dataclass(frozen=True)
class NearParams:
    width: int = 5  # words of a shingle
    percent: int = 75  # least similarity of a link
    chunks: int = 10
    chunk_symbols: int = 5
    errors: int = 1  # allowed in a chunk
    symbols: int = 80  # the first chunks * chunk_symbols are indexed, all count for the distance
    max_distance: int = 38  # of symbols; a pair of similarity 0.75 exceeds it once in a million
    bucket_block: int = 256  # rows of a block in bucket tiles
    family_block: int = 256  # rows of a block in family tiles
    seed: int = 5


SIGNED = "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, s1 bigint, s2 bigint, signature binary"


def shingle_sets(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, row) of lower-cased texts, in text order."""
    points, first = W.code_points(texts)
    points = W.lower_ascii(points)
    start, end = W.word_spans(W.is_space(points))
    row = np.searchsorted(first, start, side="right") - 1
    return W.shingle_hashes(W.word_hashes(points, start, end), row, len(texts), width)


def distinct_in_row(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def _signing(p: NearParams):
    factor = W.odd_numbers(p.symbols, p.seed)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        size = np.zeros(len(texts), np.int64)
        sums = np.zeros((2, len(texts)), np.uint64)
        marks = np.zeros((len(texts), p.symbols), np.uint16)
        for lo, hi in W.chunks(texts):
            value, row = distinct_in_row(*shingle_sets(texts[lo:hi], p.width))
            if not len(value):
                continue
            first = np.flatnonzero(np.diff(row, prepend=-1))
            at = lo + row[first]
            size[at] = np.diff(np.append(first, len(row)))
            sums[0, at] = np.add.reduceat(W.spread(value), first)
            sums[1, at] = np.add.reduceat(W.spread(value ^ np.uint64(0x5851F42D4C957F2D)), first)
            for j in range(p.symbols):
                marks[at, j] = W.spread(np.minimum.reduceat(value * factor[j], first)) & np.uint64(0xFFFF)
        signature = pa.FixedSizeBinaryArray.from_buffers(
            pa.binary(2 * p.symbols), len(texts), [None, pa.py_buffer(marks.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(size), pa.array(sums[0].view(np.int64)),
             pa.array(sums[1].view(np.int64)), signature],
            ["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "signature"])

    return kernel


def signatures(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """One row for each row of ``docs``: text digest, set size, digest of the set, signature."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_digest("text"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(_signing(p)), SIGNED)


def chunk_keys(p: NearParams) -> F.Column:
    """All index keys of a signature: each chunk without each choice of ``errors`` symbols."""
    keys = []
    for c in range(p.chunks):
        for left_out in combinations(range(p.chunk_symbols), p.errors):
            rest = [F.substring("signature", 2 * (c * p.chunk_symbols + s) + 1, 2) for s in range(p.chunk_symbols) if s not in left_out]
            keys.append(F.xxhash64(F.lit(len(keys)), *rest))
    return F.array(*keys)


def in_tiles(rows: DataFrame, group: str, node: str, count: str, block: int) -> DataFrame:
    """Deal the rows of each group to tiles (lo, hi) of two blocks; every pair of rows meets in some tile."""
    blocks = rows.withColumn("_n", F.ceil(F.col(count) / F.lit(block)).cast("int"))
    blocks = blocks.withColumn("_b", F.pmod(F.xxhash64(node, group), F.col("_n")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least("_b", j).alias("lo"), F.greatest("_b", j).alias("hi")))
    return blocks.withColumn("_t", F.explode(pair)).select("*", "_t.lo", "_t.hi").drop("_n", "_b", "_t")


def _close_pairs(p: NearParams):
    """Spanning forest of the pairs under the distance threshold in each tile."""
    def kernel(batches):
        for table in in_groups(batches, ["key", "lo", "hi"]):
            node = table.column("node").to_numpy()
            size = table.column("n_shingles").to_numpy()
            flat = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, p.symbols)
            first = group_starts(table, ["key", "lo", "hi"])
            out = []
            for lo, hi in zip(first, np.append(first[1:], len(node))):
                label = np.arange(hi - lo)
                for i in range(hi - lo - 1):
                    at = slice(lo + i + 1, hi)
                    least = np.minimum(size[at], size[lo + i]) * 100 >= p.percent * np.maximum(size[at], size[lo + i])
                    near = np.flatnonzero(least & ((flat[at] != flat[lo + i]).sum(axis=1) <= p.max_distance))
                    if len(near):
                        absorb(label, np.append(near + i + 1, i))
                moved = np.flatnonzero(label != np.arange(hi - lo))
                if len(moved):
                    out.append(np.stack((node[lo + moved], node[lo + label[moved]])))
            if out:
                pairs = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return kernel


def _confirmed(p: NearParams):
    """Spanning forest of the links that hold on full shingle sets in each tile."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy(np.int64)
        value, row = distinct_in_row(*shingle_sets(list(pdf["text"]), p.width))
        _, code = np.unique(value, return_inverse=True)
        first = np.searchsorted(row, np.arange(len(node)))  # every node has shingles
        size = np.diff(np.append(first, len(row)))
        label, mark = np.arange(len(node)), np.zeros(code.max() + 1, bool)
        for i in range(len(node) - 1):
            own = code[first[i]:first[i] + size[i]]
            mark[own] = True
            both = np.add.reduceat(mark[code[first[i + 1]:]], first[i + 1:] - first[i + 1], dtype=np.int64)
            mark[own] = False
            linked = np.flatnonzero(100 * both >= p.percent * (size[i] + size[i + 1:] - both))
            if len(linked):
                absorb(label, np.append(linked + i + 1, i))
        moved = label != np.arange(len(node))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return kernel


def thinned(edges: DataFrame) -> DataFrame:
    """Edges with the same components: a node keeps its smallest neighbour and links the others to it.

    A node has one edge for each tile it is in, and tiles of one family share few smallest nodes, so most of the
    new edges are equal.
    """
    near = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("all"))
    star = F.transform("all", lambda b, i: F.struct(F.when(i == 0, F.col("a")).otherwise(b).alias("a"), F.get("all", F.lit(0)).alias("b")))
    return near.select(F.inline(star)).distinct()


def _rooted(docs: DataFrame, p: NearParams) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, root) for each row of ``docs``; a text without shingles has no root."""
    signed = stage(signatures(docs, p).withColumn("rid", F.monotonically_increasing_id()))
    sets = stage(signed.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles", "signature").agg(F.min("rid").alias("node")))

    keyed = sets.select("node", F.explode(chunk_keys(p)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = in_tiles(keyed.join(shared, "key"), "key", "node", "n", p.bucket_block)
    tiles = (members.join(sets.select("node", "n_shingles", "signature"), "node").select("key", "lo", "hi", "node", "n_shingles", "signature")
             .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node"))
    families = connected_components(thinned(tiles.mapInArrow(_close_pairs(p), "a bigint, b bigint")))
    families = stage(families.join(families.groupBy("root").agg(F.count("*").alias("n")), "root"))

    wanted = families.join(signed.select(F.col("rid").alias("node"), "doc_id", "k1", "k2"), "node")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), *[c.alias(f"t_{n}") for c, n in zip(text_digest("text"), ("k1", "k2"))],
                        F.col("text").cast("string").alias("text"))
    held = (wanted.join(texts, F.expr("k1 = t_k1 and k2 = t_k2 and doc_id <=> id"))
            .dropDuplicates(["node"]).select("root", "node", "n", "text"))
    checked = in_tiles(held, "root", "node", "n", p.family_block).groupBy("root", "lo", "hi")
    roots = connected_components(thinned(checked.applyInPandas(_confirmed(p), "a bigint, b bigint")))

    classes = sets.join(roots, "node", "left").select("s1", "s2", "n_shingles", F.coalesce("root", "node").alias("root"))
    rows = signed.select("doc_id", "k1", "k2", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    return rows.select("doc_id", "k1", "k2", "n_shingles", "root")


def components(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) for each row of ``docs``."""
    rows = _rooted(docs, p)
    least = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    component = F.coalesce("least_id", "doc_id")
    return (rows.join(least, "root", "left")
            .select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"),
                    F.expr("coalesce(doc_id = coalesce(least_id, doc_id), least_id is null)").alias("kept")))


def without_near_copies(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """Rows of ``docs`` that stay, with its columns: one of each component.

    It is the row of the smallest id (null last), then digest.  Rows repeating both ``doc_id`` and text are one
    document; one of them stays.
    """
    rows = _rooted(docs, p)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2")).alias("first")
    chosen = rows.filter("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.k1", "first.k2")
    kept = stage(chosen.unionByName(rows.filter("root is null").select("doc_id", "k1", "k2").distinct()))
    k1, k2 = text_digest("text")
    rows = packed(docs, id=F.col("doc_id").cast("bigint"), t_k1=k1, t_k2=k2)
    left = rows.join(kept, F.expr("k1 = t_k1 and k2 = t_k2 and doc_id <=> id"), "left_semi")
    return unpacked(left.dropDuplicates(["id", "t_k1", "t_k2"]))
