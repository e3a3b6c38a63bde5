r"""Hard negatives by exact inner products in a residue number system.

Vectors become integers, ``floor(scale * x)``.  A score is an integer inner product: both matrices are reduced
modulo several small primes to balanced residues, each pair of residue matrices is multiplied in float32 (in blocks of
the dimension, whose sums stay below 2^24, so they are exact), and the score is put together from its remainders by
mixed-radix Chinese remaindering.  The primes are as many as the largest component and the dimension need, found by
one aggregate over the table.

Work is dealt to a grid: anchors into tiles, all rows into strips, both of bounded size; an anchor is sent once to
each strip and a row once to each tile, so a task holds one tile and one strip, whatever label or vector is frequent.
1. Each cell returns the best ``positives`` rows of the anchor's label; a window over an anchor's cells keeps the best.
2. Each cell returns, for each anchor and positive, the best ``negatives`` rows of other labels whose score lies in the
   positive's window; a window over the cells keeps the best.  Scores are computed again rather than stored.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; no row is left:
empty result.  Shorter vectors count as filled with zeros.  Rows that repeat an id are rows of their own: each is an
anchor, and each is an "other" row for the rest.  A score that needs more than 63 bits raises ArithmeticError.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


@dataclass(frozen=True)
class MiningParams:
    scale: int = 256
    anchor_step: int = 100  # ids divisible by it are anchors
    moved_step: int = 7  # ids divisible by it have the next label
    labels: int = 10
    positives: int = 5
    negatives: int = 10
    low_percent: int = 30  # of the positive's score
    high_percent: int = 90
    tile_rows: int = 2048  # anchors of a grid cell
    strip_rows: int = 8192  # rows of a grid cell
    block: int = 256  # anchors multiplied at once


SPAN = 256  # components of a float32 product


def primes_for(dimension: int, largest: int) -> list[int]:
    """Primes whose product exceeds twice the largest score, each small enough for exact float32 sums.

    Balanced residues are at most ``(m - 1) / 2``, so a block's sum stays within ``SPAN * ((m - 1) / 2) ** 2 < 2 ** 24``.
    """
    bound = dimension * largest * largest
    if bound >= 2**63:
        raise ArithmeticError(f"scores of {dimension} components up to {largest} need more than 63 bits")
    found, product, m = [], 1, 2 * int((2**24 / min(dimension, SPAN)) ** 0.5 * 0.999) + 1
    m = min(m, 2**15)
    while product <= 2 * bound + 1:
        if all(m % q for q in range(2, int(m**0.5) + 1)):
            found.append(m)
            product *= m
        m -= 1
    return found


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Balanced residues of an integer matrix for each prime, as float32."""
    out = []
    for m in primes:
        r = matrix % m
        out.append((r - np.where(r > m // 2, m, 0)).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact integer products of every row of ``left`` with every row of ``right``.

    Mixed radix digits (Garner): ``v = d0 + m0 * (d1 + m1 * (d2 + ...))`` with ``v = score + half``; the sum is taken modulo
    2^64, which is exact for scores of up to 63 bits even if the product of the primes has more.
    """
    half = (int(np.prod([int(m) for m in primes], dtype=object)) - 1) // 2
    digits: list[np.ndarray] = []
    total = np.full((len(left[0]), len(right[0])), np.uint64(-half % 2**64), np.uint64)
    weight = 1
    for k, m in enumerate(primes):
        rest = np.full(total.shape, half % m, np.int64)
        for at in range(0, left[k].shape[1], SPAN):
            rest += (left[k][:, at:at + SPAN] @ right[k][:, at:at + SPAN].T).astype(np.int64)
        # subtract the digits found so far and divide by their radices, modulo m
        for j in range(k):
            rest = (rest - digits[j]) * pow(primes[j], -1, m) % m
        digits.append(rest % m)
        total += digits[-1].astype(np.uint64) * np.uint64(weight % 2**64)
        weight *= m
    return total.view(np.int64)


def best(score: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` positions of ``at`` with the highest scores, earlier positions first among equals."""
    if len(at) > count:
        edge = np.partition(score[at], len(at) - count)[len(at) - count]
        at = at[score[at] >= edge]
    return at[np.argsort(-score[at], kind="stable")[:count]]


def _matrix(column: pd.Series, dimension: int, scale: int) -> np.ndarray:
    size = column.map(len).to_numpy()
    out = np.zeros((len(column), dimension))
    out[np.arange(dimension) < size[:, None]] = np.concatenate(column.to_numpy())
    return np.floor(out * scale).astype(np.int64)


def _frame(found: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows from (anchor's values, arrays of equal length)."""
    if not found:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in names})
    count = [len(arrays[0]) for _, arrays in found]
    own = [np.repeat([f[0][i] for f in found], count) for i in range(len(found[0][0]))]
    return pd.DataFrame(dict(zip(names, own + [np.concatenate([f[1][i] for f in found]) for i in range(len(found[0][1]))])))


def _cells(part: pd.DataFrame, dimension: int, primes: list[int], p: MiningParams) -> Iterator[tuple]:
    """(anchor row, its scores with the strip, strip) of one grid cell; the strip is sorted by id."""
    anchors, strip = part[part["role"] == 0], part[part["role"] == 1].sort_values(["vec_id", "rid"])
    if not len(anchors) or not len(strip):
        return
    right = residues(_matrix(strip["vector"], dimension, p.scale), primes)
    held = {c: strip[c].to_numpy() for c in ("vec_id", "rid", "label")}
    for lo in range(0, len(anchors), p.block):
        some = anchors.iloc[lo:lo + p.block]
        found = scores(residues(_matrix(some["vector"], dimension, p.scale), primes), right, primes)
        for row, score in zip(some.itertuples(index=False), found):
            yield row, score, held


def _positives(dimension: int, primes: list[int], p: MiningParams):
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, score, strip in _cells(part, dimension, primes, p):
            at = best(score, np.flatnonzero((strip["label"] == row.label) & (strip["rid"] != row.rid)), p.positives)
            out.append(((row.rid,), (strip["vec_id"][at], strip["rid"][at], score[at])))
        return _frame(out, ["rid", "positive_id", "positive_rid", "score"])

    return kernel


def _negatives(dimension: int, primes: list[int], p: MiningParams):
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, score, strip in _cells(part, dimension, primes, p):
            other = np.flatnonzero(strip["label"] != row.label)
            seen = score[other]
            for k, s in enumerate(row.positives):
                # 30 s <= 100 x <= 90 s with whole x
                low, high = -(-p.low_percent * int(s) // 100), p.high_percent * int(s) // 100
                at = best(score, other[(seen >= low) & (seen <= high)], p.negatives)
                out.append(((row.rid, k), (strip["vec_id"][at], score[at])))
        return _frame(out, ["rid", "place", "negative_id", "score"])

    return kernel


def usable(vectors: DataFrame, p: MiningParams) -> DataFrame:
    """(rid, vec_id, label, vector) of the rows that take part, labels moved."""
    label = F.col("label").cast("bigint")
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.when(F.col("vec_id") % p.moved_step == 0, (label + 1) % p.labels).otherwise(label).alias("label"),
                          F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter("vec_id is not null and label is not null and vector is not null").filter(finite)


def _grid(rows: DataFrame, anchors: DataFrame, tiles: int, strips: int) -> DataFrame:
    """Anchors sent to every strip, rows to every tile; ``positives`` is null for rows."""
    def dealt(df: DataFrame, role: int, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        home = F.pmod(F.xxhash64(F.lit(role), "rid"), F.lit(n_own)).cast("int")
        return df.select(F.lit(role).alias("role"), "rid", "vec_id", "label", "vector", "positives", home.alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    empty = F.lit(None).cast("array<bigint>")
    sides = dealt(anchors, 0, "tile", tiles, "strip", strips), dealt(rows.withColumn("positives", empty), 1, "strip", strips, "tile", tiles)
    return sides[0].unionByName(sides[1])


def mined(vectors: DataFrame, p: MiningParams = MiningParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = stage(usable(vectors, p))
    size = F.ceil(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double") * p.scale)))).cast("double")
    facts = rows.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % p.anchor_step == 0).cast("int")).alias("anchors"),
                     F.max(F.size("vector")).alias("dimension"), F.max(size).alias("largest")).first()
    dimension = max(1, facts["dimension"] or 0)
    primes = primes_for(dimension, max(1, int(facts["largest"] or 1)))
    tiles, strips = -(-max(1, facts["anchors"] or 0) // p.tile_rows), -(-max(1, facts["n"]) // p.strip_rows)
    anchors = rows.filter(F.col("vec_id") % p.anchor_step == 0)

    cells = _grid(rows, anchors.withColumn("positives", F.lit(None).cast("array<bigint>")), tiles, strips).groupBy("tile", "strip")
    near = cells.applyInPandas(_positives(dimension, primes, p), "rid bigint, positive_id bigint, positive_rid bigint, score bigint")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "positive_id", "positive_rid")
    near = near.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < p.positives)
    near = stage(near.select("rid", "place", "positive_id", "score"))

    listed = near.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("positives"))
    cells = _grid(rows, anchors.join(listed, "rid"), tiles, strips).groupBy("tile", "strip")
    far = cells.applyInPandas(_negatives(dimension, primes, p), "rid bigint, place int, negative_id bigint, score bigint")
    order = Window.partitionBy("rid", "place").orderBy(F.desc("score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.negatives)

    named = near.join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return (far.withColumnRenamed("score", "negative_score").join(named.withColumnRenamed("score", "positive_score"), ["rid", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
