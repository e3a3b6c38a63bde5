"""Global row numbers and a keyed Feistel permutation of them, in SQL functions.

``n`` rows are laid out on a grid of ``a * b >= n`` cells with a, b near the square root of n.  Rounds add a keyed
function of one coordinate to the other in turn (a Feistel network over two moduli), which permutes the grid.
Fewer than ``a`` cells lie beyond n; a row that lands on one is permuted again until it is inside (cycle walking),
which makes a permutation of 0 .. n - 1.  A walk visits different outside cells only, so at most 1 / sqrt(n) of the
rows walk at all; 64 steps always suffice below 4,096 rows, and a longer walk has chance n ** -32 above.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# Two primes near 2^31 and 2^32 for the round function.
P1, P2 = 2147483647, 4294967291
ROUNDS = 8
WALK = 64


@dataclass(frozen=True)
class Grid:
    n: int
    seed: int

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(0, self.n - 1)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    def keys(self) -> list[tuple[int, int, int]]:
        """Multipliers and offset of each round, drawn from the seed by a multiplicative generator."""
        x, out = (self.seed * 2654435761 + 12345) % P1 or 1, []
        for _ in range(ROUNDS):
            drawn = []
            for _ in range(3):
                x = x * 48271 % P1
                drawn.append(x)
            out.append((drawn[0] // 2 + 1, drawn[1], drawn[2] // 2 + 1))
        return out


def _once(x: Column, g: Grid) -> Column:
    keys = F.array(*[F.struct(F.lit(i % 2).alias("turn"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip("mcf", key)])
                     for i, key in enumerate(g.keys())])

    def mixed(v: Column, k: Column) -> Column:
        return F.floor(((v * k["m"] + k["c"]) % P1 * k["f"]) % P2 / 8).cast("bigint")

    def turn(s: Column, k: Column) -> Column:
        first = k["turn"] == 0
        return F.struct(F.when(first, (s["l"] + mixed(s["r"], k)) % g.a).otherwise(s["l"]).alias("l"),
                        F.when(first, s["r"]).otherwise((s["r"] + mixed(s["l"], k)) % g.b).alias("r"))

    start = F.struct(F.floor(x / g.b).cast("bigint").alias("l"), (x % g.b).cast("bigint").alias("r"))
    return F.aggregate(keys, start, turn, lambda s: s["l"] * g.b + s["r"])


def permuted(df: DataFrame, number: str, to: str, n: int, seed: int) -> DataFrame:
    """Column ``to``: the place of row ``number`` (0 .. n - 1) in the shuffled order."""
    g = Grid(n, seed)
    df = df.withColumn("_first", _once(F.col(number), g))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_first"), lambda p, _: F.when(p < n, p).otherwise(_once(p, g)))
    place = F.when(F.col("_first") < n, F.col("_first")).otherwise(walk)
    df = df.withColumn("_place", place)
    inside = F.when(F.col("_place") < n, F.col("_place")).otherwise(F.raise_error(F.lit("cycle walk too long: take another seed")).cast("bigint"))
    return df.withColumn(to, inside).drop("_first", "_place")


def numbered(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Stored rows with column ``to``: their rank 0 .. n - 1 in ``order``.

    Rows are dealt by range and sorted, so that no task holds more than its range; the only thing brought together
    is one count for each range.  Rows equal in ``order`` should be equal, as their ranks are interchangeable; they
    are dealt to ranges by a hash of their input position too, so that many equal rows do not meet in one.
    """
    spread = df.withColumn("_t", F.xxhash64(F.monotonically_increasing_id()))
    ranged = spread.repartitionByRange(*order, "_t").sortWithinPartitions(*order, "_t").drop("_t")
    held = stage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    held = held.withColumn("_range", F.shiftright("_m", 33)).withColumn("_in", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row for each task of the write above
    sizes = held.groupBy("_range").agg((F.max("_in") + 1).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return held.join(F.broadcast(offsets), "_range").withColumn(to, F.col("_before") + F.col("_in")).drop("_m", "_range", "_in", "_before")
