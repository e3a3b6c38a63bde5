"""Small DataFrame and Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# one row of the caller's table, kept apart so that its column names cannot clash with ours
ROW = "row"


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The caller's row as one struct beside new columns computed from it."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(ROW), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    fields = df.schema[ROW].dataType.fieldNames()
    return df.select(*[F.col(ROW).getField(f).alias(f) for f in fields], *more)


def text_digest(text: Column | str) -> list[Column]:
    """Two independent 64-bit hashes that name a text; null and empty text are one."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(whole, F.lit(17)).alias("k1"), F.xxhash64(F.lit(29), whole).alias("k2")]


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; only the open group is carried over."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([*kept, batch])
        cut = _last_start(held, keys)
        if cut:
            yield held.slice(0, cut)
        kept = held.slice(cut).combine_chunks().to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    if len(change):
        change[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _last_start(table: pa.Table, keys: list[str]) -> int:
    return int(group_starts(table, keys)[-1])


def slices(batch: pa.RecordBatch, sized: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in column ``sized``, or one row, so that a worker's memory
    does not depend on how many rows Spark sends at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def by_batch(kernel: Callable[[pa.RecordBatch], pa.RecordBatch], sized: str = "text") -> Callable:
    """mapInArrow function from a function of a small batch."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, sized):
                yield kernel(part)
    return run


def absorb(label: np.ndarray, joined: np.ndarray) -> None:
    """Give all classes that meet in ``joined`` (positions) their smallest label."""
    met = np.unique(label[joined])
    if len(met) > 1:
        label[np.isin(label, met)] = met[0]
