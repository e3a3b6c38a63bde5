r"""Fill-in-the-middle transformation with piece tables.

A document never changes: it is an immutable buffer of code points, the sentinels are a second one.  A piece is a
descriptor (buffer, start, end).  The document begins as one piece; two cuts split it into prefix, middle and suffix,
and an arrangement puts the pieces and the sentinels' pieces in order.  Hashes run over the pieces in order, so the
arranged text need not exist to be hashed; it is written out once, as the operator's output.

Restoring works on the output alone: the sentinels are found in it, what stands between them are pieces over the
output buffer, and the inverse of the form's permutation puts them back.

Units are white space and the word after it; white space at the end is a unit of its own.  Cuts and form come from
the SHA-256 of seed and ``doc_id``, so a document is always treated alike.  One pass, no shuffle; a task holds a few
texts at a time.

Defined cases: null text counts as empty.  An empty text, a text that holds a sentinel and a text not drawn stay
plain: no pieces are moved, the lengths are null.  A null ``doc_id`` is drawn as if its decimal form were empty.  Rows
that repeat a ``doc_id`` are drawn alike.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as W
from .frames import by_batch

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
DOCUMENT, MARKS = 0, 1  # buffers
# order of the parts (0 prefix, 1 middle, 2 suffix) in the output, each after its own sentinel or none
FORMS = {"plain": ((0, None), (1, None), (2, None)), "psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}

Piece = tuple[int, int, int]

COLUMNS = {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
           "pieces": "array<struct<buffer:int,start:bigint,end:bigint>>", "output": "string", "output_sha256": "string"}
ADDED = {"restored": "string", "restored_sha256": "string"}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


@dataclass(frozen=True)
class FillParams:
    seed: int = 42
    percent: int = 50  # documents that are rearranged
    spm_percent: int = 80  # of these, with the suffix first


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    """Split a descriptor ``at`` code points from its begin."""
    buffer, start, end = piece
    return (buffer, start, start + at), (buffer, start + at, end)


def arrangement(parts: list[Piece], form: str) -> list[Piece]:
    """The three parts in the form's order with their sentinels."""
    out = []
    for part, mark in FORMS[form]:
        if mark:
            first = SENTINELS.index(mark)
            out.append((MARKS, first, first + len(mark)))
        out.append(parts[part])
    return [p for p in out if p[1] < p[2]]


def inverse(output: str, form: str) -> list[Piece]:
    """Pieces over the output buffer that give the document back."""
    if form == "plain":
        return [(DOCUMENT, 0, len(output))]
    parts, marks = {}, [(part, mark, output.index(mark)) for part, mark in FORMS[form]]
    for (part, mark, at), after in zip(marks, [m[2] for m in marks[1:]] + [len(output)]):
        parts[part] = (DOCUMENT, at + len(mark), after)
    return [parts[k] for k in sorted(parts)]


def written(pieces: Iterable[Piece], document: str) -> Iterator[str]:
    buffers = (document, SENTINELS)
    return (buffers[b][start:end] for b, start, end in pieces)


def digest(pieces: Iterable[Piece], document: str) -> str:
    """SHA-256 of the UTF-8 bytes of the pieces, one piece after the other."""
    out = hashlib.sha256()
    for text in written(pieces, document):
        out.update(text.encode())
    return out.hexdigest()


def unit_ends(texts: list) -> list[np.ndarray]:
    """Positions where each text's units end."""
    points, first = W.code_points(texts)
    _, end = W.word_spans(W.is_space(points))
    at = np.searchsorted(end, first)
    out = []
    for i, text in enumerate(texts):
        own = end[at[i]:at[i + 1] if i + 1 < len(texts) else None] - first[i]
        size = len(text)
        out.append(own if size == (own[-1] if len(own) else 0) else np.append(own, size))
    return out


def arrange(doc_id: int | None, text: str, ends: np.ndarray, p: FillParams) -> tuple:
    n = len(ends)
    drawn = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= p.percent:
        form, cuts, pieces = "plain", (None, None), [(DOCUMENT, 0, len(text))] if text else []
    else:
        form = "spm" if h4 % 100 < p.spm_percent else "psm"
        low, high = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        first, rest = cut((DOCUMENT, 0, len(text)), low)
        cuts, pieces = (low, high - low), arrangement([first, *cut(rest, high - low)], form)
    return n, form, *cuts, pieces


def _arranging(p: FillParams):
    kind = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        rows = []
        for lo, hi in W.chunks(texts):
            for i, ends in zip(range(lo, hi), unit_ends(texts[lo:hi])):
                rows.append(arrange(ids[i], texts[i], ends, p))
        n, form, prefix, middle, pieces = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
             pa.array([[dict(zip(("buffer", "start", "end"), x)) for x in t] for t in pieces], kind),
             pa.array(["".join(written(t, x)) for t, x in zip(pieces, texts)], pa.string()),
             pa.array([digest(t, x) for t, x in zip(pieces, texts)], pa.string())],
            list(COLUMNS))

    return kernel


def _restoring(batch: pa.RecordBatch) -> pa.RecordBatch:
    outputs = batch.column("output").to_pylist()
    pieces = [inverse(o, f) for o, f in zip(outputs, batch.column("form").to_pylist())]
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(["".join(written(t, o)) for t, o in zip(pieces, outputs)], pa.string()),
         pa.array([digest(t, o) for t, o in zip(pieces, outputs)], pa.string())], [*batch.schema.names, *ADDED])


def infilled(docs: DataFrame, p: FillParams = FillParams()) -> DataFrame:
    """One row for each row of ``docs``: units, form, lengths, pieces, output text and its digest."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(by_batch(_arranging(p)), _schema(COLUMNS))


def restored(arranged: DataFrame) -> DataFrame:
    """``arranged`` with the document rebuilt from ``output`` and ``form`` alone, and its digest."""
    return arranged.select(*COLUMNS).mapInArrow(by_batch(_restoring, "output"), _schema(COLUMNS | ADDED))
