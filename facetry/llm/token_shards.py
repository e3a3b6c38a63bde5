"""Training-order materialisation: token sequences in shuffled order, in shards of fixed stride.

Texts are encoded where they are read; each text's tokens, closed by ``end_id``, are cut into sequences of
``length`` tokens, the last one filled up with ``end_id``.  A sequence is a record of ``length`` unsigned 16-bit
integers, so record ``i`` of a shard begins at byte ``i * stride``.  Sequences are numbered in table order: the
order of the files by name and of the rows in them, whatever the splits that tasks read.  Tasks count in their
split, only one count for each split is brought together, and the global number is the split's offset plus the
place in it.  A keyed Feistel permutation with cycle walking turns numbers into slots; slots are dealt by range, so
a shard is ``shard_rows`` neighbouring slots, sorted.  Slots are 0 .. n - 1 without gaps, so the ranges follow from
their number and no sample of the rows is taken.

Texts are encoded twice, first to count their sequences and then on the way into the one shuffle: tokens stored
between the two would take more disk than the shuffle.  Records travel unfilled, are filled up where they arrive and
written to their shard's file; an index file beside it holds ``doc_id``, ``seq`` and ``n_tokens`` of each record, also
at a fixed stride.  A reader resumes at any slot: shard ``slot // shard_rows``, byte ``slot % shard_rows * stride``.
The rows must be read by the same splits both times; a split that was not counted is an error, never a lost row.

Defined cases: null or empty text is one sequence of ``end_id`` only.  An empty table gives no shards.  Rows that
repeat a ``doc_id`` are written each.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .frames import slices
from .permutation import permuted


@dataclass(frozen=True)
class ShardParams:
    length: int = 512  # tokens of a sequence
    shard_rows: int = 8192
    end_id: int = 50256
    seed: int = 9176
    most_tasks: int = 20_000  # of the shuffle; fewer shards have a task each
    broadcast_splits: int = 500_000  # offsets (24 bytes each) that are sent to every task

    @property
    def stride(self) -> int:
        return 2 * self.length


# encode(texts) -> for each text its ids as little-endian unsigned 32-bit integers
Encoder = Callable[[list], list[bytes]]
SIZES = "file bigint, begin bigint, n bigint"
CUT = "file bigint, begin bigint, place bigint, doc_id bigint, seq int, record binary"


def _sized(encoder: Callable[[], Encoder], p: ShardParams):
    """Number of records of each part of a split."""
    def run(batches):
        encode = encoder()
        for batch in batches:
            for piece in slices(batch, "text"):
                n = [len(coded) // 4 // p.length + 1 for coded in encode(piece.column("text").to_pylist())]  # with the closing token
                yield pa.RecordBatch.from_arrays([piece.column("file"), piece.column("begin"), pa.array(n, pa.int64())], ["file", "begin", "n"])

    return run


def _cut(encoder: Callable[[], Encoder], p: ShardParams):
    """The records of each text, unfilled, with their place in the split."""
    def run(batches):
        encode, current, place = encoder(), None, 0
        for batch in batches:
            for piece in slices(batch, "text"):
                files, begins, ids = (piece.column(c).to_pylist() for c in ("file", "begin", "doc_id"))
                out: list[list] = [[] for _ in range(6)]
                for k, coded in enumerate(encode(piece.column("text").to_pylist())):
                    here = (files[k], begins[k])
                    if here != current:  # a split's rows come together and in order
                        current, place = here, 0
                    tokens = np.append(np.frombuffer(coded, "<u4"), np.uint32(p.end_id))
                    if tokens.max() > 0xFFFF:
                        raise ValueError("token id beyond 16 bits")
                    raw = tokens.astype("<u2").tobytes()
                    for seq, at in enumerate(range(0, len(raw), p.stride)):
                        for column, value in zip(out, (*here, place, ids[k], seq, raw[at:at + p.stride])):
                            column.append(value)
                        place += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                                 ["file", "begin", "place", "doc_id", "seq", "record"])

    return run


def shards(spark: SparkSession, path: str, encoder: Callable[[], Encoder], p: ShardParams = ShardParams()) -> DataFrame:
    """(slot, shard, offset, doc_id, seq, n_tokens, record) of the Parquet table at ``path``, dealt and sorted by slot."""
    file = F.col("_metadata.file_path")
    rows = spark.read.parquet(path).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(file).alias("file"),
        F.col("_metadata.file_block_start").alias("begin"), file.alias("name"))
    sizes = rows.select("text", "file", "begin").mapInArrow(_sized(encoder, p), SIZES).groupBy("file", "begin").agg(F.sum("n").alias("n"))
    # one row for each split that was read; files are numbered by name and named by its hash from here on
    names = rows.select("file", "name").distinct()
    before = F.sum("n").over(Window.orderBy("name", "begin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(sizes.join(names, "file").select("file", "begin", "n", F.coalesce(before, F.lit(0)).alias("before")))
    total, n_splits = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    offsets = offsets.select("file", "begin", "before")
    if n_splits <= p.broadcast_splits:
        offsets = F.broadcast(offsets)
    cut = rows.select("text", "doc_id", "file", "begin").mapInArrow(_cut(encoder, p), CUT).join(offsets, ["file", "begin"], "left")
    known = F.coalesce("before", F.raise_error(F.lit("a split was not counted: read with the same split sizes")).cast("bigint"))
    placed = permuted(cut.select("doc_id", "seq", "record", (known + F.col("place")).alias("number")), "number", "slot", total, p.seed)
    n_shards = max(1, -(-total // p.shard_rows))
    tasks = min(n_shards, p.most_tasks)
    shard = F.floor(F.col("slot") / p.shard_rows).cast("bigint")
    dealt = (placed.select("slot", "doc_id", "seq", "record")
             .repartitionById(tasks, F.floor(shard * tasks / n_shards).cast("int")).sortWithinPartitions("slot"))
    # records travel as they are and are filled up where they arrive
    filling = F.lit(p.end_id.to_bytes(2, "little"))
    return dealt.select("slot", shard.alias("shard"), (F.col("slot") % p.shard_rows * p.stride).alias("offset"), "doc_id", "seq",
                        (F.octet_length("record") / 2).cast("int").alias("n_tokens"), F.rpad("record", p.stride, filling).alias("record"))


# what an index file holds for each slot of its shard
INDEX = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4"), ("known", "u1")])
ROWS = "slot bigint, shard bigint, offset bigint, doc_id bigint, seq int, n_tokens int, record binary, record_sha256 string"
READ_ROWS = 1024


def _index(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, INDEX)
    for name in ("doc_id", "seq", "n_tokens"):
        out[name] = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)
    out["known"] = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    return out


def write_shards(placed: DataFrame, folder: str, p: ShardParams = ShardParams()) -> DataFrame:
    """Write each shard as one file of records and one of index rows under ``folder``; returns stored (shard, n_rows, file).

    A file is written under its final name only when whole, so a lost task leaves no half shard and is just repeated.
    """
    def run(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        open_shard, sinks, count = None, {}, 0

        def close():
            name = f"{root}/shard-{open_shard:08d}"
            for ending in (".idx", ".bin"):
                temporary, sink = sinks[ending]
                sink.close()
                store.move(temporary, name + ending)
            return pa.RecordBatch.from_arrays([pa.array([open_shard]), pa.array([count]), pa.array([f"{name}.bin"])], ["shard", "n_rows", "file"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            index, records = _index(batch), batch.column("record").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(cuts[:-1], cuts[1:]) if len(shard) else ():
                if shard[lo] != open_shard:
                    if sinks:
                        yield close()
                    open_shard, count = int(shard[lo]), 0
                    sinks = {ending: (name, store.open_output_stream(name)) for ending in (".idx", ".bin") for name in [f"{root}/part-{uuid.uuid4().hex}"]}
                sinks[".idx"][1].write(index[lo:hi].tobytes())
                sinks[".bin"][1].write(b"".join(records[lo:hi]))
                count += hi - lo
        if sinks:
            yield close()

    return stage(placed.select("shard", "doc_id", "seq", "n_tokens", "record").mapInArrow(run, "shard bigint, n_rows bigint, file string"))


def read_shards(written: DataFrame, folder: str, p: ShardParams = ShardParams()) -> DataFrame:
    """(slot, shard, offset, doc_id, seq, n_tokens, record, record_sha256) read from the files of ``written`` shards.

    Each part of ``READ_ROWS`` slots is read by its place in the file, as a reader does that resumes there.
    """
    def run(batches):
        import hashlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, n_rows in zip(batch.column("shard").to_pylist(), batch.column("n_rows").to_pylist()):
                name = f"{root}/shard-{shard:08d}"
                with store.open_input_file(f"{name}.bin") as records, store.open_input_file(f"{name}.idx") as index:
                    if (records.size(), index.size()) != (n_rows * p.stride, n_rows * INDEX.itemsize):
                        raise ValueError(f"shard {shard} has not the size of {n_rows} records")
                    for first in range(0, n_rows, READ_ROWS):
                        n = min(READ_ROWS, n_rows - first)
                        raw = records.read_at(n * p.stride, first * p.stride)
                        side = np.frombuffer(index.read_at(n * INDEX.itemsize, first * INDEX.itemsize), INDEX)
                        held = [raw[i * p.stride:(i + 1) * p.stride] for i in range(n)]
                        place = np.arange(first, first + n)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard * p.shard_rows + place), pa.array(np.full(n, shard)), pa.array(place * p.stride), pa.array(side["doc_id"], mask=side["known"] == 0),
                             pa.array(side["seq"]), pa.array(side["n_tokens"]), pa.array(held, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in held])],
                            ["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "record", "record_sha256"])

    # a task for each shard, up to some thousands
    tasks = max(1, min(5000, written.count()))
    return written.select("shard", "n_rows").repartition(tasks, "shard").mapInArrow(run, ROWS)


def read_from(folder: str, slot: int, p: ShardParams = ShardParams()):
    """Records from ``slot`` on, in training order, straight from the shard files."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    shard, skip = divmod(slot, p.shard_rows)
    while store.get_file_info(name := f"{root}/shard-{shard:08d}.bin").type == fs.FileType.File:
        with store.open_input_file(name) as file:
            file.seek(skip * p.stride)
            while record := file.read(p.stride):
                yield np.frombuffer(record, "<u2")
        shard, skip = shard + 1, 0
