r"""Removal of repeated passages by level-wise doubling.

A window of ``window`` words is repeated only if the shorter windows in it are.  Windows of ``start`` words are counted
first; only where they are repeated alone are they extended to twice the length, and so on until nothing is repeated or
the length is ``window``.  At ``window`` the first place of each repeated word sequence is kept (smallest ``doc_id``, then
the earliest start), and the words covered by a window at any other place are removed.

The first level does not send every window: of the short windows inside a longest one the smallest hash is taken, at
most one in six positions of plain text.  Equal long windows choose equal short ones, so nothing is lost.

Texts are moved once: they are dealt by range of ``doc_id`` into groups of about ``group_bytes`` and written to a bucketed
table.  A level is then two small exchanges.  Each group sends the distinct hashes of its candidates, packed, to ranges of
the hash space; a range compares its groups' lists and sends one bit for each hash back.  A passage that a third of all
texts share is one hash in each group, and no task sees more than a group or a range.  Groups follow each other in the
order of ``doc_id``, so the first place of a window is in the first group that has it.  Windows are named by 96 bits.

Defined cases: null text has no words.  Texts of fewer than ``window`` words lose nothing.  Null ``doc_id`` stands before
all others.  Rows that repeat a ``doc_id`` are ordered by a hash of the text, then as read.  Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, stage
from . import wordarrays as W
from .frames import text_digest

WORD = re.compile("[^\x20\x09-\x0d]+")


@dataclass(frozen=True)
class RepeatParams:
    window: int = 20  # words of a window that may stand only once; ``start`` times a power of two
    start: int = 10
    group_bytes: int = 1 << 22  # of text in a group, on average
    range_bytes: int = 1 << 24  # of text for each range of the hash space
    seed: int = 11

    def levels(self) -> list[int]:
        out = [self.start]
        while out[-1] < self.window:
            out.append(2 * out[-1])
        if out[-1] != self.window or len(out) < 2:
            raise ValueError("window must be start times a power of two")
        return out


LEAST_RANGES = 128
MOST_BUCKETS = 100_000  # Spark's own bound
SENT = "range int, grp int, hashes binary, names binary"
BITS = "grp int, range int, level int, bits binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def grouped(docs: DataFrame, p: RepeatParams) -> tuple[DataFrame, int]:
    """Texts in groups along ``doc_id``, as a bucketed table in the shared folder, and the number of hash ranges."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("rid")).withColumns(dict(zip(("k1", "k2"), text_digest("text"))))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups, ranges = 1 + size // p.group_bytes, max(LEAST_RANGES, 1 << (size // p.range_bytes).bit_length())
    rows = rows.repartitionByRange(groups, "doc_id", "k1", "k2", "rid").withColumn("grp", F.spark_partition_id())
    name = f"texts_{uuid.uuid4().hex}"
    (rows.write.bucketBy(min(groups, MOST_BUCKETS), "grp").sortBy("grp").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name))
    held = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only; the files stay as those of any staged table
    return held, ranges


class Group:
    """Words of a group's texts, in the order of the windows' places."""

    def __init__(self, texts: list[str], p: RepeatParams):
        self.p, self.n_rows = p, len(texts)
        hashes, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for lo, hi in W.chunks(texts):
            points, first = W.code_points(texts[lo:hi])
            start, end = W.word_spans(W.is_space(points))
            hashes.append(W.word_hashes(points, start, end))
            rows.append(lo + np.searchsorted(first, start, side="right") - 1)
        self.words, self.row = np.concatenate(hashes), np.concatenate(rows)

    def inside(self, size: int) -> np.ndarray:
        """Places where a window of ``size`` words lies in one text."""
        n = max(0, len(self.words) - size + 1)
        return self.row[:n] == self.row[len(self.row) - n:]

    def hashed(self, size: int, seed: int = 0) -> np.ndarray:
        """Hash of the window of ``size`` words at each place, doubled from the shorter ones."""
        width = self.p.start
        factor = W.odd_numbers(width + 2, self.p.seed + seed)
        n = max(0, len(self.words) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out += self.words[k:k + n] * factor[k]
        out = W.spread(out)
        while width < size:
            m = max(0, len(out) - width)
            out = W.spread(out[:m] * factor[-2] + out[len(out) - m:] * factor[-1])
            width *= 2
        return out


def slid(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over ``width`` neighbours, from each place on."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        m = max(0, len(out) - step)
        out = of(out[:m], out[len(out) - m:])
        done += step
    return out


def least_inside(group: Group, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of windows of twice the first length, place of the smallest short window in each)."""
    width = group.p.start + 1
    places = np.flatnonzero(group.inside(2 * group.p.start))
    least = slid(short, width, np.minimum)[places]
    at = places.copy()
    for k in range(1, width):
        same = short[places + k] == least
        at[same] = places[same] + k
    return places, at


@dataclass
class Candidates:
    """Candidate windows of one level in one group, and their distinct hashes in order."""

    places: np.ndarray  # ascending
    entry: np.ndarray  # number of each candidate's distinct window
    hashes: np.ndarray
    names: np.ndarray
    count: np.ndarray  # candidates of each distinct window
    first: np.ndarray  # first place of each

    def ranges(self, ranges: int) -> np.ndarray:
        """Where the entries of each range of the hash space begin."""
        own = ((self.hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        return np.searchsorted(own, np.arange(ranges + 1, dtype=np.uint64))

    def flags(self, bits: dict[int, bytes], ranges: int) -> np.ndarray:
        """The bits that came back, one for each entry."""
        out, edge = np.zeros(len(self.hashes), bool), self.ranges(ranges)
        for r, packed in bits.items():
            out[edge[r]:edge[r + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=edge[r + 1] - edge[r])
        return out


def distinct(places: np.ndarray, hashes: np.ndarray, names: np.ndarray) -> Candidates:
    order = np.lexsort((names, hashes))  # stable, so the first of equal ones is the first place
    h, g = hashes[order], names[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(new) - 1
    return Candidates(places, entry, h[at], g[at], np.diff(np.append(at, len(h))), places[order[at]])


def candidates(group: Group, level: int, bits: dict[int, dict[int, bytes]], ranges: int) -> Candidates:
    """Candidates of ``level``, given the bits that came back for the levels below."""
    p, short = group.p, group.hashed(group.p.start)

    def found_at(places: np.ndarray, hashes: np.ndarray, size: int) -> Candidates:
        names = group.hashed(size, 1)[places].astype(np.uint32) if size == p.window else np.zeros(len(places), np.uint32)
        return distinct(places, hashes[places], names)

    def repeated(found: Candidates, size: int) -> np.ndarray:
        return ((found.count > 1) | found.flags(bits.get(size, {}), ranges))[found.entry]

    places, least = least_inside(group, short)
    found = found_at(np.unique(least), short, p.start)
    if level == p.start:
        return found
    alive, size = places[repeated(found, p.start)[np.searchsorted(found.places, least)]], 2 * p.start
    while True:
        found = found_at(alive, group.hashed(size), size)
        if size == level:
            return found
        lives = np.zeros(len(group.words) + size, bool)
        lives[alive[repeated(found, size)]] = True
        both = np.flatnonzero(lives[:-size] & lives[size:])
        inside = group.inside(2 * size)
        alive, size = both[(both < len(inside)) & inside[np.minimum(both, len(inside) - 1)]] if len(inside) else both[:0], 2 * size


def in_order(table: pa.Table) -> pa.Table:
    keys = [(c, "ascending") for c in ("doc_id", "k1", "k2", "rid")]
    return table.take(pa.compute.sort_indices(table, sort_keys=keys, null_placement="at_start"))


def _bits(table: pa.Table | None) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for row in table.to_pylist() if table is not None else []:
        out.setdefault(row["level"], {})[row["range"]] = row["bits"]
    return out


def _sending(level: int, ranges: int, p: RepeatParams):
    """Distinct candidates of a group, packed for each range."""
    def kernel(texts: pa.Table, bits: pa.Table | None) -> pa.Table:
        grp = texts.column("grp")[0].as_py()
        found = candidates(Group(in_order(texts).column("text").to_pylist(), p), level, _bits(bits), ranges)
        edge = found.ranges(ranges)
        full = np.flatnonzero(np.diff(edge))
        parts = [slice(edge[r], edge[r + 1]) for r in full]
        last = level == p.window
        return pa.table({"range": pa.array(full, pa.int32()), "grp": pa.array([grp] * len(full), pa.int32()),
                         "hashes": pa.array([found.hashes[x].tobytes() for x in parts], pa.binary()),
                         "names": pa.array([found.names[x].tobytes() if last else b"" for x in parts], pa.binary())})

    return kernel


def _without_bits(send):
    def kernel(texts: pa.Table) -> pa.Table:
        return send(texts, None)

    return kernel


def _comparing(level: int, p: RepeatParams):
    """One bit for each hash of each list: another group has it, or, at the last level, an earlier group has it."""
    def kernel(table: pa.Table) -> pa.Table:
        grp = table.column("grp").to_numpy()
        lists = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = [len(x) for x in lists]
        h, owner = np.concatenate(lists), np.repeat(grp, size)
        g = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint32) if level == p.window else np.zeros(len(h), np.uint32)
        order = np.lexsort((owner, g, h))
        same = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        flag = np.zeros(len(h), bool)
        flag[order[1:]] = same
        if level != p.window:
            flag[order[:-1]] |= same
        rows = [(i, f) for i, f in enumerate(np.split(flag, np.cumsum(size)[:-1])) if f.any()]
        return pa.table({"grp": pa.array([grp[i] for i, _ in rows], pa.int32()), "range": table.column("range").slice(0, len(rows)),
                         "level": pa.array([level] * len(rows), pa.int32()), "bits": pa.array([np.packbits(f).tobytes() for _, f in rows], pa.binary())})

    return kernel


def _removing(ranges: int, p: RepeatParams):
    def kernel(texts: pa.Table, bits: pa.Table) -> pa.Table:
        texts = in_order(texts)
        strings = texts.column("text").to_pylist()
        group = Group(strings, p)
        found = candidates(group, p.window, _bits(bits), ranges)
        again = (found.places != found.first[found.entry]) | found.flags(_bits(bits).get(p.window, {}), ranges)[found.entry]
        change = np.zeros(len(group.words) + 1, np.int64)
        change[found.places[again]] += 1
        change[found.places[again] + p.window] -= 1
        kept = np.cumsum(change[:-1]) == 0
        n_words = np.bincount(group.row, minlength=group.n_rows)
        n_removed = np.bincount(group.row[~kept], minlength=group.n_rows)
        first = np.cumsum(n_words) - n_words
        left = []
        for text, at, n, gone in zip(strings, first, n_words, n_removed):
            words = WORD.findall(text)
            left.append(" ".join(compress(words, kept[at:at + n]) if gone else words))
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(left, pa.string())})

    return kernel


def without_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of ``docs``; ``kept`` is what is left, words joined by one space."""
    levels = p.levels()
    texts, ranges = grouped(docs, p)
    bits = None
    for level in levels:
        send = _sending(level, ranges, p)
        if bits is None:
            sent = texts.groupBy("grp").applyInArrow(_without_bits(send), SENT)
        else:
            sent = texts.groupBy("grp").cogroup(bits.groupBy("grp")).applyInArrow(send, SENT)
        back = stage(sent.groupBy("range").applyInArrow(_comparing(level, p), BITS))
        bits = back if bits is None else bits.unionByName(back)
    return texts.groupBy("grp").cogroup(bits.groupBy("grp")).applyInArrow(_removing(ranges, p), RESULT)
