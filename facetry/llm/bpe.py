"""Byte-pair encoding and decoding with contiguous rank arrays.

A text is cut into pre-tokens by the vocabulary's pattern; pre-tokens are short words that repeat, so the distinct
new ones of a piece of text are encoded together: one row for each word holds its parts and one the rank of each
pair of neighbouring parts.  Again and again the smallest rank of each row is found (leftmost first), that boundary
is deleted, and the ranks beside it are looked up anew, until no pair has a rank.  Words of more than
``LONG_WORD`` bytes use the same rule with a heap, in n log n steps.

Encoding is a map over the texts: no shuffle.  A worker keeps at most ``MEMO`` words.  The tokenizer file is a
parameter and is read by the tasks; it must stand at the same path on all machines.

Defined cases: null text encodes as empty, to no tokens; the strings of special tokens in a text become those
tokens, as the vocabulary's library does by default.  Bytes that are no UTF-8 decode to U+FFFD.  Other columns are
not read; rows that repeat a ``doc_id`` are encoded each.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_batch

# Fixed value: the published pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
LONG_WORD = 64
MEMO = 100_000
NONE = np.int64(1) << 40  # rank of a pair that is not in the vocabulary


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: a byte that prints stands for itself, the others
    follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def newer_letters() -> tuple[str, str]:
    """Letters and digits that the regex library knows beyond the character table that the vocabularies use."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = []
    for kind in "LN":
        own = regex.findall(rf"\p{{{kind}}}", every)
        found.append("".join(c for c in own if unicodedata.category(c)[0] != kind))
    return found[0], found[1]


@lru_cache(2)
def pretokens(exact: bool) -> regex.Pattern:
    """The pattern; ``exact`` also for characters of newer Unicode versions, which is slower."""
    if not exact:
        return regex.compile(PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{l}", r"\p{L}").replace("{n}", r"\p{N}"))
    letters, digits = ("".join(map(regex.escape, x)) for x in newer_letters())
    parts = {"{L}": rf"[\p{{L}}--[{letters}]]", "{N}": rf"[\p{{N}}--[{digits}]]" if digits else r"\p{N}"}
    rest = rf" ?[[^\s\p{{L}}\p{{N}}]||[{letters}{digits}]]+"
    text = PATTERN.replace(r" ?[^\s{l}{n}]+", rest)
    for key, value in parts.items():
        text = text.replace(key, value)
    return regex.compile(text, regex.V1)


NEWER = regex.compile("[԰-\U0010ffff]")  # all newer letters lie here


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(map(letters.__getitem__, t)) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def short_words(self, words: list[bytes]) -> list[bytes]:
        """Words of one length, encoded together."""
        n, width = len(words), len(words[0])
        part = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(n, width)]
        rank = self.rank(part[:, :-1], part[:, 1:])
        size = np.full(n, width)
        live = np.arange(n)
        while len(live):
            own = rank[live]
            at = own.argmin(axis=1)
            least = own[np.arange(len(live)), at]
            live, at, least = live[least < NONE], at[least < NONE], least[least < NONE]
            if not len(live):
                break
            old = part[live]
            part[live, :-1] = np.where(np.arange(width - 1) > at[:, None], old[:, 1:], old[:, :-1])
            part[live, at] = self.merged[least]
            size[live] -= 1
            old = rank[live]
            rank[live, :-1] = np.where(np.arange(width - 2) > at[:, None], old[:, 1:], old[:, :-1])
            rank[live, width - 2] = NONE
            for shift in (-1, 0):  # the pairs before and after the new part
                pair = at + shift
                ok = (pair >= 0) & (pair + 1 < size[live])
                to, p = live[ok], pair[ok]
                rank[to, p] = self.rank(part[to, p], part[to, p + 1])
            gone = at >= size[live] - 1
            rank[live[gone], at[gone]] = NONE
        flat = part.astype("<u4")
        return [row[:k].tobytes() for row, k in zip(flat, size.tolist())]

    def long_word(self, word: bytes) -> bytes:
        part = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        end = len(part)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        lookup = {k: r for k, r in zip(self.keys.tolist(), self.ranks.tolist())} if not hasattr(self, "_lookup") else self._lookup
        self._lookup = lookup
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := lookup.get((a << 32) | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] == a else end
            if j >= end or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < end and (q := lookup.get((part[left] << 32) | part[right])) is not None:
                    heapq.heappush(heap, (q, left, part[left], part[right]))
        return np.array([x for x in part if x >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode new words into the memo."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word.encode()), []).append(word)
        for size, same in by_size.items():
            raw = [w.encode() for w in same]
            if size == 1:
                coded = [self.of_byte[b[0]].astype("<u4").tobytes() for b in raw]
            elif size <= LONG_WORD:
                coded = self.short_words(raw)
            else:
                coded = [self.long_word(b) for b in raw]
            self.memo.update(zip(same, coded))

    def pieces(self, text: str) -> list[str]:
        return pretokens(NEWER.search(text) is not None and _has_newer(text)).findall(text)

    def encode(self, texts: list) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        rows, new = [], set()
        for text in texts:
            row = []
            for k, part in enumerate(self.split.split(text) if text and self.split and self.split.search(text) else [text or ""]):
                if k % 2:
                    row.append(([], [self.special[part].to_bytes(4, "little")]))
                    continue
                words = self.pieces(part)
                coded = list(map(self.memo.get, words))
                if None in coded:
                    new.update(w for w, c in zip(words, coded) if c is None)
                row.append((words, coded))
            rows.append(row)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        self.learn(new)
        return [b"".join([c if c is not None else self.memo[words[i]] for words, coded in row for i, c in enumerate(coded)])
                if new else b"".join([c for _, coded in row for c in coded]) for row in rows]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _has_newer(text: str) -> bool:
    return not set("".join(newer_letters())).isdisjoint(text)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the tokens of each text, little-endian unsigned 32-bit integers."""
    def kernel(batch):
        ids = vocabulary(path).encode(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(kernel), "doc_id bigint, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""
    def kernel(batch):
        voc = vocabulary(path)
        text = pa.array([voc.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(by_batch(kernel, "ids"), "doc_id bigint, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): tokens of each text and the digest of what they decode to."""
    back = decoded(encoded(docs, path), path)
    return back.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
