r"""Benchmark decontamination: a broadcast set of normalised test n-grams against all windows of all texts.

Words are runs of ASCII digits, lower-cased ASCII letters and all characters beyond ASCII.  A benchmark item gives
its windows of ``window`` consecutive words; an item with fewer words is one window.

Texts are read once, by SQL functions only.  Word hashes are combined by doubling (1, 2, 4, 8 words and from
these any length), so a window costs a handful of 64-bit operations.  A bit table of fixed size, made from the
benchmark, screens each window where it stands; the few that pass are stored with their words, row by row, in the
shared folder.  They are then joined with the benchmark's windows on hash and words: the join is the verification.
The window set is broadcast when it has at most ``broadcast_rows`` windows, else the join is a shuffled one.
More windows than the bit table serves cost speed only.

Defined cases: null text has no words; null or wordless items give no window; an item with a null id marks words
as hit but is not listed.  Items that repeat an id count once.  Rows that repeat a ``doc_id`` are scored each.
An empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .frames import packed, text_digest, unpacked

# What separates words once A-Z are lower-cased, and what a word is in the text as it stands.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class BenchmarkParams:
    window: int = 10
    filter_bits: int = 1 << 20  # of the screening table: 128 KiB in the plan
    broadcast_rows: int = 200_000


def lower_ascii(text: str) -> Column:
    """Lower-case A-Z only; texts without other letters take the fast built-in."""
    c = F.col(text)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_words(df: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")
    return df.withColumn("words", F.coalesce(words, F.array().cast("array<string>")))


def _joined(left: Column, right: Column, skip: int, count: Column) -> Column:
    """Hash of each run made of a run in ``left`` and the run of ``right`` that begins ``skip`` words later."""
    count = F.greatest(count, F.lit(0))
    return F.zip_with(F.slice(left, 1, count), F.slice(right, skip + 1, count), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns ``w<length>``: hashes of all runs of that many words, by starting word."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    power = 1
    while lengths and 2 * power <= max(lengths):
        df = df.withColumn(f"h{2 * power}", _joined(F.col(f"h{power}"), F.col(f"h{power}"), power, F.size("words") - 2 * power + 1))
        power *= 2
    for length in lengths:
        pieces = [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]
        covered, name = pieces[0], f"h{pieces[0]}"
        for piece in pieces[1:]:
            df = df.withColumn(f"_w{length}_{covered + piece}", _joined(F.col(name), F.col(f"h{piece}"), covered, F.size("words") - covered - piece + 1))
            covered += piece
            name = f"_w{length}_{covered}"
        df = df.withColumn(f"w{length}", F.col(name))
    return df


def _cut(position: Column, length: int) -> Column:
    return F.array_join(F.slice("words", position + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, p: BenchmarkParams) -> DataFrame:
    """(h, words, length, item): each window of each item."""
    items = with_words(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")), "text")
    items = with_window_hashes(items, list(range(1, p.window + 1)))
    parts = None
    for length in range(1, p.window + 1):
        own = items.filter(F.size("words") >= length if length == p.window else F.size("words") == length)
        rows = own.select("item", F.lit(length).alias("length"), F.explode(F.transform(f"w{length}", lambda h, i: F.struct(
            h.alias("h"), F.array_join(F.slice("words", i + 1, length), " ").alias("window")))).alias("x")).select("item", "length", "x.h", "x.window")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _bit_table(windows: DataFrame, p: BenchmarkParams) -> Column:
    """The screening table as an array of 64-bit words: ``filter_bits / 64`` of them at most."""
    cells = p.filter_bits // 64
    cell = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(cells - 1))
    got = windows.select(cell.alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    table = [0] * cells
    for cell, bits in got.groupBy("cell").agg(F.bit_or("bit")).collect():
        table[cell] = bits
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _passes(table: Column, h: Column, p: BenchmarkParams) -> Column:
    cell = F.get(table, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(p.filter_bits // 64 - 1)).cast("int"))
    return F.call_function("shiftright", cell, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def scanned(docs: DataFrame, benchmark: DataFrame, p: BenchmarkParams = BenchmarkParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, items), all small and stored: every text with its word count, verified windows by row, and
    the items of each window."""
    all_windows = stage(benchmark_windows(benchmark, p))
    lengths = sorted(r[0] for r in all_windows.select("length").distinct().collect())
    table = _bit_table(all_windows, p)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_digest("text"), F.col("text").cast("string").alias("text"))
    texts = with_window_hashes(with_words(texts, "text"), lengths)
    found = F.array().cast("array<struct<pos:int,length:int,h:bigint,window:string>>")
    for n in lengths:
        h = F.col(f"w{n}")
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))), lambda i: _passes(table, F.get(h, i), p))
        found = F.concat(found, F.transform(at, lambda i: F.struct(
            i.alias("pos"), F.lit(n).alias("length"), F.get(h, i).alias("h"), _cut(i, n).alias("window"))))
    rows = stage(texts.select("doc_id", "k1", "k2", F.size("words").cast("bigint").alias("n_words"), found.alias("found"))
                 .withColumn("rid", F.monotonically_increasing_id()))

    windows = all_windows.select("h", "window").distinct()
    if all_windows.count() <= p.broadcast_rows:
        windows = F.broadcast(windows)
    hits = stage(rows.select("rid", "k1", "k2", F.inline("found")).join(windows, ["h", "window"]))
    return rows, hits, all_windows.select("h", "window", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, p: BenchmarkParams = BenchmarkParams()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    rows, hits, items = scanned(docs, benchmark, p)
    words = hits.select("rid", F.explode(F.sequence("pos", F.expr("pos + length - 1"))).alias("at")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    listed = (hits.select("rid", "h", "window").distinct().join(items, ["h", "window"]).groupBy("rid")
              .agg(F.array_sort(F.collect_set("item")).alias("items")))
    whole = rows.select("rid", "doc_id", "n_words").join(words, "rid", "left").join(listed, "rid", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, p: BenchmarkParams = BenchmarkParams()) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark window."""
    _, hits, _ = scanned(docs, benchmark, p)
    k1, k2 = text_digest("text")
    left = packed(docs, t_k1=k1, t_k2=k2).join(hits.select(F.col("k1").alias("t_k1"), F.col("k2").alias("t_k2")).distinct(), ["t_k1", "t_k2"], "left_anti")
    return unpacked(left)


def without_passages(docs: DataFrame, benchmark: DataFrame, p: BenchmarkParams = BenchmarkParams()) -> DataFrame:
    """All rows of ``docs``; words inside benchmark windows are cut from the texts, what stands between words stays."""
    _, hits, _ = scanned(docs, benchmark, p)
    spots = (hits.select("k1", "k2", F.explode(F.sequence("pos", F.expr("pos + length - 1"))).alias("at")).distinct()
             .groupBy(F.col("k1").alias("t_k1"), F.col("k2").alias("t_k2")).agg(F.collect_set("at").alias("spots")))
    k1, k2 = text_digest("text")
    rows = packed(docs, t_k1=k1, t_k2=k2, whole=F.col("text").cast("string")).join(spots, ["t_k1", "t_k2"], "left")
    between = F.split("whole", WORD, -1)
    kept = F.transform(F.regexp_extract_all("whole", F.lit(WORD), F.lit(0)), lambda w, i: F.concat(
        F.when(F.array_contains("spots", i), F.lit("")).otherwise(w), F.get(between, i + 1)))
    rebuilt = F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    rows = rows.withColumn("whole", F.when(F.col("spots").isNull(), F.col("whole")).otherwise(rebuilt))
    return rows.select(*[(F.col("whole") if f == "text" else F.col("row").getField(f)).alias(f) for f in docs.columns])
