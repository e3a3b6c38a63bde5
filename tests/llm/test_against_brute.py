"""Operators without a SQL counterpart against their libraries or plain versions."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from facetry.llm import bpe, decontaminate, licenses, near_dedup, quality, secrets, token_counts, token_shards, wordarrays
from facetry.llm.frames import in_groups
from facetry.llm.permutation import Grid, numbered, permuted
from pyspark.sql import functions as F

from . import brute, texts

JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
RARE = ["՘֋1౜ ₏꟎x", "\U000323b0\U00033479 \U0001df1f", "'s it's     x　\u0085", "中文１٣ กำ", "a" * 300 + " " * 70 + "=" * 200,
        "\U0001f600" * 80, "x<|endoftext|><|endoftext|>y <|endof text|>", "\r\n\r\n \tq \n", "�​́é"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("rows", [texts.rows() + [(5000 + i, t) for i, t in enumerate(RARE)], []], ids=["all", "empty"])
def test_bpe(docs_of, rows):
    got = bpe.round_trip(docs_of(rows), JSON).collect()
    want = [(i, packed_ids(library_ids(t)), brute.sha(LIBRARY.decode(library_ids(t), skip_special_tokens=False))) for i, t in rows]
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in got) == sorted(want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(text):
    voc = bpe.vocabulary(JSON)
    assert voc.encode([text])[0] == packed_ids(library_ids(text))
    assert voc.decode(voc.encode([text])[0]) == text


def test_bpe_long_words_and_full_memo(monkeypatch):
    rng, voc = random.Random(4), bpe.Vocabulary(JSON)
    monkeypatch.setattr(bpe, "MEMO", 50)
    for n in (2, 3, 63, 64, 65, 66, 200, 5000):
        word = "".join(rng.choice("abcdeinrst") for _ in range(n))
        assert voc.encode([word, word + " " + word]) == [packed_ids(library_ids(t)) for t in (word, word + " " + word)]
    assert len(voc.memo) <= 50


def test_bpe_decodes_broken_bytes():
    assert bpe.vocabulary(JSON).decode(packed_ids(library_ids("é")[:1] + [220])) == LIBRARY.decode(library_ids("é")[:1] + [220], skip_special_tokens=False)


@pytest.mark.parametrize("ranks", [None, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_token_counts(spark, docs_of, tmp_path, ranks):
    rows = texts.rows() + [(5000 + i, t) for i, t in enumerate(RARE)]
    p, cache = token_counts.CountParams(JSON, ranks, limit=20), f"file://{tmp_path}/cache"
    want = sorted((i, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 20) for i, t in rows)
    assert sorted(map(tuple, token_counts.counts(docs_of(rows), cache, p).collect())) == want
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == len({t or "" for _, t in rows})
    # a full cache encodes nothing more, a new text is added, another version is apart
    assert sorted(map(tuple, token_counts.counts(docs_of(rows), cache, p).collect())) == want
    assert spark.read.parquet(cache).count() == held.count()
    token_counts.counts(docs_of([*rows, (9999, "a text not seen before"), (9998, "a text not seen before")]), cache, p)
    assert spark.read.parquet(cache).count() == held.count() + 1
    assert token_counts.counts(docs_of([]), cache, p).count() == 0


def test_token_counts_of_pieces(docs_of, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in texts.rows() if t != texts.LONG]
    got = token_counts.counts(docs_of(rows), f"file://{tmp_path}/cache", token_counts.CountParams(path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(model.encode(t or ""))) for i, t in rows)


def plain_licenses(text, p=licenses.LicenseParams()):
    """All windows of all templates, compared shingle by shingle."""
    words, out = licenses.plain_words(text or ""), []
    for name, notice in licenses.TEMPLATES.items():
        t = licenses.plain_words(notice)
        m, w, step = len(t), min(5, len(t)), max(1, len(t) // p.steps)
        want = {tuple(t[i:i + w]) for i in range(m - w + 1)}
        spans = []
        for at in sorted({*range(0, len(words) - m + 1, step), max(0, len(words) - m)}):
            lo, hi = max(0, at - step), min(len(words), at + m + step)
            spots = [i for i in range(lo, hi - w + 1) if tuple(words[i:i + w]) in want]
            share = len({tuple(words[i:i + w]) for i in spots})
            if 100 * share >= p.percent * len(want):
                spans.append([min(spots), max(spots) + w, 100 * share // len(want)])
        merged = []
        for s in sorted(spans):
            if merged and s[0] < merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], s[1]), max(merged[-1][2], s[2])]
            else:
                merged.append(s)
        out += [(name, *s) for s in merged]
    return sorted(out)


def test_licenses(docs_of):
    rng, rows = random.Random(8), texts.rows()
    for k, notice in enumerate(licenses.TEMPLATES.values()):
        for changed in (0, 1, 3, 8):
            w = notice.split()
            for i in rng.sample(range(len(w)), min(changed, len(w))):
                w[i] = "other"
            rows.append((7000 + 10 * k + changed, " ".join([*texts.words(rng.randrange(40), k), *w, *texts.words(30, k + 50), *notice.upper().split()])))
            rows.append((8000 + 10 * k + changed, " ".join(w)))
    got = licenses.matches(docs_of(rows)).collect()
    assert sorted((r.doc_id, sorted((x.name, x.start, x.end, x.percent) for x in r.found)) for r in got) == sorted((i, plain_licenses(t)) for i, t in rows)
    assert licenses.matches(docs_of([])).count() == 0


def test_whole_license_texts(docs_of):
    """Each whole text is found by name inside another text, with a word changed here and there."""
    names = ["apache-2.0-text", "bsd-2-clause-text", "bsd-3-clause-text", "cc-by-sa-4.0-text", "cc0-1.0-text", "gpl-2.0-text", "gpl-3.0-text", "isc-text",
             "lgpl-2.1-text", "lgpl-3.0-text", "mit-text", "mpl-2.0-text", "agpl-3.0-notice", "apache-2.0-notice", "gpl-3.0-notice", "mpl-2.0-notice"]
    rows = []
    for k, name in enumerate(names):
        w = licenses.plain_words(licenses.TEMPLATES[name])
        rows.append((k, " ".join([*texts.words(77, k), *texts.edited(w, range(30, len(w), 60)), *texts.words(30, k + 50)])))
    got = {r.doc_id: {x.name: x.percent for x in r.found} for r in licenses.matches(docs_of(rows)).collect()}
    assert [name for k, name in enumerate(names) if got[k].get(name, 0) < 80] == []


def test_cut_notices(docs_of):
    """A text that is a notice without some first, last or middle words is one window, whatever its length."""
    rows, want = [(0, "under the Apache License, Version 2.0")], [(0, "apache-2.0", 75)]
    for k, name in enumerate(["mit-grant", "apache-2.0-header", "isc-text", "gpl-3.0-notice", "apache-2.0-text"]):
        w = licenses.plain_words(licenses.TEMPLATES[name])
        cut = len(w) // 8
        rows += [(10 * k + 1, " ".join(w[cut:])), (10 * k + 2, " ".join(w[:-cut])), (10 * k + 3, " ".join(w[:30] + w[30 + cut // 2:])), (10 * k + 4, " ".join(w[:len(w) // 2]))]
        want += [(10 * k + i, name, None) for i in (1, 2, 3)]
    got = licenses.matches(docs_of(rows)).collect()
    found = {(r.doc_id, x.name): x.percent for r in got for x in r.found}
    assert [w for w in want if found.get(w[:2]) is None or w[2] not in (None, found[w[:2]])] == []
    assert sorted((r.doc_id, sorted((x.name, x.start, x.end, x.percent) for x in r.found)) for r in got) == sorted((i, plain_licenses(t)) for i, t in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000])
def test_permutation(spark, n):
    rows = permuted(spark.range(n), "id", "place", n, 5).collect()
    assert sorted(r.place for r in rows) == list(range(n))
    if n > 50:
        other = permuted(spark.range(n), "id", "place", n, 6).collect()
        assert sum(a.place == b.place for a, b in zip(sorted(rows), sorted(other))) < n / 5
        assert sum(r.place == r.id for r in rows) < n / 5
    assert Grid(n, 5).a * Grid(n, 5).b < n + Grid(n, 5).a


def test_numbers_of_equal_rows(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(7,)] * 300 + [(1,)], "k int").repartition(7)
    got = sorted(numbered(df, ["k"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(306)) and [r.k for r in got] == [None] * 5 + [1] + [7] * 300


@pytest.fixture
def stored_docs(tmp_path):
    def make(rows, per_file):
        folder = tmp_path / f"docs{per_file}.parquet"
        folder.mkdir()
        for k in range(0, max(1, len(rows)), per_file):
            part = rows[k:k + per_file]
            pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([t for _, t in part], pa.string()),
                                     "slot": pa.array([1] * len(part))}), folder / f"part-{k:05d}.parquet", row_group_size=3)
        return f"file://{folder}"
    return make


def plain_records(rows, p):
    out = []
    for i, t in rows:
        ids = library_ids(t) + [p.end_id]
        for seq in range(0, -(-len(ids) // p.length)):
            part = ids[seq * p.length:(seq + 1) * p.length]
            out.append((i, seq, len(part), np.array(part + [p.end_id] * (p.length - len(part)), "<u2").tobytes()))
    return out


def test_token_shards(spark, stored_docs, tmp_path):
    p = token_shards.ShardParams(length=16, shard_rows=10)
    rows = [(i, t) for i, t in texts.rows() if t != texts.LONG]
    encoder = lambda: bpe.vocabulary(JSON).encode
    path = stored_docs(rows, 7)
    placed = token_shards.shards(spark, path, encoder, p)
    got = sorted(placed.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    assert sorted((r.doc_id, r.seq, r.n_tokens, bytes(r.record)) for r in got) == sorted(plain_records(rows, p))
    assert all((r.shard, r.offset) == (r.slot // 10, r.slot % 10 * 32) for r in got)
    # the same order whatever the splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        again = sorted(token_shards.shards(spark, path, encoder, p).collect(), key=lambda r: r.slot)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.slot, r.doc_id, r.seq) for r in again] == [(r.slot, r.doc_id, r.seq) for r in got]
    written = token_shards.write_shards(placed, f"file://{tmp_path}/shards", p)
    assert written.agg(F.sum("n_rows")).first()[0] == len(got)
    for start in (0, 9, 23, len(got) - 1):
        assert [x.tobytes() for x in token_shards.read_from(f"file://{tmp_path}/shards", start, p)] == [bytes(r.record) for r in got[start:]]
    assert token_shards.shards(spark, stored_docs([], 9), encoder, p).count() == 0


def test_token_shards_query_reads_its_files(spark, sf):
    """The registered query writes its shards and returns what the files hold."""
    from pathlib import Path

    from facetry.llm import queries
    from facetry.session import shared_folder

    p, held = token_shards.ShardParams(), Path(shared_folder(spark).removeprefix("file:"))
    before = set(held.glob("token-shards-*"))
    got = sorted(queries.op8(spark, sf).collect(), key=lambda r: r.slot)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.seq, r.n_tokens, bytes(r.record)) for r in got) == sorted(plain_records(rows, p))
    assert [(r.slot, r.shard, r.offset) for r in got] == [(i, i // p.shard_rows, i % p.shard_rows * p.stride) for i in range(len(got))]
    assert all(r.record_sha256 == hashlib.sha256(r.record).hexdigest() for r in got)
    [folder] = set(held.glob("token-shards-*")) - before
    assert sum(x.stat().st_size for x in folder.glob("shard-*.bin")) == len(got) * p.stride
    assert [x.tobytes() for x in token_shards.read_from(f"file://{folder}", 5, p)] == [bytes(r.record) for r in got[5:]]


def test_shards_of_rows_without_ids(spark, tmp_path):
    """Many small shards are read back whole, null ids too."""
    p = token_shards.ShardParams(length=2, shard_rows=3)
    rows = [(i, i // 3, i % 3 * 4, None if i % 4 == 0 else i - 5, i, 1 + i % 2, bytes([i, 0, 7, 0])) for i in range(20)]
    placed = spark.createDataFrame(rows, "slot bigint, shard bigint, offset bigint, doc_id bigint, seq int, n_tokens int, record binary")
    placed = placed.repartitionByRange("shard").sortWithinPartitions("slot")
    folder = f"file://{tmp_path}/shards"
    got = token_shards.read_shards(token_shards.write_shards(placed, folder, p), folder, p).drop("record_sha256").collect()
    assert sorted(((*r[:6], bytes(r[6])) for r in got), key=lambda r: r[0]) == rows


def test_near_rows_without_ids(docs_of):
    """Null ids are linked but never the smallest; repeated ids each have a row; large buckets and families are cut into blocks."""
    near = [" ".join(texts.edited(texts.BASE, [k])) for k in range(12)]
    rows = [(None, near[0]), (None, "alone with no id at all here"), (8, near[1]), (8, near[1]), (8, "other text of the same id"), *((50 + k, t) for k, t in enumerate(near))]
    p = near_dedup.NearParams(bucket_block=3, family_block=4)
    got = near_dedup.components(docs_of(rows), p).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == sorted(
        [(-1, 196, 8, False), (-1, 3, -1, True), (8, 196, 8, True), (8, 196, 8, True), (8, 2, 8, True), *((50 + k, 196, 8, False) for k in range(12))])
    left = near_dedup.without_near_copies(docs_of(rows), p)
    assert left.columns == docs_of([]).columns
    assert sorted((r.doc_id or -1, r.text[:5]) for r in left.collect()) == [(-1, "alone"), (8, "other"), (8, near[1][:5])]


def test_one_row_of_each_component_stays(docs_of):
    """Also where the least id has several near texts, where no row has an id, and for texts without words."""
    near = [[" ".join(texts.edited(texts.words(200, seed), [k])) for k in range(4)] for seed in (31, 32)]
    rows = [*((8, t) for t in near[0][:3]), (9, near[0][3]), *((None, t) for t in near[1]), (None, near[1][0]), (3, ""), (4, " "), (None, None)]
    left = near_dedup.without_near_copies(docs_of(rows)).collect()
    kept = [[r for r in left if r.text in family] for family in near]
    assert [[r.doc_id for r in family] for family in kept] == [[8], [None]]
    assert sorted((r.doc_id or 0) for r in left if not (r.text or "").strip()) == [0, 3, 4]


def test_decontamination_modes(spark, docs_of):
    benchmark = spark.createDataFrame([(1, texts.ITEM)], "item_id bigint, text string")
    rows = [(1, f"Keep this. {texts.ITEM}! And this."), (2, "clean"), (3, None), (1, f"Keep this. {texts.ITEM}! And this.")]
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs_of(rows), benchmark).collect()) == [2, 3]
    cut = decontaminate.without_passages(docs_of(rows), benchmark)
    assert cut.columns == docs_of([]).columns
    assert sorted((r.doc_id, r.text and " ".join(r.text.split())) for r in cut.collect()) == [(1, "Keep this. ! And this."), (1, "Keep this. ! And this."), (2, "clean"), (3, None)]


def plain_redacted(text):
    if text is None:
        return None
    out, done = [], 0
    for a, k, b in sorted(brute.base_secrets(text) + brute.linked_secrets(text)):
        if a >= done:
            out.append(text[done:a] + f"[{secrets.KINDS[k]}]")
        done = max(done, b)
    return "".join(out) + text[done:]


def test_redaction(docs_of):
    got = secrets.redacted(docs_of(texts.rows()))
    assert got.columns == docs_of([]).columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted((i, plain_redacted(t) or "") for i, t in texts.rows())


def test_groups_across_batches():
    rows = [(0, 1)] * 3 + [(0, 2)] + [(1, 2)] * 6
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows[i:i + 2]]), pa.array([b for _, b in rows[i:i + 2]])], ["a", "b"]) for i in range(0, 10, 2)]
    got = [t.to_pydict() for t in in_groups(iter(batches), ["a", "b"])]
    assert sum(len(g["a"]) for g in got) == 10
    groups = [set(zip(g["a"], g["b"])) for g in got]
    assert all(not x & y for i, x in enumerate(groups) for y in groups[:i])


def test_chunks_cover_all_texts():
    sizes = ["x" * 5, None, "", "y" * 100, "z"]
    assert [i for lo, hi in wordarrays.chunks(sizes, 6) for i in range(lo, hi)] == list(range(5))


def test_pipeline(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    p = quality.QualityParams()
    rows = sorted(docs.items())
    scores = brute.quality_scores(rows, {r.doc_id for r in marks if r.quality == 1 and not r.toxic}, p.buckets, p.smoothing)
    rows = [r for r, (n, s) in zip(rows, scores) if not brute.base_quality(r[1])[5] and s >= p.threshold * n]
    near = brute.near_components(rows)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r, found in zip(rows, brute.contamination(rows, items)) if not found[1]]
    rows = [(i, plain_redacted(t)) for i, t in rows]
    want = [(i, packed_ids(library_ids(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in got) == sorted(want)


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs.limit(0), sf).schema.simpleString() == docs.schema.simpleString(), name
