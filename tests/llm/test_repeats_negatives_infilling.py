"""Repeated passages, hard negatives and infilling against SQL and plain versions, on all the odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from facetry.llm import hard_negatives, infilling, oracles, queries, repeats
from facetry.llm.hard_negatives import MiningParams
from facetry.llm.repeats import RepeatParams
from pyspark.sql import functions as F

from . import texts
from .conftest import as_sql, same

TABLE = "doc_id bigint, text varchar"
PASSAGE = texts.words(64, 5)


def shared():
    """A passage in a third of the texts at different places, copies, a text repeating itself, one that is all one word."""
    rows = [(i, " ".join(texts.words(30 + i, 500 + i, 4000) + PASSAGE[:20 + i] + texts.words(i, 900 + i, 4000))) for i in range(0, 44, 2)]
    rows += [(100 + i, " ".join(PASSAGE)) for i in range(6)] + [(200, " ".join(PASSAGE[:19])), (201, " ".join(PASSAGE[:20])), (202, "a " * 90)]
    return rows + [(203, " ".join(PASSAGE[40:] * 3)), (None, " ".join(PASSAGE[3:40])), (205, "\n".join(PASSAGE[5:40])), (206, " ".join(PASSAGE).upper())]


def left_of(rows, window):
    """Plain version: {doc_id: (words, removed, kept)} for rows with distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in order:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            win = tuple(w[i:i + window])
            if win in seen:
                gone.update(range(i, i + window))
            seen.add(win)
        out[doc_id] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def digests(df):
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@pytest.mark.parametrize("rows", [[r for r in texts.rows() if r[1] != "tie"], shared(), [], [(1, None)]], ids=["all", "shared", "empty", "null"])
@pytest.mark.parametrize("p", [RepeatParams(), RepeatParams(group_bytes=300, range_bytes=500)], ids=["one", "many"])
def test_repeats(docs_of, duck, rows, p):
    df = repeats.without_repeats(docs_of(rows), p)
    same(digests(df), as_sql(duck, oracles.repeats_sql(), documents=(TABLE, rows)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}
    assert got == left_of(rows, 20)


@pytest.mark.parametrize("p", [RepeatParams(16, 4, 300, 500), RepeatParams(16, 2, 300, 500), RepeatParams(8, 1, 1 << 20)])
def test_repeats_with_more_levels(docs_of, p):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(docs_of(shared()), p).collect()}
    assert got == left_of(shared(), p.window)


def test_repeats_of_equal_rows(docs_of):
    """One of equal rows stays whole, whatever their number; the window's length must be a doubled start."""
    text = " ".join(PASSAGE)
    got = repeats.without_repeats(docs_of([(7, text)] * 9 + [(None, "b " * 25)] * 2), RepeatParams(group_bytes=600)).collect()
    assert sorted(r.n_removed for r in got if r.doc_id == 7) == [0] + [64] * 8
    assert sorted(r.kept.count("b") for r in got if r.doc_id is None) == [0, 1]  # its own windows overlap
    with pytest.raises(ValueError):
        RepeatParams(20, 7).levels()


def test_repeats_moves_texts_once(spark, docs_of):
    plan = repeats.without_repeats(docs_of(shared()), RepeatParams(group_bytes=600))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


VECTORS = "vec_id bigint, embedding array<float>, label int, score bigint, tile int"


def vectors(seed=3, count=240, size=9):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) + (0.5 if i % 3 else 0) for _ in range(size)], rng.randrange(3)) for i in range(count)]
    rows += [(900, rows[0][1], 0), (1400, [0.0] * size, 1), (1500, rows[5][1], 2), (1501, rows[5][1], 1), (1502, rows[5][1], 2)]  # ties
    rows += [(1600, None, 1), (1700, [float("nan")] * size, 1), (1800, [float("inf")] * size, 1), (1900, [0.1, None], 1), (2000, rows[1][1], None)]
    return rows + [(None, rows[2][1], 1), (2100, [0.5, 0.5], 1), (2200, [], 2), (200, rows[7][1], 0), (200, rows[8][1], 0), (300, [1e4] * size, 1)]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("rows", [vectors(), [], vectors()[-12:-6], [(100, [0.5], 1)]], ids=["all", "empty", "none", "one"])
@pytest.mark.parametrize("p", [MiningParams(), MiningParams(tile_rows=2, strip_rows=17, block=1)], ids=["one", "grid"])
def test_negatives(spark, duck, rows, p):
    df = hard_negatives.mined(table_of(spark, rows), p)
    same(df, as_sql(duck, oracles.negatives_sql(), embeddings=("vec_id bigint, embedding float[], label int", rows)))


def test_negatives_of_frequent_label(spark, duck):
    """Anchors of one label that holds nearly all rows, equal vectors among them."""
    rows = [(i, [float(i % 5), 1.0], 8 if i % 10 else 1) for i in range(0, 1200)]
    df = hard_negatives.mined(table_of(spark, rows), MiningParams(strip_rows=100))
    same(df, as_sql(duck, oracles.negatives_sql(), embeddings=("vec_id bigint, embedding float[], label int", rows)))


@pytest.mark.parametrize("size,largest", [(1, 1), (9, 300), (64, 10**6), (700, 3 * 10**7), (3, 1_700_000_000)])
def test_scores_are_exact(size, largest):
    rng = np.random.default_rng(size)
    left, right = (rng.integers(-largest, largest + 1, (7, size)) for _ in range(2))
    left[0], right[0], right[1] = largest, largest, -largest
    primes = hard_negatives.primes_for(size, largest)
    got = hard_negatives.scores(hard_negatives.residues(left, primes), hard_negatives.residues(right, primes), primes)
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]
    assert got.tolist() == want and all((m // 2) ** 2 * min(size, hard_negatives.SPAN) < 2**24 for m in primes)


def test_scores_beyond_range(spark):
    with pytest.raises(ArithmeticError):
        hard_negatives.mined(table_of(spark, [(100, [1e30], 1), (101, [1.0], 1)]))


MARKED = [(5000, "has <P> inside"), (5001, "and <S>"), (5002, "<M>"), (None, " two words "), (None, "x")]


@pytest.mark.parametrize("rows", [texts.rows() + MARKED + shared(), [], [(1, None)]], ids=["all", "empty", "null"])
def test_infilling(docs_of, duck, rows):
    df = infilling.restored(infilling.infilled(docs_of(rows)))
    columns, want = as_sql(duck, oracles.infilling_sql(), documents=(TABLE, rows))
    same(df.select(*columns), (columns, want))
    got = df.collect()
    assert sorted((repr(r.doc_id), r.restored) for r in got) == sorted((repr(i), t or "") for i, t in rows)
    for r in got:
        assert hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256
        buffers = (r.restored, infilling.SENTINELS)
        assert "".join(buffers[x.buffer][x.start:x.end] for x in r.pieces) == r.output
    assert not rows[1:] or {r.form for r in got} == {"plain", "psm", "spm"}


def test_infilling_seeds_differ(docs_of):
    forms = [[r.form for r in infilling.infilled(docs_of(texts.rows()), infilling.FillParams(seed=s, percent=100)).orderBy("doc_id").collect()] for s in (1, 2)]
    assert forms[0] != forms[1] and "spm" in forms[0]


@pytest.mark.parametrize("name", ["op11_repeated_passages", "op12_hard_negatives", "op13_fill_in_middle"])
def test_registered(spark, sf, duck, name):
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    result = duck.execute(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(d[0] for d in result.description)
    same(df, ([d[0] for d in result.description], result.fetchall()))
