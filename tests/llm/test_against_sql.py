"""Operators with a SQL counterpart on texts with all the odd cases, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from facetry.llm import decontaminate, near_dedup, oracles, quality, queries, quotes, secrets, sharding

from . import brute, texts
from .conftest import as_sql, same

TABLE = "doc_id bigint, text varchar"
LABELS = "doc_id bigint, quality int, toxic int"
ITEMS = [(1, texts.ITEM), (2, texts.ITEM), (3, "Short ITEM"), (4, None), (5, " "), (None, "the quick brown fox"), (6, " ".join(texts.BASE[20:40]))]
MARKED = [(i, i % 3 != 0, i % 5 == 0) for i in range(0, 90)] + [(4, 0, 0), (None, 1, 0), (7, 1, None), (7, 1, None)]


def labels(spark, rows):
    return spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in rows], LABELS)


def test_quality_counts_every_good_text(spark):
    docs = spark.range(210_000).selectExpr("id as doc_id", "'word' as text")
    marked = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 10 = 0 as int) as toxic")
    assert [tuple(r)[1:] for r in quality.bucket_counts(docs, marked).collect()] == [(189_000, 210_000)]
    few = quality.QualityParams(broadcast_ids=10)  # ids joined by a shuffle
    again = marked.union(marked).withColumn("doc_id", F.expr("if(doc_id = 5, null, doc_id)"))
    assert [tuple(r)[1:] for r in quality.bucket_counts(docs.union(docs.limit(1)), again, few).collect()] == [(188_999, 210_001)]
    more = docs.selectExpr("doc_id % 105000 as doc_id", "text")
    every = more.selectExpr("doc_id", "1 as quality", "0 as toxic").distinct()
    for p in (few, quality.QualityParams()):
        assert [tuple(r)[1:] for r in quality.bucket_counts(more, every, p).collect()] == [(210_000, 210_000)]
    all_good = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    for p in (few, quality.QualityParams()):
        assert [tuple(r)[1:] for r in quality.bucket_counts(docs, all_good, p).collect()] == [(210_000, 210_000)]


@pytest.mark.parametrize("rows", [texts.rows(), [], [(1, None)]], ids=["all", "empty", "null"])
class TestTexts:
    def test_quality(self, spark, docs_of, duck, rows):
        df = quality.measure(docs_of(rows), labels(spark, MARKED))
        marked = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in MARKED]
        same(df, as_sql(duck, oracles.quality_sql(), documents=(TABLE, rows), labels=(LABELS, marked)))

    def test_quality_without_labels(self, spark, docs_of, duck, rows):
        df = quality.measure(docs_of(rows), labels(spark, []))
        same(df, as_sql(duck, oracles.quality_sql(), documents=(TABLE, rows), labels=(LABELS, [])))
        assert df.filter("score_micro <> 0").count() == 0

    def test_shards(self, spark, docs_of, duck, rows):
        df = sharding.placed(docs_of(rows)).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
        same(df, as_sql(duck, oracles.shards_sql(), documents=(TABLE, rows)))

    def test_near(self, docs_of, duck, rows):
        rows = [r for r in rows if r[1] != texts.LONG]
        same(near_dedup.components(docs_of(rows)), as_sql(duck, oracles.near_sql(), documents=(TABLE, rows)))

    def test_secrets(self, docs_of, duck, rows):
        found = secrets.scan(docs_of(rows))
        df = found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                          F.sha2("base_spans", 256).alias("base_sha256"), "spans")
        same(df, as_sql(duck, oracles.secrets_sql(), documents=(TABLE, rows)))
        for r in found.collect():
            text = dict(rows)[r.doc_id]
            base = brute.base_secrets(text)
            assert (r.base_spans, r.spans) == (brute.listed(base), brute.listed(base + brute.linked_secrets(text)))

    @pytest.mark.parametrize("items", [ITEMS, []], ids=["items", "none"])
    def test_contamination(self, spark, docs_of, duck, rows, items):
        benchmark = spark.createDataFrame(items, "item_id bigint, text string")
        for p in (decontaminate.BenchmarkParams(), decontaminate.BenchmarkParams(filter_bits=64, broadcast_rows=0)):
            df = decontaminate.contamination(docs_of(rows), benchmark, p)
            same(df, as_sql(duck, oracles.contamination_sql(), documents=(TABLE, rows), benchmark=("item_id bigint, text varchar", items)))


THREAD = [
    (1, 0, "a", "Hello all,\nthis is the first\nmessage of the thread.\n\nIt has two passages."),
    (1, 1, "b", "On Monday a wrote:\n> Hello all,\n> this is the   FIRST message\n> of the thread.\nI agree."),
    (1, 2, "c", "> It has two passages.\n\nOnly the second one matters."),
    (1, 3, "a", "b wrote\n>> Hello all, this is the first message of the thread.\n> I agree.\nThanks."),
    (1, 4, "d", "> nobody ever said this\nhm"), (1, 5, "e", "> > It has two passages.\n> Only the second one matters.\nYes."),
    (1, 6, "f", "> Yes.\nquoting what is said twice\n\nYes."), (2, 0, "a", "Yes."), (2, 1, "b", "> Yes.\n> Yes.\nNo."), (2, 2, None, None), (2, 3, "c", ""),
    (3, 0, "x", ">\n> \n>>"), (4, 1, "late", "> early\nanswer before"), (4, 2, "late", "early"), (None, 0, "n", "null talk"), (None, 1, "n", "> null talk\nanswer"),
]
TALK = "conv_id bigint, turn bigint, role varchar, text varchar"


@pytest.mark.parametrize("rows", [THREAD, [], THREAD[:1]], ids=["thread", "empty", "one"])
def test_quotes(spark, duck, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, path string, mid int")
    same(quotes.conversations(df), as_sql(duck, oracles.quotes_sql(), conversations=(TALK, rows)))


def test_quotes_long_chain(spark):
    rows = [(1, 0, "a", "word 0")] + [(1, i, "a", f"> word {i - 1}\nword {i}") for i in range(1, 20)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("pos").collect()
    assert [(r.turn, r.depth, r.parent_turn) for r in got] == [(i, i, i - 1 if i else None) for i in range(20)]


def test_quotes_across_conversations(spark):
    df = spark.createDataFrame([(1, 0, "a", "shared words"), (2, 1, "b", "> shared words\nanswer")], "conv_id bigint, turn bigint, role string, text string")
    assert quotes.conversations(df).filter("n_linked > 0").count() == 0
    assert quotes.conversations(df, quotes.QuoteParams(scope=())).filter("n_linked > 0").count() == 1


@pytest.mark.parametrize("name", ["op1_quality_ratio", "op2_feistel_shards", "op3_quote_threads", "op7_near_dedup", "op9_secret_scan", "op10_decontamination"])
def test_registered(spark, sf, duck, name):
    for table in ("documents", "labels", "benchmark", "conversations"):
        duck.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    result = duck.execute(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(d[0] for d in result.description)
    same(df, ([d[0] for d in result.description], result.fetchall()))
