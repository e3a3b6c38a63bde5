"""Secret scans of texts with very many parts."""

import time

from facetry.llm import secrets

from . import brute


def test_links_equal_brute_force(docs_of):
    """Runs, ids and addresses near and far, in many scopes."""
    text = "".join(f"user=u{i} pad{' x' * (i % 130)} aB3dE5fG7hJ9kL1mN3pQ5r{i:04d} https://h{i}.example/a{chr(10) * (1 + i % 3)}" for i in range(150))
    row = secrets.scan(docs_of([(1, text)])).first()
    base = brute.base_secrets(text)
    assert row.spans == brute.listed(base + brute.linked_secrets(text)) and row.linked


def test_twenty_thousand_parts(docs_of):
    text = "\n".join(f"https://host{i}.example/a aB3dE5fG7hJ9kL1mN3pQ5r{i:05d}" for i in range(10_000)) + "\nuser=alice"
    start = time.time()
    row = secrets.scan(docs_of([(1, text)])).first()
    assert time.time() - start < 60
    near = [s for s in row.linked if s["end"] + 200 >= len(text) - 10]
    assert len(row.linked) == len(near) and len(near) > 3  # only what stands near the one id


def test_warm_cache_encodes_new_texts_only(spark, tmp_path):
    """With a full cache, only new texts are encoded, once each, whichever side of the join moves."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from facetry.llm import token_counts

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" words of a text")).alias("text"))
    more = docs.unionByName(spark.createDataFrame([(999, "new"), (998, "new"), (997, None)], "doc_id bigint, text string"))
    for rows in (0, 200_000):
        p = token_counts.CountParams(public_tokenizers.path("byte_bpe_50k.json"), broadcast_rows=rows)
        cache = str(tmp_path / f"cache{rows}")
        for table, held in ((docs, 40), (more, 42), (more, 42)):
            got = token_counts.counts(table, cache, p).collect()
            assert len(got) == table.count() and spark.read.parquet(cache).count() == held
        assert {r.n_tokens for r in got if r.doc_id in (998, 999)} == {1} and next(r for r in got if r.doc_id == 997).n_tokens == 0
