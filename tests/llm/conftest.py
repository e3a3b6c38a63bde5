import duckdb
import pytest

DOCS = "doc_id bigint, text string, lang string, rid string, kept boolean, row int"


@pytest.fixture
def duck():
    return duckdb.connect()


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "x", True, 7) for i, t in rows], DOCS).repartition(3)
    return make


def as_sql(duck, sql, **tables):
    """Rows of a statement over small tables given as (columns with types, rows)."""
    for name, (columns, rows) in tables.items():
        duck.execute(f"create or replace table {name} ({columns})")
        if rows:
            duck.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    result = duck.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def same(df, sql_result):
    columns, want = sql_result
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
