"""Driver contract: entry, queries and oracle_sql, checked against DuckDB at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck_connect

EXTRA = E._llm()[0]  # training-data operators; their tests are in tests/llm
QUERIES = {k: f for k, f in E.queries().items() if k not in EXTRA}
SQL = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["delivery_bucket", "orders", "detractor_rate_pct", "promoter_rate_pct",
                          "avg_review_score"]
    assert df.count() > 0


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL) - set(EXTRA) and len(QUERIES) == 57


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(SQL[name])
    problems = compare([tuple(r) for r in df.collect()], df.columns,
                       cur.fetchall(), [d[0] for d in cur.description])
    assert not problems, problems
