"""All reports on a skewed hand-made marketplace match DuckDB running the oracle SQL."""

import duckdb
import pytest

from cxlens.oracle_sql import sql_over_tables
from cxlens.plans import all_reports
from tests.oracle_check import compare
from tests.skewed import skewed_tables

R = all_reports()


@pytest.fixture(scope="module")
def skewed(spark):
    t = skewed_tables(spark)
    con = duckdb.connect()
    for name, df in t.items():
        pdf = df.toPandas()
        con.register(f"_{name}", pdf)
        cols = ", ".join(f"CAST({f.name} AS {_duck_type(f.dataType.simpleString())}) AS {f.name}"
                         for f in df.schema.fields)
        con.execute(f"CREATE TABLE mk_{name} AS SELECT {cols} FROM _{name}")
    return t, con


def _duck_type(t: str) -> str:
    return {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
            "date": "DATE", "timestamp_ntz": "TIMESTAMP"}.get(t, t.upper())


@pytest.mark.parametrize("name", sorted(R))
def test_report_matches_oracle_on_skewed_data(skewed, name):
    t, con = skewed
    df = R[name].run(t)
    cur = con.execute(sql_over_tables(name))
    problems = compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(),
                       [d[0] for d in cur.description])
    assert not problems, problems
