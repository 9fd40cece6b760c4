import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a Spark result with DuckDB's answer to a SQL text over given tables (or the test data)."""

    def run(df, sql, tables=None):
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        if tables is None:
            for name in os.listdir(SF):
                con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
        for name, table in (tables or {}).items():
            con.register(name, table)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in sorted(names)]
        want = [tuple(r[i] for i in order) for r in found.fetchall()]
        assert sorted(df.columns) == sorted(names)
        got = [tuple(r) for r in df.select(*sorted(names)).collect()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)

    return run
