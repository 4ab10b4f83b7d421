import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("the test tables are not here")
    return TABLES


@pytest.fixture(scope="session")
def same():
    """Compare a Spark result with SQL on the same tables, rows in any order."""
    import duckdb

    def compare(frame, sql, folder):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for name in os.listdir(folder):
            con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
        ours, theirs = frame.toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        rows = [x[columns].astype(str).replace({"None": "nan"}).sort_values(columns).values.tolist() for x in (ours, theirs)]
        assert rows[0] == rows[1]

    return compare
