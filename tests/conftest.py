import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value of either engine, comparable: floats rounded, rows and lists as tuples."""
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Compares a registered query's rows with its SQL's, as multisets."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def compare(query, sql):
        found = query(spark, sf_dir)
        names = sorted(found.columns)
        ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in found.collect())
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == names
        theirs = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in cursor.fetchall())
        assert ours == theirs

    return compare
