import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def oracle():
    """Columns and rows of a SQL text over the tables of SF, both sorted."""
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def run(sql):
        found = con.sql(sql)
        return as_rows(found.columns, found.fetchall())

    return run


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr(tuple(row[k] for k in order)) for row in rows)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: as_rows(df.columns, df.collect())


@pytest.fixture(scope="session")
def sf():
    return SF
