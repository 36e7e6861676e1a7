import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """duck(sf_dir, sql): rows of the SQL over a folder's tables, with column names."""
    import duckdb

    def run(sf_dir, sql):
        c = duckdb.connect()
        for name in os.listdir(sf_dir):
            path = f"{sf_dir}/{name}"
            c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
        return c.execute(sql).fetchdf()

    return run


@pytest.fixture(scope="session")
def same():
    """same(spark_df, pandas_df): equal columns and rows, in any order."""

    def plain(pdf):
        columns = sorted(pdf.columns)
        text = pdf[columns].astype(object).where(pdf[columns].notna(), None).astype(str).replace(r"\.0$", "", regex=True)
        return text.sort_values(columns, ignore_index=True)

    def check(df, other):
        mine = df.toPandas()
        assert sorted(mine.columns) == sorted(other.columns)
        a, b = plain(mine), plain(other)
        assert len(a) == len(b)
        assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(8).to_string()

    return check
