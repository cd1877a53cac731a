"""Comparing a Spark query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def oracle(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows_of(frame, columns) -> list[str]:
    plain = frame[columns].astype(object)
    return sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


def assert_equal(spark, query, sql, sf_dir: str = SMALL) -> None:
    found, wanted = query(spark, sf_dir).toPandas(), oracle(sf_dir).sql(sql).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    assert rows_of(found, columns) == rows_of(wanted, columns)


def value(spark, column, **inputs):
    """``column`` over one row of ``inputs``."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in inputs.items()])
    return row.select(column.alias("x")).first().x
