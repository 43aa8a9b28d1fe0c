"""Every registered query with SQL against DuckDB on the smallest tables; the others for rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(d: pd.DataFrame) -> list:
    def text(x):
        if pd.isna(x):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float, np.number, np.bool_)) else str(x)

    return sorted(tuple(map(text, r)) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"q_compile_records"}))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1


def test_compile_is_independent_of_partitions(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        d = registry.QUERIES["q_compile_records"](spark, SF)
        return sorted(r[0] for r in d.select(F.to_json(F.struct(*d.columns))).collect())

    one, seven = run(1), run(7)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == seven and len(one) > 100
