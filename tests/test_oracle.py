"""Every registered query against DuckDB on the smallest data."""
import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from clubsieve.plans.catalog import ORACLE, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
MAY_BE_EMPTY = {"s4_snapshots_of_url"}


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return tuple(plain(x) for x in v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows or name in MAY_BE_EMPTY
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_similar_vectors_are_in_the_order_of_whole_cosines(spark, duck, tmp_path):
    """More than 20 vectors that agree in four digits: the SQL must not order or cut them by the rounded cosine."""
    rows = [(i, [1.0, 0.0 if i == 0 else 0.5 - i * 1e-7], i) for i in range(30)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = [tuple(r) for r in QUERIES["e1_similar_vectors"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert found == con.execute(ORACLE["e1_similar_vectors"]).fetchall() and found[1][0] == 29
