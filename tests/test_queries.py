"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from kindred.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_streaming_matches(spark, tmp_path):
    from kindred.spec import PART
    from kindred.streaming.incremental import watch

    spark.createDataFrame([(7, "Rua Goias", "b"), (8, "Nada", "b")], "id long, name string, block string").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(1, "Rua Goiás", "b"), (2, "Rua Goiás", "c")], "id long, name string, block string")
    stream = spark.readStream.schema("id long, name string, block string").parquet(str(tmp_path / "in"))
    q = watch(stream, lambda: known, PART, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert [(r["id"], r["match_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(7, 1)]
