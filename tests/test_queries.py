"""Every registered query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import Row

from pelago.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return ("f", round(v, 9) + 0.0)
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v)


def test_ids_cover_the_inventory():
    ids = {k.split("_")[0] for k in QUERIES}
    wanted = {f"{c}{i:02d}" for c, n in (("S", 20), ("P", 26), ("X", 14), ("J", 6), ("K", 15), ("Q", 14), ("A", 33), ("M", 29), ("E", 17), ("R", 10)) for i in range(1, n + 1)}
    assert wanted <= ids


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    for c, t in zip(want.columns, want.types, strict=True):
        assert kinds.get(have[c], str(t)) == str(t), c
    got = sorted((tuple(norm(r[c]) for c in want.columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"M05_cross_validate", "M16_modality_ablation", "M18_stack_oof", "M19_search_parameters"}))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
