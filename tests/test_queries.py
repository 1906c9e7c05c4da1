"""Every registered query of the reference's operators against DuckDB on the smallest tables, and its plan."""

import duckdb
import pytest

from plumbline.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(data):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = got.fetchall()
    assert rows(map(tuple, df.select(*names).collect())) == rows(want)


#: Queries whose nested-loop join has a side of one row (a list of values that the other side is held against).
ONE_ROW_SIDE = {"C14_longest_prefix_all"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_without_a_key(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert ("BroadcastNestedLoopJoin" in plan) == (name in ONE_ROW_SIDE)


@pytest.mark.parametrize("name", ["C32_anchor_by_absence", "D24_absent_unit_rollup", "L2_dangling", "L14_leak_check"])
def test_checks_find_what_is_planted(spark, name):
    assert QUERIES[name](spark, SF).count()


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("D2_dominant_cluster", "C3_nearest_within", "F2_alignment_sweep", "I2_greedy_allocation"):
            spark.conf.set("spark.sql.shuffle.partitions", "1")
            one = rows(map(tuple, QUERIES[name](spark, SF).collect()))
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            assert one == rows(map(tuple, QUERIES[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
