import numpy as np
import pytest
from oracle import SF

from millrace import snapshot_queries
from millrace.session import Session
from millrace.sources.delta import bitmap_rows
from millrace.sources.logwrite import LogTable, bitmap


def test_bitmaps_round_trip():
    r = np.random.default_rng(1)
    for rows in ([], [0], [65535, 65536, 1 << 33], r.integers(0, 200_000, 20_000), np.arange(70_000)):
        assert np.array_equal(bitmap_rows(bitmap(rows)), np.unique(np.array(rows, dtype=np.int64)))


def test_files_are_pruned(spark):
    """By partition in Spark's plan, by statistics in the list of files; what can't be proven is read."""
    assert len(snapshot_queries.statistics(spark, SF).inputFiles()) <= 3  # of 8
    plan = snapshot_queries.partitions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(o_orderstatus" in plan or "PartitionFilters: [" in plan and "o_orderstatus" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("where, files", [("id = 15", 1), ("id < 10", 1), ("id <= 10", 2), ("id >= 20 AND name = 'n3'", 0), ("id IN (5, 25)", 2), ("id = 1 OR name = 'n29'", 2), ("name IS NULL", 1), ("id + 1 = 3", 3), ("id > 100", 0), ("extra IS NOT NULL", 3)])
def test_statistics(spark, tmp_path, where, files):
    df = spark.range(30).selectExpr("cast(id as int) as id", "if(id < 10, null, concat('n', id)) as name", "id * 0.5D as extra")
    t = LogTable(spark, str(tmp_path / "t"), df.schema)
    t.commit(*[t.file(df.filter(f"id div 10 = {k}")) for k in range(3)])
    s = Session(spark)
    s.delta_lake(t.root, name="t")
    got = s.table_from_sql(f"SELECT id FROM t WHERE {where}")
    assert len(got.df.inputFiles()) == files
    assert sorted(r.id for r in got.df.collect()) == sorted(r.id for r in df.filter(where).collect())
    assert s.table_from_sql("SELECT count(*) AS n FROM t").df.first().n == 30  # the source is as before


def test_folders_that_share_values_or_not(spark, tmp_path):
    """Files of one folder with different partition values, which Spark's own relation can't express."""
    df = spark.range(6).selectExpr("id", "'x' as p")
    t = LogTable(spark, str(tmp_path / "t"), df.schema, ["p"])
    t.commit(*[t.file(df.filter(f"id % 3 = {k}").drop("p"), {"p": v}, "one") for k, v in enumerate(["a", "", None])])
    got = Session(spark).delta_lake(t.root).df_
    assert sorted((r.id, r.p) for r in got.filter("p = 'a'").collect()) == [(0, "a"), (3, "a")] and got.filter("p is null").count() == 4
