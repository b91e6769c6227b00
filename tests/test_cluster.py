import subprocess
import sys
from pathlib import Path

import pytest
from oracle import SF, same

from millrace.operators.load import DriverTarget
from millrace.session import Session
from millrace.session_queries import oracle_sql

LOADS = ["c1_append", "c2_create", "c3_replace"]


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    home, out = tmp_path_factory.mktemp("home"), tmp_path_factory.mktemp("out")
    script = Path(__file__).parent / "on_cluster.py"
    done = subprocess.run([sys.executable, script, home, SF, out, *LOADS], cwd=home, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list(home.glob("shared/*/load-*"))
    return out


@pytest.mark.parametrize("name", LOADS)
def test_same_as_sql_on_a_cluster(spark, written, name):
    same(spark, name, lambda s, _: s.read.parquet(f"{written}/{name}"), oracle_sql()[name])


def test_a_target_of_the_driver(spark, tmp_path):
    target = DriverTarget(spark, f"jdbc:derby:{tmp_path}/db;create=true", "derby", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    target.VALUES = 10  # many portions
    s = Session(spark, default_target=target, schema_options={"string_policy": {"nvarchar": 9}})
    text = "id AS n, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a\"\n, ' WHEN 2 THEN 'é' ELSE 'b' END AS s, IF(id = 7, NULL, id / 3.0D) AS d, timestamp_ntz'2020-01-02 03:04:05.678901' AS t, id % 2 = 0 AS b, CAST(id AS decimal(9,2)) AS `n.x`"
    s.register("x", spark.range(31))
    t = s.table_from_sql(f"SELECT {text} FROM x")
    assert s.write(t.to_target("APP", "T", "create_and_load"))["validated"]
    assert sorted(map(tuple, target.read("APP", "T").collect()), key=repr) == sorted(map(tuple, t.df.collect()), key=repr)
    assert s.write(s.table_from_sql(f"SELECT {text} FROM x WHERE id < 0").to_target("APP", "NONE", "create_and_load"))["validated"] and target.read("APP", "NONE").count() == 0
    bad = s.table_from_sql("SELECT id AS n, IF(id = 30, '0123456789', 'a') AS s, 0D AS d, timestamp_ntz'2020-01-01 00:00:00' AS t, true AS b, CAST(0 AS decimal(9,2)) AS `n.x` FROM x")
    assert s.write(bad.to_target("APP", "T"))["status"] == "failed" and target.count("APP", "T") == 31
