"""Registered queries that run loads, plans and reports of a session and return what came of them as rows.

Loads go into an embedded database of the driver's process: in its memory on a local master, on its disk on a cluster, where rows
pass through the folder in spark.checkpoint.dir.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from millrace.errors import MillraceError
from millrace.functions.names import fnv1a64
from millrace.operators.load import DriverTarget, JdbcTarget, swap_sql
from millrace.operators.preview import preview
from millrace.operators.shared import is_local
from millrace.session import Session

_DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


class _OnDisk(DriverTarget):
    """An embedded database in a temporary folder of the driver."""

    def __init__(self, spark: SparkSession):
        self.folder = os.path.realpath(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, self.folder, ignore_errors=True)
        super().__init__(spark, f"jdbc:derby:{self.folder}/db;create=true", "derby", _DRIVER)

    def close(self) -> None:
        with suppress(Py4JJavaError):  # a shutdown ends with an error, also when it is done
            self.spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{self.folder}/db;shutdown=true")
        shutil.rmtree(self.folder, ignore_errors=True)


def _database(spark: SparkSession) -> JdbcTarget:
    target = JdbcTarget(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "derby", _DRIVER) if is_local(spark) else _OnDisk(spark)
    target.execute('CREATE SCHEMA "app_"')
    return target


def _stored(target: JdbcTarget, table: str) -> DataFrame:
    found = target.read("app_", table)
    if isinstance(target, _OnDisk):  # the rows are in the shared folder now
        target.close()
    return found


def _session(spark: SparkSession, sf_dir: str, *tables: str, **options: object) -> Session:
    s = Session(spark, **options)
    for name in tables:
        s.register(name, s.spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return s


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load into a table that it creates, read back."""
    target = _database(spark)
    s = _session(spark, sf_dir, "customer", schema_options={"string_policy": {"nvarchar": 40}})
    t = s.table_from_sql("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
    assert s.write(t.to_target("app_", "people", "create_and_load", target=target))["validated"]
    return _stored(target, "people")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added to a table that has some, counted by its growth."""
    target = _database(spark)
    s = _session(spark, sf_dir, "customer")
    first, second = (s.table_from_sql(f"SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = {k}") for k in (0, 1))
    assert s.write(first.to_target("app_", "people", "create_and_load", target=target))["validated"]
    assert s.write(second.to_target("app_", "people", target=target))["validated"]
    return _stored(target, "people")


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced after validation."""
    target = _database(spark)
    s = _session(spark, sf_dir, "orders")
    for low in (300000, 100000):
        assert s.write(s.table_from_sql(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {low}").to_target("app_", "big", "replace", target=target))["validated"]
    return _stored(target, "big")


def written_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three outputs over a shared alias, which is computed once; what the report says of each."""
    s = _session(spark, sf_dir, "orders", "customer")
    s.table_from_sql("SELECT o.*, c_mktsegment FROM orders o JOIN customer c ON o_custkey = c_custkey").alias("placed")
    texts = ["SELECT o_orderkey FROM placed WHERE o_orderstatus = 'F'", "SELECT c_mktsegment, count(*) AS n FROM placed GROUP BY c_mktsegment", "SELECT o_orderkey FROM placed"]
    report = s.write_all([s.table_from_sql(x).to_target("app_", f"t{i}") for i, x in enumerate(texts)], stream_only=True)
    return spark.createDataFrame([(o["output"], o["status"], o["rows_streamed"], ",".join(report["cache"]["selected"])) for o in report["outputs"]], "output string, status string, n bigint, kept string")


def failed_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of three outputs fails, the third is skipped."""
    s = _session(spark, sf_dir, "region")
    texts = ["SELECT r_regionkey FROM region", "SELECT CAST(r_name AS int) AS x FROM region", "SELECT r_name FROM region"]
    report = s.write_all([s.table_from_sql(x).to_target("app_", f"t{i}") for i, x in enumerate(texts)], stream_only=True)
    return spark.createDataFrame([(o["output"], o["status"], o.get("reason")) for o in report["outputs"]], "output string, status string, reason string")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources behind each output."""
    s = _session(spark, sf_dir, "orders", "customer", "nation")
    s.table_from_sql("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey").alias("placed")
    s.table_from_sql("WITH nation AS (SELECT * FROM placed) SELECT c_nationkey FROM nation").alias("hidden")
    outputs = [s.table_from_sql(x).to_target("app_", n) for n, x in (("one", "SELECT * FROM hidden"), ("two", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM placed)"))]
    return spark.createDataFrame([(r["source"], ",".join(r["used_by"])) for r in s.source_report(outputs)], "source string, used_by string")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of query texts."""
    return spark.createDataFrame([(t, fnv1a64(t)) for t in ("", "a", "foobar")], "text string, hash string")


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2: the first rows, as the text that is shown."""
    s = _session(spark, sf_dir, "region")
    text = s.table_from_sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey").preview(2).text()
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def as_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values escaped and typed."""
    text = preview(spark.sql("SELECT 1 AS n, '<a&b>' AS t, CAST(NULL AS string) AS z")).html()
    return spark.createDataFrame([(x, x in text) for x in ('<td class="number">1</td>', "&lt;a&amp;b&gt;", "<i>null</i>", "1 rows, 3 columns", "<a&b>")], "part string, there boolean")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says to texts that are not one read-only query of registered tables."""
    s = _session(spark, sf_dir, "region")
    texts = ["", "SELECT 1; SELECT 2", "DROP TABLE region", "INSERT INTO region VALUES (9, 'x')", "EXPLAIN SELECT 1", "SET a = 1", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM unknown", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT r_regionkey / 2 AS x FROM region", "SELECT nothing FROM region"]
    rows = []
    for t in texts:
        try:
            s.table_from_sql(t)
            rows.append((t, "accepted"))
        except MillraceError as e:
            rows.append((t, f"{e.phase}:{e.kind}"))
    return spark.createDataFrame(rows, "text string, said string")


def swap_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the replacement's batch, line by line."""
    return spark.createDataFrame(list(enumerate(swap_sql("dbo", "it's__staging_1", "it's").split("\n"))), "line int, text string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a13_refused": refused, "a16_lineage": lineage, "b1_preview": previewed, "b3_html": as_html, "b9_hashes": hashes, "b10_together": written_together, "b10_failed": failed_after,
        "c1_append": appended, "c2_create": created, "c3_replace": replaced, "c4_swap": swap_batch,
    }


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({columns})"


def oracle_sql() -> dict[str, str]:
    swap = [
        "SET XACT_ABORT ON;", "BEGIN TRY", "  BEGIN TRANSACTION;", "  DECLARE @got int;",
        "  EXEC @got = sys.sp_getapplock @Resource = N'replace:[dbo].[it''s]', @LockMode = N'Exclusive', @LockOwner = N'Transaction', @LockTimeout = 0;",
        "  IF @got < 0 THROW 50001, N'another load replaces this table', 1;",
        "  IF OBJECT_ID(N'[dbo].[it''s__staging_1]', N'U') IS NULL THROW 50002, N'the staging table is missing', 1;",
        "  IF OBJECT_ID(N'[dbo].[it''s__old]') IS NOT NULL THROW 50003, N'a backup is left from before', 1;",
        "  IF OBJECT_ID(N'[dbo].[it''s]', N'U') IS NOT NULL",
        "    EXEC sys.sp_rename @objname = N'[dbo].[it''s]', @newname = N'it''s__old', @objtype = N'OBJECT';",
        "  EXEC sys.sp_rename @objname = N'[dbo].[it''s__staging_1]', @newname = N'it''s', @objtype = N'OBJECT';",
        "  IF OBJECT_ID(N'[dbo].[it''s__old]', N'U') IS NOT NULL", "    DROP TABLE [dbo].[it's__old];", "  COMMIT TRANSACTION;", "END TRY", "BEGIN CATCH",
        "  IF @@TRANCOUNT > 0 ROLLBACK TRANSACTION;", "  THROW;", "END CATCH;",
    ]
    return {
        "a13_refused": _values([("", "validate_sql:empty_sql"), ("SELECT 1; SELECT 2", "validate_sql:parse_error"), ("DROP TABLE region", "validate_sql:not_read_only"), ("INSERT INTO region VALUES (9, 'x')", "validate_sql:not_read_only"), ("EXPLAIN SELECT 1", "validate_sql:not_read_only"), ("SET a = 1", "validate_sql:not_read_only"), ("SELECT * FROM parquet.`/tmp`", "plan_sql:unknown_table"), ("SELECT * FROM unknown", "plan_sql:unknown_table"), ("SELECT reflect('java.lang.System', 'exit', 0)", "validate_sql:not_allowed"), ("SELECT r_regionkey / 2 AS x FROM region", "accepted"), ("SELECT nothing FROM region", "plan_sql:plan_error")], "text, said"),
        "a16_lineage": _values([("orders", "one,two"), ("customer", "one,two"), ("nation", "two")], "source, used_by"),
        "b1_preview": "WITH r AS (SELECT r_regionkey::varchar AS k, r_name AS v FROM region ORDER BY r_regionkey LIMIT 2), w AS (SELECT greatest(max(length(v)), 6) AS n FROM r), x AS (SELECT row_number() OVER (ORDER BY k)::int AS i, k, v FROM r), b AS (SELECT '+' || repeat('-', 13) || '+' || repeat('-', n + 2) || '+' AS bar, n FROM w) SELECT 0 AS line, bar AS text FROM b UNION ALL SELECT 1, '| r_regionkey | ' || rpad('r_name', n::int, ' ') || ' |' FROM b UNION ALL SELECT 2, bar FROM b UNION ALL SELECT 2 + i, '| ' || rpad(k, 11, ' ') || ' | ' || rpad(v, n::int, ' ') || ' |' FROM x, b UNION ALL SELECT 5, bar FROM b",
        "b3_html": _values([('<td class="number">1</td>', True), ("&lt;a&amp;b&gt;", True), ("<i>null</i>", True), ("1 rows, 3 columns", True), ("<a&b>", False)], "part, there"),
        "b9_hashes": _values([("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")], "text, hash"),
        "b10_together": "SELECT 't0' AS output, 'succeeded' AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n, 'placed' AS kept UNION ALL SELECT 't1', 'succeeded', (SELECT count(DISTINCT c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey), 'placed' UNION ALL SELECT 't2', 'succeeded', (SELECT count(*) FROM orders), 'placed'",
        "b10_failed": _values([("t0", "succeeded", None), ("t1", "failed", None), ("t2", "skipped", "previous_output_failed")], "output, status, reason"),
        "c1_append": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 IN (0, 1)",
        "c2_create": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0",
        "c3_replace": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
        "c4_swap": _values(list(enumerate(swap)), "line, text"),
    }
