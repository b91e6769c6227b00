"""Loading one planned output into a relational target.

A target does the few steps that are not rows: probing, definitions, counting and the swap. Rows go
through Spark's JDBC writer, in parallel, or to any consumer.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MillraceError
from millrace.operators import shared
from millrace.plans.output import OutputPlan, create_table, quoted, shaped


class Target(Protocol):
    def exists(self, schema: str, table: str) -> bool: ...
    def execute(self, sql: str) -> None: ...
    def count(self, schema: str, table: str) -> int: ...
    def create(self, plan: OutputPlan, table: str) -> None: ...
    def drop(self, schema: str, table: str) -> None: ...
    def swap(self, schema: str, staging: str, final: str) -> None: ...
    def append(self, df: DataFrame, schema: str, table: str) -> None: ...


class JdbcTarget:
    """A database behind a JDBC URL; `dialect` is sqlserver or derby."""

    def __init__(self, spark, url: str, dialect: str = "sqlserver", properties: dict[str, str] | None = None, parallel: int | None = None):
        if not url or not url.strip():
            raise MillraceError("configure", "blank_connection", "the connection is blank")
        self.spark, self.url, self.dialect, self.properties, self.parallel = spark, url, dialect, dict(properties or {}), parallel

    def __repr__(self) -> str:
        return f"JdbcTarget({self.dialect}, ***)"

    def _open(self):
        props = self.spark._jvm.java.util.Properties()
        for k, v in self.properties.items():
            props.setProperty(k, v)
        loader = self.spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry
        if "driver" in self.properties:
            loader.register(self.properties["driver"])
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url, props)

    def name(self, schema: str, table: str) -> str:
        return quoted(schema, table) if self.dialect == "sqlserver" else f'"{schema}"."{table}"'

    def execute(self, *statements: str) -> None:
        c = self._open()
        try:
            c.setAutoCommit(False)
            s = c.createStatement()
            for sql in statements:
                s.execute(sql)
            c.commit()
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def exists(self, schema: str, table: str) -> bool:
        c = self._open()
        try:
            found = c.getMetaData().getTables(None, schema, table, None)
            return bool(found.next())
        finally:
            c.close()

    def count(self, schema: str, table: str) -> int:
        c = self._open()
        try:
            r = c.createStatement().executeQuery(f"SELECT COUNT(*) FROM {self.name(schema, table)}")
            r.next()
            return int(r.getLong(1))
        finally:
            c.close()

    def create(self, plan: OutputPlan, table: str) -> None:
        if self.dialect == "sqlserver":
            return self.execute(create_table(plan.schema, table, plan.columns))
        words = {"bit": "boolean", "nvarchar(max)": "clob", "varbinary(max)": "blob", "float": "double"}
        kind = lambda t: words.get(t) or t.replace("nvarchar", "varchar").replace("datetime2(7)", "timestamp").replace("datetime", "timestamp")
        body = ", ".join(f'"{c.name}" {kind(c.target)}{"" if c.nullable else " not null"}' for c in plan.columns)
        self.execute(f"CREATE TABLE {self.name(plan.schema, table)} ({body})")

    def drop(self, schema: str, table: str) -> None:
        self.execute(f"DROP TABLE {self.name(schema, table)}")

    def swap(self, schema: str, staging: str, final: str) -> None:
        """One transaction: final becomes backup, staging becomes final, backup goes; nobody else may swap meanwhile."""
        if self.dialect == "sqlserver":
            return self.execute(swap_sql(schema, staging, final))
        backup = f"{final}__old"
        if not self.exists(schema, staging) or self.exists(schema, backup):
            raise MillraceError("swap", "swap_state", "the staging table is missing, or a backup is left from before")
        rename = lambda a, b: f'RENAME TABLE {self.name(schema, a)} TO "{b}"'
        there = self.exists(schema, final)
        steps = [rename(final, backup), rename(staging, final), f"DROP TABLE {self.name(schema, backup)}"] if there else [rename(staging, final)]
        self.execute(*steps)

    def append(self, df: DataFrame, schema: str, table: str) -> None:
        if self.parallel:
            df = df.coalesce(self.parallel)
        df.write.format("jdbc").options(url=self.url, dbtable=self.name(schema, table), batchsize="10000", **self.properties).mode("append").save()

    def read(self, schema: str, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=self.name(schema, table), **self.properties).load()


class DriverTarget(JdbcTarget):
    """A database that only the driver's process reaches, such as an embedded one.

    Executors write and read its rows in the folder that they share with the driver, which moves them some at a time: its memory
    doesn't bound a load. Spark's own JDBC conversions are used, in the driver.
    """

    #: Values that the driver holds at once.
    VALUES = 100_000

    def _portion(self, df: DataFrame) -> int:
        return max(1, self.VALUES // len(df.columns))

    def append(self, df: DataFrame, schema: str, table: str) -> None:
        path = shared.new_folder(self.spark)
        try:
            shared.put(df, path, self._portion(df))  # a row that breaks a policy fails the load here, before any is stored
            jvm = self.spark._jvm
            jdbc, sql = jvm.org.apache.spark.sql.execution.datasources.jdbc, jvm.org.apache.spark.sql.jdbc
            options = jdbc.JdbcOptionsInWrite(self.url, self.name(schema, table), jvm.org.apache.spark.api.python.PythonUtils.toScalaMap({**self.properties, "batchsize": "10000"}))
            dialect, fields = sql.JdbcDialects.get(self.url), df._jdf.schema()
            c = self._open()
            try:
                stored = jdbc.JdbcUtils.getSchemaOption(c, options)
            finally:
                c.close()
            insert = jdbc.JdbcUtils.getInsertStatement(options.table(), fields, stored, self.spark.conf.get("spark.sql.caseSensitive") == "true", dialect)
            for file in shared.files(shared.get(df, path)):
                rows = jvm.scala.jdk.javaapi.CollectionConverters.asScala(shared.get(df, file)._jdf.collectAsList())
                with self._as_task():
                    jdbc.JdbcUtils.savePartition(options.table(), rows.iterator(), fields, insert, options.batchSize(), dialect, options.isolationLevel(), options)
                del rows
                gc.collect()  # the gateway's objects are in cycles; until they go, the JVM keeps the rows
        finally:
            shared.discard(path)

    @contextmanager
    def _as_task(self) -> Iterator[None]:
        """Spark's JDBC writer notes its counts in the running task's context; in the driver, in an empty one."""
        task = getattr(getattr(self.spark._jvm.org.apache.spark, "TaskContext$"), "MODULE$")
        task.setTaskContext(task.empty())
        try:
            yield
        finally:
            task.unset()

    def read(self, schema: str, table: str) -> DataFrame:
        """The rows as they are now; they stay in the shared folder until the process ends."""
        like, jvm, path = super().read(schema, table), self.spark._jvm, shared.new_folder(self.spark)
        fields, dialect = like._jdf.schema(), jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)
        shared.put(self.spark.createDataFrame([], like.schema), path)
        c = self._open()
        try:
            found = c.createStatement().executeQuery(f"SELECT * FROM {self.name(schema, table)}")
            portions = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(found, fields, dialect).grouped(self._portion(like))
            while portions.hasNext():
                rows = jvm.scala.jdk.javaapi.CollectionConverters.asJava(portions.next())
                shared.put(DataFrame(self.spark._jsparkSession.createDataFrame(rows, fields), self.spark).coalesce(1), path)
                del rows
                gc.collect()
        finally:
            c.close()
        return shared.get(like, path)


def swap_sql(schema: str, staging: str, final: str) -> str:
    """The replacement of a table as one batch: under an exclusive lock that is not waited for, with all states asked for inside
    the transaction, rolled back and raised again on any error."""
    backup = f"{final}__old"
    text = lambda x: "N'" + x.replace("'", "''") + "'"
    full = lambda x: text(quoted(schema, x))
    rename = lambda a, b: f"EXEC sys.sp_rename @objname = {full(a)}, @newname = {text(b)}, @objtype = N'OBJECT';"
    lines = [
        "SET XACT_ABORT ON;",
        "BEGIN TRY",
        "  BEGIN TRANSACTION;",
        "  DECLARE @got int;",
        f"  EXEC @got = sys.sp_getapplock @Resource = {text('replace:' + quoted(schema, final))}, @LockMode = N'Exclusive', @LockOwner = N'Transaction', @LockTimeout = 0;",
        "  IF @got < 0 THROW 50001, N'another load replaces this table', 1;",
        f"  IF OBJECT_ID({full(staging)}, N'U') IS NULL THROW 50002, N'the staging table is missing', 1;",
        f"  IF OBJECT_ID({full(backup)}) IS NOT NULL THROW 50003, N'a backup is left from before', 1;",
        f"  IF OBJECT_ID({full(final)}, N'U') IS NOT NULL",
        f"    {rename(final, backup)}",
        f"  {rename(staging, final)}",
        f"  IF OBJECT_ID({full(backup)}, N'U') IS NOT NULL",
        f"    DROP TABLE {quoted(schema, backup)};",
        "  COMMIT TRANSACTION;",
        "END TRY",
        "BEGIN CATCH",
        "  IF @@TRANCOUNT > 0 ROLLBACK TRANSACTION;",
        "  THROW;",
        "END CATCH;",
    ]
    return "\n".join(lines)


#: Phases of a load, in their order.
PHASES = ["probe_target", "prepare_target", "count_before", "check_schema", "write_rows", "count_after", "validate_rows", "swap_target", "cleanup"]


def observed(df: DataFrame, plan: OutputPlan, options: dict) -> OutputPlan:
    """The plan with the lengths that the rows have, where a policy asks for them: one more pass, for just these columns."""
    asked = [c for c in plan.columns if (isinstance(c.source, T.StringType) and options["string_policy"] == "observed_nvarchar") or (isinstance(c.source, T.BinaryType) and options["binary_policy"] == "observed_varbinary")]
    if not asked or plan.mode == "append_existing":
        return plan
    most = df.agg(*[F.max(F.length(F.col(f"`{c.name}`"))).alias(f"m{i}") for i, c in enumerate(asked)]).first()
    columns = list(plan.columns)
    for i, c in enumerate(asked):
        n = max(1, most[f"m{i}"] or 0)
        word, limit = ("nvarchar", 4000) if isinstance(c.source, T.StringType) else ("varbinary", 8000)
        columns[columns.index(c)] = replace(c, target=f"{word}({n})" if n <= limit else f"{word}(max)", most=n if n <= limit else None)
    return replace(plan, columns=columns, create_sql=create_table(plan.schema, plan.table, columns))


def schema_differences(df: DataFrame, plan: OutputPlan) -> list[str]:
    """How a query's columns differ from those planned: at most 16 differences."""
    have = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    want = [(c.name, c.source.simpleString(), c.nullable) for c in plan.columns]
    out = [f"{len(have)} columns instead of {len(want)}"] if len(have) != len(want) else []
    out += [f"column {i}: {h} instead of {w}" for i, (h, w) in enumerate(zip(have, want, strict=False)) if h != w]
    return out[:16]


class _Phases:
    """Seconds and outcome of each phase."""

    def __init__(self) -> None:
        self.done: list[dict] = []

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        assert name in PHASES
        began, outcome = time.time(), "failed"
        try:
            yield
            outcome = "succeeded"
        finally:
            self.done.append({"phase": name, "status": outcome, "seconds": time.time() - began})


class LoadError(MillraceError):
    """A failed load, with what its report would have said."""

    def __init__(self, error: MillraceError, report: dict):
        super().__init__(error.phase, error.kind, error.message, **error.context)
        self.report = report


def load(df: DataFrame, plan: OutputPlan, target: Target, options: dict, validation: str = "validate_if_possible") -> dict:
    """Run the lifecycle of one output; what failed leaves an existing target as it was, where the mode allows that.

    Rows are counted in the load's own pass and compared with the target's (its growth, when appending). If the target can't
    be counted, `require` fails the load and `validate_if_possible` says so. After a failure the number of written rows is unknown.
    """
    schema, table, phase = plan.schema, plan.table, _Phases()
    report = {**plan.facts(), "status": "failed", "rows_in": None, "rows_written": None, "validated": False, "validation": "not_run", "partial_write_possible": False, "backend": "jdbc_batches", "phases": phase.done}
    into, made = table, None

    def counted(name: str) -> int | None:
        try:
            with phase(name):
                return target.count(schema, into)
        except Exception as e:
            if validation == "require" or plan.mode == "replace":
                raise MillraceError("validate_rows", "count_unavailable", f"the target can't be counted: {type(e).__name__}") from e
            report["validation"] = "unavailable"
            return None

    try:
        with phase("probe_target"):
            there = target.exists(schema, table)
            if plan.mode == "append_existing" and not there:
                raise MillraceError("prepare_target", "target_missing", f"{quoted(schema, table)} does not exist")
            if plan.mode == "create_and_load" and there:
                raise MillraceError("prepare_target", "target_exists", f"{quoted(schema, table)} exists")
            if plan.mode == "replace" and validation == "disabled":
                raise MillraceError("prepare_target", "validation_required", "a replacement is swapped in only after validation")
        with phase("check_schema"):
            if wrong := schema_differences(df, plan):
                raise MillraceError("check_schema", "schema_changed", "; ".join(wrong)[:8192])
        with phase("prepare_target"):
            if plan.mode == "create_and_load":
                made = table
            elif plan.mode == "replace":
                n = next(n for n in range(1, 1000) if not target.exists(schema, f"{table}__staging_{n}"))
                into = made = f"{table}__staging_{n}"
            if made:
                target.create(plan, made)
        before = counted("count_before") if plan.mode == "append_existing" and validation != "disabled" else 0
        seen = Observation("rows")
        report["partial_write_possible"] = True
        with phase("write_rows"):
            target.append(shaped(df, plan, options).observe(seen, F.count(F.lit(1)).alias("n")), schema, into)
        report["rows_in"] = report["rows_written"] = seen.get["n"]
        report["partial_write_possible"] = False
        if validation == "disabled":
            report["validation"] = "disabled"
        elif before is not None and (after := counted("count_after")) is not None:
            with phase("validate_rows"):
                if after - before != report["rows_written"]:
                    raise MillraceError("validate_rows", "row_count", f"{report['rows_written']} rows written, {after - before} found")
            report["validated"], report["validation"] = True, "passed"
        if plan.mode == "replace":
            with phase("swap_target"):
                target.swap(schema, into, table)
            made = None
    except Exception as e:
        if made and target.exists(schema, made):
            with phase("cleanup"):
                target.drop(schema, made)
            report["partial_write_possible"] = False
        if report["rows_written"] is None:
            report["rows_in"] = report["rows_written"] = "unavailable"
        if not isinstance(e, MillraceError):
            hint = "; rows may have been written in part" if report["partial_write_possible"] else ""
            e = MillraceError("load_rows", "load_failed", f"{type(e).__name__}{hint}: {str(e)[:300]}")
        raise LoadError(e, report) from e
    report["status"] = "succeeded"
    return report
