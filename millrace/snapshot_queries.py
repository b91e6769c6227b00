"""Registered queries over snapshots: tables with a log are written from the given tables, then read through a session."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import Session
from millrace.sources.logwrite import LogTable


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf_dir: str, table: str, columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns.split(", "))


def _slices(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """The rows in n ranges of a key, in its order."""
    top = df.agg(F.max(key)).first()[0] + 1
    return [df.filter((F.col(key) >= top * i // n) & (F.col(key) < top * (i + 1) // n)).orderBy(key) for i in range(n)]


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version; a file that was removed and written anew."""
    df = _read(spark, sf_dir, "orders", "o_orderkey, o_custkey, o_orderstatus, o_totalprice")
    t = LogTable(spark, _folder(spark), df.schema)
    parts = _slices(df, "o_orderkey", 4)
    adds = [t.file(p) for p in parts]
    t.commit(*adds)
    t.commit(t.removed(adds[1]), t.file(parts[1]))
    s = Session(spark)
    s.delta_lake(t.root, name="placed")
    return s.table_from_sql("SELECT * FROM placed").df


def version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: an exact version, of three."""
    df = _read(spark, sf_dir, "orders", "o_orderkey, o_totalprice")
    t = LogTable(spark, _folder(spark), df.schema)
    odd = t.file(df.filter("o_orderkey % 2 = 1"))
    t.commit(odd)
    t.commit(t.file(df.filter("o_orderkey % 2 = 0")))
    t.commit(t.removed(odd))
    s = Session(spark)
    for v in range(3):
        s.delta_lake(t.root, version=v, name=f"v{v}")
    return s.table_from_sql("SELECT 0 AS v, count(*) AS n, min(o_orderkey) AS least FROM v0 UNION ALL SELECT 1, count(*), min(o_orderkey) FROM v1 UNION ALL SELECT 2, count(*), min(o_orderkey) FROM v2").df


def checkpoint(spark: SparkSession, sf_dir: str, sidecars: bool = False) -> DataFrame:
    """A5: a checkpoint of two parts, the commits before it gone, and one commit after it."""
    df = _read(spark, sf_dir, "customer", "c_custkey, c_name, c_nationkey")
    t = LogTable(spark, _folder(spark), df.schema, features=["v2Checkpoint"] if sidecars else None, reader=3 if sidecars else 1)
    adds = [t.file(p) for p in _slices(df, "c_custkey", 5)]
    t.commit(*adds[:3])
    t.commit(t.removed(adds[0]), adds[3])
    t.checkpoint(2, sidecars)
    t.forget(0)
    t.forget(1)
    t.commit(adds[4])
    s = Session(spark)
    s.delta_lake(t.root, name="people")
    return s.table_from_sql("SELECT c_custkey, c_name, c_nationkey FROM people").df


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: columns stored under physical names, one of them a partition column."""
    df = _read(spark, sf_dir, "nation", "n_nationkey, n_name, n_regionkey")
    meta = lambda i: {"delta.columnMapping.id": i, "delta.columnMapping.physicalName": f"col-{i}"}
    schema = T.StructType([T.StructField(f.name, f.dataType, True, meta(i)) for i, f in enumerate(df.schema)])
    t = LogTable(spark, _folder(spark), schema, ["n_regionkey"], configuration={"delta.columnMapping.mode": "name"}, reader=2)
    stored = df.select(F.col("n_nationkey").alias("col-0"), F.col("n_name").alias("col-1"), "n_regionkey")
    t.commit(*[t.file(stored.filter(f"n_regionkey = {r}").drop("n_regionkey"), {"col-2": str(r)}) for r in range(5)])
    s = Session(spark)
    s.delta_lake(t.root, name="states")
    return s.table_from_sql("SELECT n_regionkey, n_nationkey, n_name FROM states WHERE n_regionkey <> 2").df


#: Column, its type in the old files, and in the new schema.
WIDENED = [
    ("byte_long", "tinyint", "bigint"), ("int_long", "int", "bigint"), ("float_double", "float", "double"), ("byte_double", "tinyint", "double"),
    ("short_double", "smallint", "double"), ("int_double", "int", "double"), ("same_scale", "decimal(10,2)", "decimal(20,2)"), ("more_scale", "decimal(10,2)", "decimal(20,5)"),
    ("byte_decimal", "tinyint", "decimal(4,1)"), ("short_decimal", "smallint", "decimal(6,1)"), ("int_decimal", "int", "decimal(11,1)"), ("long_decimal", "bigint", "decimal(21,1)"),
    ("date_timestamp", "date", "timestamp_ntz"),
]


def widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the types before and after the schema's change."""
    names = {"tinyint": "byte", "smallint": "short", "int": "integer", "bigint": "long"}
    kind = lambda t: T._parse_datatype_string(t)
    meta = lambda old, new: {"delta.typeChanges": [{"fromType": names.get(old, old), "toType": names.get(new, new)}]}
    schema = T.StructType([T.StructField("p_partkey", T.LongType())] + [T.StructField(c, kind(new), True, meta(old, new)) for c, old, new in WIDENED])
    df = _read(spark, sf_dir, "part", "p_partkey, p_size")
    value = lambda t: F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")) if t in ("date", "timestamp_ntz") else F.col("p_size")
    t = LogTable(spark, _folder(spark), schema, features=["timestampNtz", "typeWidening"], reader=3)
    old = df.filter("p_partkey % 2 = 0").select("p_partkey", *[value(o).cast(o).alias(c) for c, o, _ in WIDENED])
    new = df.filter("p_partkey % 2 = 1").select("p_partkey", *[value(n).cast(n).alias(c) for c, _, n in WIDENED])
    t.commit(t.file(old))
    t.commit(t.file(new))
    s = Session(spark)
    s.delta_lake(t.root, name="sizes")
    return s.table_from_sql("SELECT * FROM sizes").df


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows hidden by a vector in a file, by one inline, and a file without any."""
    df = _read(spark, sf_dir, "customer", "c_custkey, c_name")
    t = LogTable(spark, _folder(spark), df.schema, features=["deletionVectors"], reader=3)
    adds = [t.file(p) for p in _slices(df, "c_custkey", 3)]
    t.commit(*adds)
    actions = []
    for add, inline in ((adds[0], False), (adds[1], True)):
        rows = spark.read.parquet(f"{t.root}/{add['add']['path']}").select("c_custkey", F.col("_metadata.row_index").alias("row")).filter("c_custkey % 5 = 0")
        actions += t.masked(add, t.vector([r.row for r in rows.collect()], inline))
    t.commit(*actions)
    s = Session(spark)
    s.delta_lake(t.root, name="people")
    return s.table_from_sql("SELECT c_custkey, c_name FROM people").df


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition values from the log, an empty one being null; a filter on them."""
    df = _read(spark, sf_dir, "orders", "o_orderkey, o_totalprice, o_orderstatus")
    t = LogTable(spark, _folder(spark), df.schema, ["o_orderstatus"])
    t.commit(*[t.file(df.filter(f"o_orderstatus = '{x}'").drop("o_orderstatus"), {"o_orderstatus": "" if x == "P" else x}) for x in "FOP"])
    s = Session(spark)
    s.delta_lake(t.root, name="placed")
    return s.table_from_sql("SELECT o_orderkey, o_orderstatus FROM placed WHERE o_orderstatus IS NULL OR o_orderstatus = 'F'").df


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files skipped by the log's statistics, through a view on the source."""
    df = _read(spark, sf_dir, "orders", "o_orderkey, o_custkey, o_totalprice")
    t = LogTable(spark, _folder(spark), df.schema)
    t.commit(*[t.file(p) for p in _slices(df, "o_orderkey", 8)])
    s = Session(spark)
    s.delta_lake(t.root, name="placed")
    s.table_from_sql("SELECT o_orderkey AS k, o_custkey, o_totalprice FROM placed").alias("short")
    top = df.agg(F.max("o_orderkey")).first()[0]
    return s.table_from_sql(f"SELECT k, o_custkey, o_totalprice FROM short WHERE k > {top // 4 * 3} AND o_totalprice > 1000").df


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources registered together, one of them at a version, and joined."""
    people, states = _read(spark, sf_dir, "customer", "c_custkey, c_nationkey"), _read(spark, sf_dir, "nation", "n_nationkey, n_name")
    a, b = LogTable(spark, _folder(spark), people.schema), LogTable(spark, _folder(spark), states.schema)
    a.commit(a.file(people.filter("c_custkey % 3 = 0")))
    a.commit(a.file(people.filter("c_custkey % 3 > 0")))
    b.commit(b.file(states))
    s = Session(spark)
    s.delta_lakes({"people": (a.root, 0), "states": (b.root, None)})
    return s.table_from_sql("SELECT n_name, count(*) AS n FROM people JOIN states ON c_nationkey = n_nationkey GROUP BY n_name").df


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a checkpoint that lists sidecar files."""
    return checkpoint(spark, sf_dir, sidecars=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"a1_snapshot": snapshot, "a2_version": version, "a5_checkpoint": checkpoint, "a5_sidecars": sidecars, "a5_mapping": mapped, "a6_widening": widening, "a7_vectors": vectors, "a8_partitions": partitions, "a8_statistics": statistics, "a9_several": several}


_WIDE = ", ".join(
    f"(DATE '2020-01-01' + p_size)::TIMESTAMP AS {c}" if new == "timestamp_ntz" else f"p_size::{new} AS {c}"  # whole numbers, so the types before change nothing
    for c, _, new in WIDENED
)
_PEOPLE = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey >= (SELECT (max(c_custkey) + 1) // 5 FROM customer)"


def oracle_sql() -> dict[str, str]:
    return {
        "a1_snapshot": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
        "a2_version": "SELECT 0 AS v, count(*) AS n, min(o_orderkey) AS least FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 1, count(*), min(o_orderkey) FROM orders UNION ALL SELECT 2, count(*), min(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0",
        "a5_checkpoint": _PEOPLE,
        "a5_sidecars": _PEOPLE,
        "a5_mapping": "SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey <> 2",
        "a6_widening": f"SELECT p_partkey, {_WIDE} FROM part",
        "a7_vectors": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey >= (SELECT (max(c_custkey) + 1) * 2 // 3 FROM customer)",
        "a8_partitions": "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')",
        "a8_statistics": "SELECT o_orderkey AS k, o_custkey, o_totalprice FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 4 * 3 FROM orders) AND o_totalprice > 1000",
        "a9_several": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0 GROUP BY n_name",
    }
