"""Snapshots of tables with a transaction log (Delta protocol, readers 1 to 3).

The log is replayed with DataFrames: the last checkpoint at or before the version and the commits
after it. Only the list of live files comes to the driver, as every scan needs it there. Partition
values come from the log and are given to Spark's own file relation, so that it prunes partitions, also dynamically; the
log's statistics prune files for a query's filters (`may_match`). Columns mapped by name are read by their physical names
(a mapping by id is rejected). Deletion vectors are decoded on the executors and anti-joined by file and
row number, with the files that have one only, and by broadcast if the log states few deleted rows.
"""

from __future__ import annotations

import json
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.errors import MillraceError, clean

#: Reader features that are understood.
FEATURES = ["columnMapping", "deletionVectors", "timestampNtz", "typeWidening", "typeWidening-preview", "v2Checkpoint", "vacuumProtocolCheck"]
_DV = "struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:bigint>"
#: Fixed value: the digits of base 85.
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
#: Deleted rows, as the log counts them, up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
_ACTIONS = (
    f"add struct<path:string,partitionValues:map<string,string>,size:bigint,stats:string,deletionVector:{_DV}>,"
    f"remove struct<path:string,deletionVector:{_DV}>,"
    "metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>,"
    "protocol struct<minReaderVersion:int,readerFeatures:array<string>>,"
    "sidecar struct<path:string>"
)


@dataclass
class Snapshot:
    uri: str
    version: int
    schema: T.StructType
    partition_columns: list[str]
    reader_version: int
    features: list[str]
    files: list
    df: DataFrame
    mapped: bool = False

    def of(self, spark: SparkSession, files: list) -> DataFrame:
        """The rows of some of the files."""
        return _scan(spark, self.uri.rstrip("/"), self.schema, self.partition_columns, files, self.mapped)

    def facts(self) -> dict:
        return {"uri": clean(self.uri), "version": self.version, "files": len(self.files), "bytes": sum(f["size"] or 0 for f in self.files), "reader_version": self.reader_version, "features": self.features}


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    except (PySparkException, Py4JJavaError):
        raise MillraceError("load_source", "no_log", f"no transaction log at {path}") from None


def check_protocol(reader_version: int, features: list[str]) -> None:
    if not 1 <= reader_version <= 3:
        raise MillraceError("preflight", "reader_version", f"reader version {reader_version} is not supported")
    for f in features:
        if f not in FEATURES:
            raise MillraceError("preflight", "reader_feature", f"reader feature {f} is not supported", feature=clean(f))


def check_mapping(configuration: dict[str, str]) -> bool:
    """Whether columns are stored under the physical names of the schema."""
    mode = configuration.get("delta.columnMapping.mode", "none")
    if mode not in ("none", "name"):
        raise MillraceError("preflight", "column_mapping", f"column mapping mode {mode} is not supported", mode=clean(mode))
    return mode == "name"


def _physical(kind: T.DataType) -> T.DataType:
    """The type with the fields' physical names, at any depth."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField((f.metadata or {}).get("delta.columnMapping.physicalName", f.name), _physical(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_physical(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_physical(kind.keyType), _physical(kind.valueType), kind.valueContainsNull)
    return kind


def _actions(spark: SparkSession, log: str, version: int | None) -> tuple[DataFrame, int]:
    names = _names(spark, log)
    commits = {int(m[1]): n for n in names if (m := re.fullmatch(r"(\d{20})\.json", n))}
    checkpoints: dict[int, list[str]] = {}
    for n in names:
        if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.[^.]+(?:\.\d+)?)?\.(parquet|json)", n):
            checkpoints.setdefault(int(m[1]), []).append(n)
    known = [*commits, *checkpoints]
    if not known:
        raise MillraceError("load_source", "no_log", f"no transaction log at {log}")
    last = max(known) if version is None else version
    base = max((v for v in checkpoints if v <= last), default=-1)
    missing = [v for v in range(base + 1, last + 1) if v not in commits]
    if last < 0 or missing or (last not in commits and last != base):
        raise MillraceError("load_source", "no_version", f"version {last} is not available")
    schema = T.StructType.fromDDL(_ACTIONS)
    parts: list[DataFrame] = []
    if new := [f"{log}/{commits[v]}" for v in range(base + 1, last + 1)]:
        parts.append(spark.read.schema(schema).json(new).withColumn("v", F.substring("_metadata.file_name", 1, 20).cast("bigint")))
    if base >= 0:
        found = checkpoints[base]
        top = [n for n in found if n.endswith(".parquet")] or found[:1]
        reader = spark.read.parquet if top[0].endswith(".parquet") else spark.read.schema(schema).json
        own = _aligned(reader(*[f"{log}/{n}" for n in top] if top[0].endswith(".parquet") else [[f"{log}/{n}" for n in top]]), schema)
        parts.append(own.withColumn("v", F.lit(base).cast("bigint")))
        if side := [r.p for r in own.select(F.col("sidecar.path").alias("p")).filter("p is not null").collect()]:
            parts.append(_aligned(spark.read.parquet(*[p if "/" in p else f"{log}/_sidecars/{p}" for p in side]), schema).withColumn("v", F.lit(base).cast("bigint")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, last


def _aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns and fields of the schema; those a checkpoint lacks are null."""
    columns = []
    for f in schema:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        have = set(df.schema[f.name].dataType.names)
        fields = [(F.col(f"{f.name}.{x.name}").cast(x.dataType) if x.name in have else F.lit(None).cast(x.dataType)).alias(x.name) for x in f.dataType]
        columns.append(F.when(F.col(f.name).isNotNull(), F.struct(*fields)).alias(f.name))
    return df.select(*columns)


def z85(text: str) -> bytes:
    out = b""
    for i in range(0, len(text), 5):
        value = 0
        for c in text[i : i + 5]:
            value = value * 85 + Z85.index(c)
        out += struct.pack(">I", value)
    return out


def vector_path(root: str, stored: str) -> str:
    """Absolute path of a deletion-vector file from its relative form: a prefix and 20 characters of an encoded id."""
    prefix, name = stored[:-20], uuid.UUID(bytes=z85(stored[-20:]))
    return f"{root}/{prefix + '/' if prefix else ''}deletion_vector_{name}.bin"


def bitmap_rows(data: bytes) -> np.ndarray:
    """Row numbers in a serialized 64-bit Roaring bitmap array (portable format, with its magic number)."""
    magic, count = struct.unpack_from("<iq", data)
    if magic != 1681511377:
        raise ValueError("not a deletion vector")
    at, out = 12, []
    for _ in range(count):
        (high,) = struct.unpack_from("<I", data, at)
        at += 4
        start = at
        (cookie,) = struct.unpack_from("<I", data, at)
        runs = b""
        if cookie & 0xFFFF == 12347:
            size, at = (cookie >> 16) + 1, at + 4
            runs = data[at : at + (size + 7) // 8]
            at += (size + 7) // 8
        else:
            (size,) = struct.unpack_from("<I", data, at + 4)
            at += 8
        heads = np.frombuffer(data, dtype="<u2", count=2 * size, offset=at).reshape(-1, 2).astype(np.int64)
        at += 4 * size
        if not runs or size >= 4:
            at += 4 * size  # offsets of the containers, which follow in order
        for i, (key, less) in enumerate(heads.tolist()):
            base = (high << 32) + (key << 16)
            if runs and runs[i // 8] >> (i % 8) & 1:
                (n,) = struct.unpack_from("<H", data, at)
                pairs = np.frombuffer(data, dtype="<u2", count=2 * n, offset=at + 2).reshape(-1, 2).astype(np.int64)
                at += 2 + 4 * n
                values = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs.tolist()])
            elif less + 1 > 4096:
                values = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=8192, offset=at), bitorder="little"))
                at += 8192
            else:
                values = np.frombuffer(data, dtype="<u2", count=less + 1, offset=at).astype(np.int64)
                at += 2 * (less + 1)
            out.append(values + base)
        assert at > start
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _deleted(spark: SparkSession, root: str, files: list) -> DataFrame | None:
    """file, row of all rows that deletion vectors hide."""
    stored = [(f["url"], f["deletionVector"]) for f in files if f["deletionVector"]]
    if not stored:
        return None
    place = lambda d: vector_path(root, d["pathOrInlineDv"]) if d["storageType"] == "u" else d["pathOrInlineDv"]
    inline = [(u, z85(d["pathOrInlineDv"]), 0, d["sizeInBytes"]) for u, d in stored if d["storageType"] == "i"]
    outside = [(u, place(d), d["offset"] or 0, d["sizeInBytes"]) for u, d in stored if d["storageType"] != "i"]
    kind = "file string, content binary, at int, size int"
    rows = spark.createDataFrame(inline, kind)
    if outside:
        wanted = spark.createDataFrame(outside, "file string, vector string, at int, size int")
        data = spark.read.format("binaryFile").load(sorted({x[1] for x in outside})).select("path", "content")
        name = lambda c: F.substring_index(c, "/", -1)
        rows = rows.unionByName(wanted.join(data, name(F.col("vector")) == name(F.col("path"))).select("file", "content", F.col("at") + 4, F.col("size")).toDF("file", "content", "at", "size"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content, at, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = bitmap_rows(content[at : at + size])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(found)], names=["_file", "_row"])

    return rows.mapInArrow(decode, "_file string, _row bigint")


def load(spark: SparkSession, uri: str, version: int | None = None) -> Snapshot:
    """The snapshot of the table at `uri`, latest or at an exact version. Nothing but the log is read."""
    root = uri.rstrip("/")
    actions, last = _actions(spark, f"{root}/_delta_log", version)
    newest = Window.partitionBy("key").orderBy(F.col("v").desc(), F.col("live").desc())
    either = F.coalesce("add.path", "remove.path")
    vector = F.coalesce(F.col("add.deletionVector.pathOrInlineDv"), F.col("remove.deletionVector.pathOrInlineDv"), F.lit(""))
    files = actions.filter("add is not null or remove is not null").select("v", F.concat_ws("\u0001", either, vector).alias("key"), F.col("add").isNotNull().alias("live"), "add")
    live = files.withColumn("n", F.row_number().over(newest)).filter("n = 1 and live").select("add.*").orderBy("path").collect()
    meta = actions.filter("metaData is not null").orderBy(F.col("v").desc()).select("metaData.*").first()
    protocol = actions.filter("protocol is not null").orderBy(F.col("v").desc()).select("protocol.*").first()
    if meta is None or protocol is None:
        raise MillraceError("load_source", "incomplete_log", f"the log of {root} has no schema or protocol")
    features = list(protocol["readerFeatures"] or [])
    check_protocol(protocol["minReaderVersion"], features)
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    parts = list(meta["partitionColumns"] or [])
    mapped = check_mapping(meta["configuration"] or {})
    found = [f.asDict(recursive=True) for f in live]
    for f in found:
        path = urllib.parse.unquote(f["path"])
        f["url"] = path if re.match(r"[a-z0-9+.-]+://|/", path) else f"{root}/{path}"
    return Snapshot(uri, last, schema, parts, protocol["minReaderVersion"], features, found, _scan(spark, root, schema, parts, found, mapped), mapped)


def _widened(logical: T.StructType, schema: T.StructType) -> list[str]:
    """Columns, by their name in files, that were widened from a byte or short to a decimal: Spark's reader can't do it."""
    changes = lambda f: (f.metadata or {}).get("delta.typeChanges", [])
    return [p.name for f, p in zip(logical, schema, strict=True) if isinstance(f.dataType, T.DecimalType) and any(c.get("fromType") in ("byte", "short") for c in changes(f))]


def _by_types(spark: SparkSession, stored: T.StructType, widened: list[str], urls: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """The files by the types that they have for widened columns, with the schema to read each group by."""
    if not widened:
        return [(stored, urls)]
    found: dict[str, tuple[T.StructType, list[str]]] = {}
    for u in urls:
        have = {f.name: f.dataType for f in spark.read.parquet(u).schema if f.name in widened}
        own = T.StructType([T.StructField(f.name, have[f.name] if isinstance(have.get(f.name), T.IntegralType) else f.dataType) for f in stored])
        found.setdefault(own.json(), (own, []))[1].append(u)
    return list(found.values())


def may_match(f: JavaObject, stats: dict) -> bool:
    """Whether rows of a file with these statistics of the log can satisfy a data source filter. Unknown counts as yes."""
    kind = f.getClass().getSimpleName()
    if kind == "And":
        return may_match(f.left(), stats) and may_match(f.right(), stats)
    if kind == "Or":
        return may_match(f.left(), stats) or may_match(f.right(), stats)
    if kind not in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "IsNull", "IsNotNull"):
        return True
    name = f.attribute()
    low, high = (stats.get(k, {}).get(name) for k in ("minValues", "maxValues"))
    rows, nulls = stats.get("numRecords"), stats.get("nullCount", {}).get(name)
    if kind == "IsNull":
        return nulls != 0
    if rows is not None and rows == nulls:
        return False
    if kind == "IsNotNull":
        return True
    values = list(f.values()) if kind == "In" else [f.value()]
    if low is None or high is None or not all(_comparable(v, low) and _comparable(v, high) for v in values):
        return True
    if kind in ("EqualTo", "In"):
        return any(low <= v <= high for v in values)
    (v,) = values
    return {"GreaterThan": high > v, "GreaterThanOrEqual": high >= v, "LessThan": low < v, "LessThanOrEqual": low <= v}[kind]


def _comparable(value: object, bound: object) -> bool:
    """Whole numbers and decimals, and strings; floating-point bounds may leave NaN out, and dates are given otherwise."""
    number = lambda x: isinstance(x, (int, Decimal)) and not isinstance(x, bool)
    return number(value) and number(bound) or isinstance(value, str) and isinstance(bound, str)


def pruned(files: list, filters: list[JavaObject]) -> list:
    """The files of which rows can satisfy all filters."""
    return [f for f in files if not f.get("stats") or all(may_match(x, json.loads(f["stats"], parse_float=Decimal)) for x in filters)]


def _relation(spark: SparkSession, stored: T.StructType, parts: T.StructType, files: list) -> DataFrame | None:
    """Spark's file relation over just these files with the partition values of the log.

    None if files of one folder have different values, which Spark's relation can't say.
    """
    folders: dict[str, tuple] = {}
    for f in files:
        values = tuple((f["partitionValues"] or {}).get(c) or None for c in parts.names)
        if folders.setdefault(f["url"].rsplit("/", 1)[0], values) != values:
            return None
    jvm, session = spark._jvm, spark._jsparkSession
    sources, utils = jvm.org.apache.spark.sql.execution.datasources, jvm.org.apache.spark.api.python.PythonUtils
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    table = spark.createDataFrame([(i, *v) for i, v in enumerate(folders.values())], T.StructType([T.StructField("i", T.LongType())] + [T.StructField(c, T.StringType()) for c in parts.names]))
    rows = table.orderBy("i").select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in parts])._jdf.queryExecution().executedPlan().executeCollect()
    paths = [path(u) for u in folders]
    listed = [sources.PartitionPath(r, p.getFileSystem(conf).makeQualified(p)) for r, p in zip(rows, paths, strict=True)]
    kind = lambda t: session.parseDataType(t.json())
    option, none = jvm.scala.Option.apply, utils.toScalaMap(jvm.java.util.HashMap())
    no_cache = getattr(getattr(sources, "NoopCache$"), "MODULE$")
    every = jvm.java.util.ArrayList()
    for f in files:
        every.add(path(f["url"]))
    specs = jvm.java.util.ArrayList()
    for x in listed:
        specs.add(x)
    index = sources.InMemoryFileIndex(session, utils.toSeq(every), none, option(kind(stored)), no_cache, option(sources.PartitionSpec(kind(parts), utils.toSeq(specs))), option(None))
    made = sources.HadoopFsRelation(index, kind(parts), kind(stored), option(None), sources.parquet.ParquetFileFormat(), none, session)
    return DataFrame(session.baseRelationToDataFrame(made), spark)


_FILE = r"^[a-z0-9+.-]+:/+"


def _by_file(spark: SparkSession, stored: T.StructType, parts: T.StructType, files: list) -> DataFrame:
    """The same for files whose folders don't tell their values: these are joined by file, from a table of the log's size."""
    df = spark.read.schema(stored).parquet(*[f["url"] for f in files])
    df = df.select(*[F.col(f"`{f.name}`") for f in stored], _file_name(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = [(re.sub(_FILE, "/", f["url"]), *((f["partitionValues"] or {}).get(c) or None for c in parts.names)) for f in files]
    table = spark.createDataFrame(rows, T.StructType([T.StructField("_file", T.StringType())] + [T.StructField(c, T.StringType()) for c in parts.names]))
    return df.join(table.select("_file", *[F.col(f"`{f.name}`").cast(f.dataType) for f in parts]), "_file", "left")


def _file_name(c: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), _FILE, "/")


def _scan(spark: SparkSession, root: str, schema: T.StructType, parts: list[str], files: list, mapped: bool = False) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    logical = schema
    if mapped:  # files and partition values have the physical names
        schema = _physical(logical)
        parts = [p.name for f, p in zip(logical, schema, strict=True) for c in parts if f.name == c]
    stored = T.StructType([f for f in schema if f.name not in parts])
    apart = T.StructType([schema[c] for c in parts])
    df = None
    for masked in (False, True):
        some = [f for f in files if bool(f["deletionVector"]) == masked]
        by_url = {f["url"]: f for f in some}
        gone = _deleted(spark, root, some) if masked and some else None
        for own, urls in _by_types(spark, stored, _widened(logical, schema), list(by_url)) if some else []:
            group = [by_url[u] for u in urls]
            if (part := _relation(spark, own, apart, group)) is not None:
                place = [_file_name(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row")]
                part = part.select("*", *place) if masked else part
            else:
                part = _by_file(spark, own, apart, group)
            if gone is not None:
                deleted = sum(f["deletionVector"]["cardinality"] or 0 for f in group)
                hidden = gone.withColumn("_file", F.regexp_replace("_file", _FILE, "/"))
                part = part.join(F.broadcast(hidden) if 0 < deleted <= BROADCAST_ROWS else hidden, ["_file", "_row"], "left_anti")
            part = part.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
            df = part if df is None else df.unionByName(part)
    return df.select(*[F.col(f"`{p.name}`").cast(f.dataType).alias(f.name) for f, p in zip(logical, schema, strict=True)])
