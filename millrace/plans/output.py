"""Planning of one output: names, type mapping, table definition and lifecycle. Pure: no rows, no connection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MillraceError

MODES = ("append_existing", "create_and_load", "replace")
EXPECTED = {"append_existing": "exists", "create_and_load": "absent", "replace": "exists_or_absent"}

#: Policies, their choices and the default (first). An integer range stands for {name: N}.
POLICIES: dict[str, tuple] = {
    "string_policy": ("nvarchar_max", "observed_nvarchar", ("nvarchar", 1, 4000)),
    "binary_policy": ("varbinary_max", "observed_varbinary", ("varbinary", 1, 8000)),
    "timezone_policy": ("reject", "datetimeoffset", "normalize_utc_datetime2"),
    "timestamp_policy": (("datetime2", 0, 7), "datetime", "datetime2"),
    "nanosecond_policy": ("reject_non_100ns", "round_to_100ns", "truncate_to_100ns"),
    "uint64_policy": ("reject", "decimal20_0", "checked_bigint"),
    "decimal_policy": ("reject_negative_scale", "normalize_negative_scale"),
    "decimal256_policy": ("checked_downcast", "reject"),
    "float_policy": ("reject_non_finite",),
    "date64_policy": ("reject_non_midnight", "timestamp_datetime2"),
}
VALIDATION = {"target_validation_mode": ("validate_if_possible", "disabled", "require"), "dry_run_scan_summary_mode": ("metadata_only", "exhaust_scan_metadata"), "require_successful_planning": (True, False)}


def check_options(given: Mapping | None, allowed: Mapping[str, tuple]) -> dict:
    """All options with their defaults; unknown names and values are errors."""
    out = {k: ("datetime2" if k == "timestamp_policy" else v[0]) for k, v in allowed.items()}
    for k, v in (given or {}).items():
        if k not in allowed:
            raise MillraceError("configure", "unknown_option", f"unknown option {k}", option=k)
        if isinstance(v, Mapping) and len(v) == 1:
            ((name, n),) = v.items()
            ok = any(isinstance(c, tuple) and c[0] == name and isinstance(n, int) and not isinstance(n, bool) and c[1] <= n <= c[2] for c in allowed[k])
        else:
            ok = any(not isinstance(c, tuple) and c == v and type(c) is type(v) for c in allowed[k])
        if not ok:
            raise MillraceError("configure", "invalid_option", f"{v!r} is no value of {k}", option=k)
        out[k] = v
    return out


@dataclass
class ColumnPlan:
    name: str
    source: T.DataType
    target: str
    nullable: bool
    #: Bounds that rows are checked against in the load itself.
    most: int | None = None
    finite: bool = False


@dataclass
class OutputPlan:
    name: str
    schema: str
    table: str
    mode: str
    columns: list[ColumnPlan]
    create_sql: str | None
    lifecycle: list[str] = field(default_factory=list)

    def facts(self) -> dict:
        return {
            "output": self.name,
            "target": {"schema": self.schema, "table": self.table},
            "load_mode": self.mode,
            "expected_target": EXPECTED[self.mode],
            "columns": [{"name": c.name, "type": c.target, "nullable": c.nullable} for c in self.columns],
            "create_table_sql": self.create_sql if self.mode == "create_and_load" else None,
            "lifecycle": self.lifecycle,
        }


def _length(policy: object, word: str) -> tuple[str, int | None]:
    if isinstance(policy, Mapping):
        n = next(iter(policy.values()))
        return f"{word}({n})", n
    return f"{word}(max)", None


def column_plan(f: T.StructField, options: dict) -> ColumnPlan:
    t, most, finite = f.dataType, None, False
    fixed = {T.BooleanType: "bit", T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint", T.DateType: "date"}
    if type(t) in fixed:
        target = fixed[type(t)]
    elif isinstance(t, T.FloatType):
        target, finite = "real", True
    elif isinstance(t, T.DoubleType):
        target, finite = "float", True
    elif isinstance(t, T.DecimalType):
        target = f"decimal({t.precision},{t.scale})"
    elif isinstance(t, T.StringType):
        target, most = _length(options["string_policy"], "nvarchar")
    elif isinstance(t, T.BinaryType):
        target, most = _length(options["binary_policy"], "varbinary")
    elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        p = options["timestamp_policy"]
        target = "datetime" if p == "datetime" else f"datetime2({p['datetime2'] if isinstance(p, Mapping) else 7})"
        if isinstance(t, T.TimestampType):
            zone = options["timezone_policy"]
            if zone == "reject":
                raise MillraceError("plan_output", "timezone_rejected", f"column {f.name} has a time zone", column=f.name)
            target = "datetimeoffset(7)" if zone == "datetimeoffset" else target
    else:
        raise MillraceError("plan_output", "unsupported_type", f"column {f.name} of type {t.simpleString()} can't be stored", column=f.name)
    return ColumnPlan(f.name, t, target, f.nullable, most, finite)


def quoted(*parts: str) -> str:
    return ".".join(f"[{p.replace(']', ']]')}]" for p in parts)


def create_table(schema: str, table: str, columns: list[ColumnPlan]) -> str:
    if not columns:
        raise MillraceError("plan_output", "no_columns", "a table needs at least one column")
    lines = ",\n".join(f"    {quoted(c.name)} {c.target} {'NULL' if c.nullable else 'NOT NULL'}" for c in columns)
    return f"CREATE TABLE {quoted(schema, table)} (\n{lines}\n);"


def plan_output(df: DataFrame, name: str, schema: str, table: str, mode: str, options: dict) -> OutputPlan:
    if mode not in MODES:
        raise MillraceError("plan_output", "invalid_mode", f"unknown load mode {mode}")
    for part in (schema, table):
        if not part or not part.strip() or "." in part:
            raise MillraceError("plan_output", "invalid_target", "schema and table are plain names")
    names = [f.name for f in df.schema]
    if any(not n.strip() or n == "<unnamed>" for n in names):
        raise MillraceError("plan_output", "unnamed_column", "every output column needs a name")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise MillraceError("plan_output", "duplicate_column", f"output column {twice[0]} appears twice", column=twice[0])
    columns = [column_plan(f, options) for f in df.schema]
    sql = None if mode == "append_existing" else create_table(schema, table, columns)
    steps = ["connect", "probe_target"]
    steps += {"append_existing": ["count_target"], "create_and_load": ["create_target"], "replace": ["create_staging"]}[mode]
    steps += ["load_rows", "validate_rows"] + ["swap"] * (mode == "replace")
    return OutputPlan(name, schema, table, mode, columns, sql, steps)


def shaped(df: DataFrame, plan: OutputPlan, options: dict) -> DataFrame:
    """The rows as they are stored: checks raise on the row that breaks a policy, in the load's own pass."""
    out = []
    for c in plan.columns:
        col = F.col(f"`{c.name}`")
        if c.finite:
            col = F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.raise_error(F.lit(f"column {c.name} has a value that is not finite")).cast(c.source)).otherwise(col)
        if c.most is not None:
            col = F.when(F.length(col) > c.most, F.raise_error(F.lit(f"column {c.name} has a value longer than {c.most}")).cast(c.source)).otherwise(col)
        if isinstance(c.source, T.TimestampType) and options["timezone_policy"] == "normalize_utc_datetime2":
            col = F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
        if c.target == "datetime":
            col = legacy_datetime(col.cast("timestamp_ntz"))
        out.append(col.alias(c.name))
    return df.select(*out)


def legacy_datetime(col):
    """Rounded to the nearest 1/300 second, shown in milliseconds that end in 0, 3 or 7."""
    second = F.date_trunc("second", col).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", second, col)
    ticks = F.floor((micros * 3 + 5000) / 10000)
    millis = F.floor(ticks / 3) * 10 + F.when(ticks % 3 == 1, 3).when(ticks % 3 == 2, 7).otherwise(0)
    return F.timestamp_add("MILLISECOND", millis.cast("int"), second).cast("timestamp_ntz")
