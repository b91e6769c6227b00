"""A session: sources, derived tables, previews, dry runs and loads."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import wraps

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udf, udtf
from pyspark.storagelevel import StorageLevel

from millrace.errors import MillraceError, clean
from millrace.functions.names import check_name, fnv1a64
from millrace.logs import event
from millrace.operators.load import Target, load, observed
from millrace.operators.preview import Preview, preview
from millrace.plans.cache import Alias, plan_cache, reachable
from millrace.plans.gate import Lineage, check_tables, lineage, parse, walk_with_parent, whole_division
from millrace.plans.output import MODES, POLICIES, VALIDATION, OutputPlan, check_options, plan_output
from millrace.sources import delta

#: Scan options that Spark has settings for.
SCAN = {"max_partition_bytes": "spark.sql.files.maxPartitionBytes", "min_partitions": "spark.sql.files.minPartitionNum", "open_cost_bytes": "spark.sql.files.openCostInBytes"}

#: Scan options of native readers, checked and reported as not applicable.
READER = [
    "max_concurrent_file_reads_per_scan",
    "max_concurrent_file_reads_per_partition",
    "output_buffer_capacity_per_partition",
    "native_async_prefetch_file_count_per_partition",
    "parquet_metadata_size_hint",
    "parquet_full_file_read_threshold",
]


def _exclusive(f: Callable) -> Callable:
    """One thread at a time may change a session; another one gets an error at once."""

    @wraps(f)
    def run(self, *a, **k):
        if not self._lock.acquire(blocking=False):
            raise MillraceError("session", "busy", "the session is in use by another thread")
        try:
            return f(self, *a, **k)
        finally:
            self._lock.release()

    return run


@dataclass
class Table:
    """A lazy table of a session; `name` is None until it is registered."""

    session: Session
    id: int
    kind: str
    name: str | None
    sql: str | None = None
    lineage: Lineage | None = None
    snapshot: delta.Snapshot | None = None
    df_: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        """A fresh DataFrame each time, so that what is kept meanwhile is used."""
        if self.name:
            return self.session.spark.table(self.name)
        return self.session._pruned(self.sql, self.lineage) if self.sql else self.df_

    @property
    def label(self) -> str:
        return self.name or f"table_{self.id}"

    def alias(self, name: str) -> Table:
        return self.session._alias(self, name)

    def preview(self, n: int = 20) -> Preview:
        if n < 0:
            raise MillraceError("preview", "invalid_limit", "the limit is negative")
        return preview(self.df, n)

    def show(self, n: int = 20) -> None:
        print(self.preview(n))

    def to_target(self, schema: str, table: str, load_mode: str = "append_existing", name: str | None = None, target: Target | None = None) -> Output:
        if load_mode not in MODES:
            raise MillraceError("plan_output", "invalid_mode", f"unknown load mode {load_mode}")
        return Output(self, schema, table, load_mode, name or table, target)


@dataclass
class Output:
    source: Table
    schema: str
    table: str
    mode: str
    name: str
    target: Target | None = None


class Session:
    def __init__(self, spark: SparkSession, *, default_target: Target | None = None, target_partitions: int | None = None, output_batch_size: int | None = None, scan_options: Mapping[str, int] | None = None, schema_options: Mapping | None = None, validation_options: Mapping | None = None, progress: Callable[[dict], None] | None = None, integer_division: str = "whole"):
        for k, v in (("target_partitions", target_partitions), ("output_batch_size", output_batch_size), *(scan_options or {}).items()):
            if v is not None and (not isinstance(v, int) or isinstance(v, bool) or v <= 0):
                raise MillraceError("configure", "invalid_option", f"{k} must be a positive integer", option=k)
        for k in scan_options or {}:
            if k not in SCAN and k not in READER:
                raise MillraceError("configure", "unknown_option", f"unknown scan option {k}", option=k)
        if integer_division not in ("whole", "fraction"):
            raise MillraceError("configure", "invalid_option", "integer_division is whole or fraction", option="integer_division")
        self.integer_division = integer_division
        self.schema_options = check_options(schema_options, POLICIES)
        self.validation = check_options(validation_options, VALIDATION)
        self.spark = spark.newSession()
        if target_partitions:
            self.spark.conf.set("spark.sql.shuffle.partitions", target_partitions)
        if output_batch_size:
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", output_batch_size)
        self.not_applicable = [k for k in scan_options or {} if k not in SCAN]
        for k, v in (scan_options or {}).items():
            if k in SCAN:
                self.spark.conf.set(SCAN[k], v)
        self.default_target, self.progress = default_target, progress
        self.tables: dict[str, Table] = {}
        self._next, self._lock, self._keeping = 1, threading.RLock(), False

    def _tell(self, operation: str, phase: str, kind: str, **facts: object) -> None:
        told = event(operation, phase, kind, **facts)
        if self.progress:
            self.progress(told)

    def _id(self) -> int:
        self._next += 1
        return self._next - 1

    @_exclusive
    def register(self, name: str, df: DataFrame) -> Table:
        """An existing DataFrame (files, memory) as a source."""
        check_name(name, self.tables)
        df.createOrReplaceTempView(name) if df.sparkSession is self.spark else self._adopt(name, df)
        self.tables[name.lower()] = t = Table(self, self._id(), "source", name, df_=df)
        return t

    def _adopt(self, name: str, df: DataFrame) -> None:
        plan = df._jdf.queryExecution().analyzed()
        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        jdf.createOrReplaceTempView(name)

    @_exclusive
    def delta_lake(self, uri: str, *, version: int | None = None, storage_options: Mapping[str, str] | None = None, name: str | None = None) -> Table:
        """A snapshot of a table with a transaction log; without a name it waits for alias()."""
        if name is not None:
            check_name(name, self.tables)
        self._tell("register", "load_source", "started", uri=delta.clean(uri))
        for k, v in object_store(uri, storage_options or {}).items():
            self.spark._jsc.hadoopConfiguration().set(k, v)
        began = time.time()
        snapshot = delta.load(self.spark, uri, version)
        t = Table(self, self._id(), "source", None, snapshot=snapshot, df_=snapshot.df)
        self._tell("register", "load_source", "finished", seconds=time.time() - began, **snapshot.facts())
        return self._alias(t, name) if name else t

    def delta_lakes(self, sources: Mapping[str, tuple[str, int | None]]) -> list[Table]:
        """Several sources, all or none."""
        done: list[str] = []
        try:
            for name, (uri, version) in sources.items():
                self.delta_lake(uri, version=version, name=name)
                done.append(name)
        except Exception:
            for name in reversed(done):
                self.spark.catalog.dropTempView(name)
                del self.tables[name.lower()]
            raise
        return [self.tables[n.lower()] for n in sources]

    def _plan(self, sql: str) -> DataFrame:
        try:
            return self.spark.sql(sql)
        except (AnalysisException, ParseException) as e:
            raise MillraceError("plan_sql", "plan_error", str(e).split("\n")[0]) from None

    @_exclusive
    def table_from_sql(self, sql: str) -> Table:
        """A lazy table from one read-only query; it is planned, and no row is read."""
        text, plan = parse(self.spark, sql)
        found = lineage(self.spark, plan)
        check_tables(found, set(self.tables))
        df = self._plan(text)
        while self.integer_division == "whole" and "/" in text and (whole := whole_division(self.spark, text, df)) != text:
            text, df = whole, self._plan(whole)  # a division around one that was a fraction may be one of whole numbers now
        return Table(self, self._id(), "derived", None, sql=text, lineage=found, df_=df)

    @_exclusive
    def register_function(self, name: str, f: Callable | type, returns: str | None = None, deterministic: bool = True) -> None:
        """A function for this session's queries: a Python or pandas function, scalar or aggregate, or a class with eval() that returns tables."""
        check_name(name)
        if isinstance(f, type):
            self.spark.udtf.register(name, udtf(f, returnType=returns))
            return
        made = f if hasattr(f, "evalType") else udf(f, returns or "string")
        self.spark.udf.register(name, made if deterministic else made.asNondeterministic())

    def _pruned(self, sql: str, of: Lineage | None) -> DataFrame:
        """The planned query, in which snapshots list only files whose statistics in the log allow rows that its filters pass.

        The filters are those that Catalyst has pushed to each scan. The views behind the query are planned anew over the
        shorter lists and then put back.
        """
        df = self._plan(sql)
        names = reachable(of.tables, {n: Alias(n, t.lineage.tables) for n, t in self.tables.items() if t.lineage}) if of else set()
        behind = sorted((self.tables[n] for n in names if n in self.tables), key=lambda t: t.id)
        shorter = {}
        if not self._keeping:
            sources = [t for t in behind if t.snapshot and any(f.get("stats") for f in t.snapshot.files)]
            found = scan_filters(self.spark, df) if sources else []
            for t in sources:
                uses = [filters for files, filters in found if files & {f["url"].rsplit("/", 1)[1] for f in t.snapshot.files}]
                urls = {f["url"] for filters in uses for f in delta.pruned(t.snapshot.files, filters)}
                if uses and len(urls) < len(t.snapshot.files):
                    shorter[t.name] = t.snapshot.of(self.spark, [f for f in t.snapshot.files if f["url"] in urls])
        if not shorter:
            return df
        try:
            for name, part in shorter.items():
                part.createOrReplaceTempView(name)
            for t in behind:
                if t.sql:
                    self._plan(t.sql).createOrReplaceTempView(t.name)
            return self._plan(sql)
        finally:
            for t in behind:
                if t.sql or t.name in shorter:
                    t.df_.createOrReplaceTempView(t.name)

    @_exclusive
    def _alias(self, t: Table, name: str) -> Table:
        if t.session is not self:
            raise MillraceError("register", "foreign_table", "the table belongs to another session")
        check_name(name, self.tables)
        (t.df_ if t.snapshot else self._plan(t.sql)).createOrReplaceTempView(name)
        t.name = name
        self.tables[name.lower()] = t
        return t

    def sources_of(self, t: Table) -> dict:
        """Sources behind a table, and whether all of its lineage is known."""
        names, unknown, seen = set(), False, set()
        todo = [t]
        while todo:
            x = todo.pop()
            if x.id in seen:
                continue
            seen.add(x.id)
            if x.kind == "source":
                names.add(x.label)
                continue
            unknown |= bool(x.lineage.unknown or x.lineage.incomplete)
            for n in x.lineage.tables:
                todo.append(self.tables[n]) if n in self.tables else None
                unknown |= n not in self.tables
        return {"sources": sorted(names), "complete": not unknown}

    def _planned(self, o: Output) -> OutputPlan:
        if o.source.session is not self:
            raise MillraceError("plan_output", "foreign_table", "the output belongs to another session")
        return plan_output(o.source.df, o.name, o.schema, o.table, o.mode, self.schema_options)

    def _target(self, o: Output) -> Target:
        if (t := o.target or self.default_target) is None:
            raise MillraceError("plan_output", "no_connection", "neither the output nor the session has a connection")
        return t

    def dry_run(self, outputs: Sequence[Output] | Output) -> dict:
        """Plans of all outputs: no rows, no connection. File counts where the scan summary asks for them."""
        outputs = [outputs] if isinstance(outputs, Output) else list(outputs)
        self._unique(outputs)
        found = []
        for o in outputs:
            facts = self._planned(o).facts()
            facts["sql_hash"] = fnv1a64(o.source.sql) if o.source.sql else None
            facts |= self.sources_of(o.source)
            if self.validation["dry_run_scan_summary_mode"] == "exhaust_scan_metadata":
                facts["files"] = len(o.source.df.inputFiles())
            found.append(facts)
        return {"run_mode": "dry_run", "outputs": found, "sources": self.source_report(outputs)}

    def source_report(self, outputs: Sequence[Output]) -> list[dict]:
        used = {o.name: self.sources_of(o.source)["sources"] for o in outputs}
        return [{"source": t.label, "used_by": sorted(o for o, s in used.items() if t.label in s), **(t.snapshot.facts() if t.snapshot else {})} for t in self.tables.values() if t.kind == "source"]

    def _unique(self, outputs: Sequence[Output]) -> None:
        names = [o.name.lower() for o in outputs]
        if not names or len(set(names)) < len(names):
            raise MillraceError("plan_output", "output_names", "outputs need one name each")

    def write(self, output: Output) -> dict:
        return self.write_all([output])["outputs"][0]

    @_exclusive
    def write_all(self, outputs: Sequence[Output], *, cache: str | Sequence[str] = "auto", max_parallel_outputs: int = 1, stream_only: bool = False, profile: bool = False) -> dict:
        """Plan all outputs, keep what several of them share, then load them in turn; after a failure the rest is skipped.

        stream_only runs and counts every output without a target.
        """
        if max_parallel_outputs != 1:
            raise MillraceError("configure", "parallel_outputs", "outputs are loaded one at a time")
        self._unique(outputs)
        plans = [self._planned(o) for o in outputs]
        targets = [None if stream_only else self._target(o) for o in outputs]
        aliases = {n: Alias(n, t.lineage.tables, not (t.lineage.unknown or t.lineage.incomplete), t.id) for n, t in self.tables.items() if t.kind == "derived"}
        reads = [[o.source.name.lower()] if o.source.name else o.source.lineage.tables if o.source.lineage else [] for o in outputs]
        known = [not (o.source.lineage and (o.source.lineage.unknown or o.source.lineage.incomplete)) for o in outputs]
        chosen = plan_cache(cache, reads, aliases, known)
        kept: list[DataFrame] = []
        reports: list[dict] = []
        try:
            self._keeping = bool(chosen.selected)  # what is kept is found by its plan, so plans stay as they are
            for name in chosen.selected:
                df = self.spark.table(name).persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(df)
                self._tell("write_all", "cache", "started", alias=name)
                df.write.format("noop").mode("overwrite").save()
            for o, plan, target in zip(outputs, plans, targets, strict=True):
                if reports and reports[-1]["status"] != "succeeded":
                    reports.append({**plan.facts(), "status": "skipped", "reason": "previous_output_failed"})
                    continue
                self._tell("write_all", "output", "started", output=o.name)
                began, before = time.time(), last_execution(self.spark) if profile else -1
                try:
                    report = self._streamed(o, plan) if stream_only else load(o.source.df, observed(o.source.df, plan, self.schema_options), target, self.schema_options, self.validation["target_validation_mode"])
                except MillraceError as e:
                    report = {**getattr(e, "report", plan.facts()), "status": "failed", "error": {"phase": e.phase, "kind": e.kind, "message": e.message}}
                report["seconds"] = time.time() - began
                if profile:
                    report["profile"] = operators(self.spark, before)
                reports.append(report)
                self._tell("write_all", "output", "finished", output=o.name, status=report["status"])
        finally:
            self._keeping = False
            for df in kept:
                df.unpersist()
        return {"run_mode": "execute", "outputs": reports, "cache": {"mode": chosen.mode, "selected": chosen.selected, "covered": chosen.covered, "skipped": chosen.skipped}, "sources": self.source_report(outputs), "not_applicable": self.not_applicable}

    def _streamed(self, o: Output, plan: OutputPlan) -> dict:
        from pyspark.sql import Observation
        from pyspark.sql import functions as F

        from millrace.plans.output import shaped

        seen = Observation("rows")
        try:
            shaped(o.source.df, plan, self.schema_options).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        except PySparkException as e:
            raise MillraceError("run_query", "query_failed", f"{type(e).__name__}: {str(e)[:300]}") from e
        return {**plan.facts(), "status": "succeeded", "rows_streamed": seen.get["n"], "rows_written": 0}


def scan_filters(spark: SparkSession, df: DataFrame) -> list[tuple[set[str], list]]:
    """For each file scan of the optimized plan: the names of its files, and the filters right above it that sources understand."""
    out: list[tuple[set[str], list]] = []
    strategy = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.datasources, "DataSourceStrategy$"), "MODULE$")

    def conjuncts(e: JavaObject) -> list:
        return [*conjuncts(e.left()), *conjuncts(e.right())] if e.nodeName() == "And" else [e]

    for node, above in walk_with_parent(spark, df._jdf.queryExecution().optimizedPlan()):
        if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
            continue
        filters = []
        if above is not None and above.getClass().getSimpleName() == "Filter":
            for e in conjuncts(above.condition()):
                if (f := strategy.translateFilter(e, False)).isDefined():
                    filters.append(f.get())
        out.append(({str(x).rsplit("/", 1)[1] for x in node.relation().location().inputFiles()}, filters))
    return out


def last_execution(spark: SparkSession) -> int:
    """The number of the last query that has started."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((listed.apply(i).executionId() for i in range(listed.size())), default=-1)


def operators(spark: SparkSession, after: int) -> list[dict]:
    """Operators of the queries that ran after a number, from their final plans: pre-order, with ids, parents and metrics."""
    newest = last_execution(spark)
    store = spark._jsparkSession.sharedState().statusStore()
    out: list[dict] = []
    for execution in range(after + 1, newest + 1):
        if store.execution(execution).isEmpty():
            continue
        graph, values = store.planGraph(execution), store.executionMetrics(execution)
        nodes, children, below = {}, {}, set()
        every = graph.allNodes()
        for i in range(every.size()):
            if not every.apply(i).getClass().getSimpleName().endswith("Cluster"):
                nodes[every.apply(i).id()] = every.apply(i)
        for i in range(graph.edges().size()):
            e = graph.edges().apply(i)
            children.setdefault(e.toId(), []).append(e.fromId())
            below.add(e.fromId())
        todo = [(n, None) for n in sorted(set(nodes) - below, reverse=True)]
        while todo:
            n, parent = todo.pop()
            metrics = {}
            for i in range(nodes[n].metrics().size()):
                m = nodes[n].metrics().apply(i)
                if (v := values.get(m.accumulatorId())).isDefined():
                    metrics[clean(m.name())] = {"kind": m.metricType(), "value": v.get()}
            out.append({"id": len(out), "parent": parent, "execution": execution, "operator": clean(nodes[n].name().strip()), "metrics": metrics})
            todo += [(c, len(out) - 1) for c in sorted(children.get(n, []), reverse=True)]
    return out


def object_store(uri: str, options: Mapping[str, str], environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Hadoop settings of an S3-like source: options as given, then AWS_ variables where no option says the same."""
    env = os.environ if environment is None else environment
    scheme = uri.split("://")[0].lower() if "://" in uri else ""
    host = uri.split("://")[-1].split("/")[0].lower()
    if not (scheme in ("s3", "s3a") or scheme == "https" and (host.endswith("amazonaws.com") or host.endswith("r2.cloudflarestorage.com"))):
        return {}
    merged = {k.lower().removeprefix("aws_"): v for k, v in env.items() if k.startswith("AWS_")} | {k.lower().removeprefix("aws_"): v for k, v in options.items()}
    region = merged.get("region") or merged.get("default_region")
    known = {"access_key_id": "access.key", "secret_access_key": "secret.key", "session_token": "session.token", "endpoint": "endpoint", "endpoint_url": "endpoint"}
    # settings of the one bucket: a second source with other keys doesn't change the first
    own = f"fs.s3a.bucket.{host}" if scheme in ("s3", "s3a") else "fs.s3a"
    return {f"{own}.{known[k]}": v for k, v in merged.items() if k in known} | ({f"{own}.endpoint.region": region} if region else {})


def auth_mode(settings: Mapping[str, str]) -> str:
    """How an S3 source is authorised, for messages: static, web_identity, container, other or implicit."""
    have = {k.lower().removeprefix("aws_") for k, v in settings.items() if v}
    if {"access_key_id", "secret_access_key"} <= have:
        return "static"
    if {"web_identity_token_file", "role_arn"} <= have:
        return "web_identity"
    if have & {"container_credentials_relative_uri", "container_credentials_full_uri"}:
        return "container"
    return "other" if have & {"skip_signature", "profile"} else "implicit"
