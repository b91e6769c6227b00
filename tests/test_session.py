import json
import struct

import numpy as np
import pytest

from millrace.errors import MillraceError, clean
from millrace.functions.dialect import to_spark
from millrace.functions.names import check_name, fnv1a64
from millrace.operators.load import JdbcTarget
from millrace.plans.cache import Alias, plan_cache
from millrace.session import Session, auth_mode, object_store
from millrace.sources.delta import bitmap_rows, check_protocol
from millrace.streaming.handoff import hand_off


def kind(f, *a, **k):
    with pytest.raises(MillraceError) as e:
        f(*a, **k)
    return e.value.kind


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.register("orders", s.spark.createDataFrame([(1, 10, "west"), (2, 11, "east"), (3, 10, None)], "id int, customer_id int, region string"))
    s.register("customers", s.spark.createDataFrame([(10, "Ann & Co"), (11, "<b>")], "id int, customer_name string"))
    return s


def bitmap(rows):
    low = np.array(sorted(rows), dtype="<u2")
    return struct.pack("<iq", 1681511377, 1) + struct.pack("<I", 0) + struct.pack("<II", 12346, 1) + struct.pack("<HH", 0, len(low) - 1) + struct.pack("<I", 16) + low.tobytes()


def write_table(spark, tmp_path):
    root = tmp_path / "t"
    log = root / "_delta_log"
    log.mkdir(parents=True)
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("id", "long"), ("name", "string"), ("region", "string"))]}
    adds = []
    for i, region in enumerate(["west", "east"]):
        d = root / f"f{i}"
        spark.range(i * 10, i * 10 + 5).selectExpr("cast(id as int) as id", "concat('n', id) as name").coalesce(1).write.parquet(str(d))
        f = next(x for x in d.iterdir() if x.suffix == ".parquet")
        adds.append({"add": {"path": f"f{i}/{f.name}", "partitionValues": {"region": region}, "size": f.stat().st_size, "modificationTime": 0, "dataChange": True}})
    head = [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors"]}}, {"metaData": {"id": "x", "format": {"provider": "parquet"}, "schemaString": json.dumps(schema), "partitionColumns": ["region"], "configuration": {}}}]
    put = lambda v, actions: (log / f"{v:020}.json").write_text("\n".join(map(json.dumps, actions)))
    put(0, [*head, adds[0]])
    put(1, [adds[1]])
    raw = bitmap([1, 3])
    name = b"0123456789abcdef"
    import uuid

    (root / f"deletion_vector_{uuid.UUID(bytes=name)}.bin").write_bytes(b"\x01" + struct.pack(">I", len(raw)) + raw + b"\0\0\0\0")
    alphabet = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
    enc = ""
    for (v,) in struct.iter_unpack(">I", name):
        enc += "".join(alphabet[v // 85**k % 85] for k in range(4, -1, -1))
    masked = {**adds[0]["add"], "deletionVector": {"storageType": "u", "pathOrInlineDv": enc, "offset": 1, "sizeInBytes": len(raw), "cardinality": 2}}
    put(2, [{"remove": {"path": adds[0]["add"]["path"], "dataChange": True}}, {"add": masked}])
    put(3, [{"remove": {"path": adds[1]["add"]["path"], "dataChange": True}}])
    return str(root)


def test_snapshots(spark, tmp_path):
    s = Session(spark)
    root = write_table(spark, tmp_path)
    rows = lambda v: sorted(map(tuple, s.delta_lake(root, version=v).df_.collect()))
    west = [(i, f"n{i}", "west") for i in range(5)]
    east = [(i, f"n{i}", "east") for i in range(10, 15)]
    assert rows(0) == west and rows(1) == sorted(west + east)
    assert rows(2) == sorted([w for w in west if w[0] not in (1, 3)] + east)
    assert rows(None) == [w for w in west if w[0] not in (1, 3)]
    assert kind(s.delta_lake, root, version=9) == "no_version" and kind(s.delta_lake, str(tmp_path / "none")) == "no_log"
    t = s.delta_lake(root, name="t")
    assert t.snapshot.version == 3 and s.table_from_sql("select count(*) as n from t").df.first().n == 3
    assert kind(s.delta_lakes, {"a": (root, None), "b": (root + "x", None)}) == "no_log" and "a" not in s.tables


def write_log(root, fields, files, parts=(), configuration=None, features=None):
    """A table of one commit; files: (DataFrame, partition values)."""
    (root / "_delta_log").mkdir(parents=True)
    reader = {"minReaderVersion": 3, "readerFeatures": features} if features else {"minReaderVersion": 2}
    schema = {"type": "struct", "fields": fields}
    actions = [{"protocol": {**reader, "minWriterVersion": 7}}, {"metaData": {"id": "x", "format": {"provider": "parquet"}, "schemaString": json.dumps(schema), "partitionColumns": list(parts), "configuration": configuration or {}}}]
    for i, (df, values) in enumerate(files):
        df.coalesce(1).write.parquet(str(root / f"f{i}"))
        f = next(x for x in (root / f"f{i}").iterdir() if x.suffix == ".parquet")
        actions.append({"add": {"path": f"f{i}/{f.name}", "partitionValues": values, "size": f.stat().st_size, "modificationTime": 0, "dataChange": True}})
    (root / "_delta_log" / f"{0:020}.json").write_text("\n".join(map(json.dumps, actions)))
    return str(root)


def test_mapped_columns(spark, tmp_path):
    field = lambda name, kind, physical: {"name": name, "type": kind, "nullable": True, "metadata": {"delta.columnMapping.id": 1, "delta.columnMapping.physicalName": physical}}
    fields = [field("region", "string", "c1"), field("id", "long", "c2"), field("at", {"type": "struct", "fields": [field("x", "long", "c4")]}, "id")]
    file = lambda i: spark.range(i, i + 2).selectExpr("id as c2", "struct(-id as c4) as id")
    files = [(file(0), {"c1": "west"}), (file(10), {"c1": "east"})]
    for n, features in enumerate((None, ["columnMapping"])):
        root = write_log(tmp_path / f"m{n}", fields, files, ["region"], {"delta.columnMapping.mode": "name"}, features)
        got = Session(spark).delta_lake(root).df_
        assert got.columns == ["region", "id", "at"] and got.selectExpr("at.x").columns == ["x"]
        assert sorted((r.region, r.id, r["at"]["x"]) for r in got.collect()) == [("east", 10, -10), ("east", 11, -11), ("west", 0, 0), ("west", 1, -1)]
    root = write_log(tmp_path / "by_id", fields, files, ["region"], {"delta.columnMapping.mode": "id"})
    assert kind(Session(spark).delta_lake, root) == "column_mapping"


def test_widened_to_decimal(spark, tmp_path):
    changes = [{"fromType": "byte", "toType": "decimal(6,1)"}]
    fields = [{"name": "v", "type": "decimal(6,1)", "nullable": True, "metadata": {"delta.typeChanges": changes}}]
    files = [(spark.sql(f"select cast({x}) as v"), {}) for x in ("3 as byte", "4 as short", "5.5 as decimal(6,1)")]
    root = write_log(tmp_path / "w", fields, files, features=["typeWidening"])
    assert sorted(float(r.v) for r in Session(spark).delta_lake(root).df_.collect()) == [3.0, 4.0, 5.5]


def test_protocol_and_bitmaps():
    assert kind(check_protocol, 4, []) == "reader_version" and kind(check_protocol, 3, ["odd\nname"]) == "reader_feature"
    assert bitmap_rows(bitmap([0, 7, 4095])).tolist() == [0, 7, 4095]


def test_names():
    assert check_name("_a1") == "_a1" and fnv1a64("") == "cbf29ce484222325"
    for bad in ("", "1a", "a-b", "select"):
        assert kind(check_name, bad, ["1a"]) == "invalid_name"
    assert kind(check_name, "Orders", ["orders"]) == "duplicate_name"
    assert clean("s3://me:pw@h/p?token=1\n") == "s3://h/p\\x0a"


def test_gate_and_lineage(session):
    for sql, k in (("", "empty_sql"), ("select 1; select 2", "parse_error"), ("drop table x", "not_read_only"), ("insert into orders values (1)", "not_read_only"), ("set a=b", "not_read_only"), ("explain select 1", "not_read_only"), ("select * from nowhere", "unknown_table"), ("select * from parquet.`/tmp`", "unknown_table"), ("select java_method('a', 'b')", "not_allowed"), ("select nothing from orders", "plan_error"), ("selec 1", "parse_error")):
        assert kind(session.table_from_sql, sql) == k, sql
    t = session.table_from_sql("with orders as (select * from customers) select * from orders where id in (select id from customers)")
    assert t.lineage.tables == ["customers"] and t.lineage.local == ["orders"]
    west = session.table_from_sql("select * from orders where region = 'west'").alias("west")
    assert session.sources_of(session.table_from_sql("select * from WEST w join customers c on w.customer_id = c.id")) == {"sources": ["customers", "orders"], "complete": True}
    assert kind(west.alias, "orders") == "duplicate_name"
    assert to_spark("select 'varchar', cast(a as varchar), cast(b as varchar(3)) -- varchar") == "select 'varchar', cast(a as STRING), cast(b as varchar(3)) -- varchar"


def test_division_by_zero_fails(session):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        session.table_from_sql("select cast(1 as bigint) / (id - id) as x from orders").preview()


def test_preview(session):
    p = session.table_from_sql("select id, region from orders order by id").preview(2)
    assert p.text() == "+----+--------+\n| id | region |\n+----+--------+\n| 1  | west   |\n| 2  | east   |\n+----+--------+"
    assert "2 rows, 2 columns" in p.html() and '<td class="number">1</td>' in p.html()
    assert "&lt;b&gt;" in session.table_from_sql("select customer_name from customers").preview().html()
    assert "<i>null</i>" in session.table_from_sql("select region from orders where id = 3").preview().html()


def test_planning(session):
    t = session.table_from_sql("select cast(id as bigint) as order_id, region as status from orders where id is not null")
    facts = session.dry_run(t.to_target("dbo", "orders", "create_and_load"))["outputs"][0]
    assert facts["create_table_sql"].startswith("CREATE TABLE [dbo].[orders] (\n    [order_id] bigint N") and facts["sources"] == ["orders"]
    plan = lambda sql, **k: session.dry_run(session.table_from_sql(sql).to_target("dbo", "x", "create_and_load", **k))
    assert kind(plan, "select array(1) as tags") == "unsupported_type"
    assert kind(plan, "select 1 as a, 2 as a") == "duplicate_column" and kind(plan, "select current_timestamp() as t") == "timezone_rejected"
    assert kind(session.dry_run, t.to_target("a.b", "x")) == "invalid_target"
    assert kind(Session, session.spark, schema_options={"float_policy": "x"}) == "invalid_option" and kind(Session, session.spark, target_partitions=0) == "invalid_option"
    assert kind(session.write_all, [t.to_target("a", "x")], max_parallel_outputs=2) == "parallel_outputs"
    assert kind(session.write, t.to_target("a", "x")) == "no_connection"


def test_legacy_datetime(spark):
    from pyspark.sql import functions as F

    from millrace.plans.output import legacy_datetime

    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.001' as a, timestamp_ntz'2024-01-01 00:00:00.002' as b, timestamp_ntz'2024-01-01 23:59:59.999' as c")
    got = df.select(*[legacy_datetime(F.col(x)).cast("string").alias(x) for x in "abc"]).first()
    assert tuple(got) == ("2024-01-01 00:00:00", "2024-01-01 00:00:00.003", "2024-01-02 00:00:00")


def test_cache_plans():
    a = {"base": Alias("base", ["orders"], order=1), "west": Alias("west", ["base"], order=2), "lost": Alias("lost", ["x"], False, 3)}
    assert plan_cache("auto", [["west"], ["west"]], a).selected == ["west"] and plan_cache("auto", [["west"], ["west"]], a).covered == ["base"]
    assert plan_cache("auto", [["west"], ["base"]], a).selected == ["base"] and plan_cache("auto", [["west"]], a).skipped
    assert plan_cache("disabled", [["west"], ["west"]], a).skipped == "disabled" and plan_cache(["BASE"], [["west"], ["base"]], a).selected == ["base"]
    for names, k in (([], "empty_list"), (["base", "BASE"], "duplicate_alias"), (["no"], "unknown_alias"), (["lost"], "not_eligible")):
        assert kind(plan_cache, names, [["west"], ["west", "lost"]], a) == k


def test_loads(session, tmp_path):
    target = JdbcTarget(session.spark, f"jdbc:derby:{tmp_path}/db;create=true", "derby", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    session.default_target = target
    t = session.table_from_sql("select id, customer_id from orders").alias("small")
    assert "***" in repr(target) and kind(JdbcTarget, session.spark, " ") == "blank_connection"
    make = t.to_target("APP", "T1", "create_and_load")
    assert session.write(make)["rows_written"] == 3 and target.count("APP", "T1") == 3
    again = session.write(make)
    assert again["status"] == "failed" and again["error"]["kind"] == "target_exists" and target.count("APP", "T1") == 3
    assert session.write(t.to_target("APP", "T1"))["validated"] and target.count("APP", "T1") == 6
    assert session.write(t.to_target("APP", "T1", "replace"))["status"] == "succeeded" and target.count("APP", "T1") == 3
    bad = session.table_from_sql("select id, customer_id / (id - id) as customer_id from orders").to_target("APP", "T2", "create_and_load")
    report = session.write_all([bad, t.to_target("APP", "T1", name="later")])
    assert [r["status"] for r in report["outputs"]] == ["failed", "skipped"] and not target.exists("APP", "T2")
    both = session.write_all([t.to_target("APP", "T1", name="a"), t.to_target("APP", "T1", name="b")], profile=True)
    assert both["cache"]["selected"] == ["small"] and target.count("APP", "T1") == 9 and both["outputs"][0]["profile"]
    assert session.write_all([t.to_target("APP", "NONE")], stream_only=True)["outputs"][0]["rows_streamed"] == 3
    strict = Session(session.spark, validation_options={"target_validation_mode": "disabled"}, default_target=target)
    strict.register("x", strict.spark.range(2))
    assert strict.write(strict.table_from_sql("select id from x").to_target("APP", "T3", "replace"))["error"]["kind"] == "validation_required"


def test_reports_of_loads(session, tmp_path, monkeypatch):
    target = JdbcTarget(session.spark, f"jdbc:derby:{tmp_path}/db;create=true", "derby", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    s = Session(session.spark, default_target=target, schema_options={"string_policy": "observed_nvarchar"}, validation_options={"target_validation_mode": "require"})
    s.register("orders", s.spark.createDataFrame([(1, "west"), (2, "a")], "id int, region string"))
    t = s.table_from_sql("select * from orders")
    done = s.write_all([t.to_target("APP", "T", "create_and_load")], profile=True)["outputs"][0]
    assert [p["phase"] for p in done["phases"]] == ["probe_target", "check_schema", "prepare_target", "write_rows", "count_after", "validate_rows"]
    assert done["columns"][1]["type"] == "nvarchar(4)" and done["validation"] == "passed" and done["rows_in"] == 2
    profile = done["profile"]
    assert len(profile) > 1 and any(p["metrics"] for p in profile) and all(p["parent"] is None or p["parent"] < p["id"] for p in profile)
    monkeypatch.setattr(target, "count", lambda *a: 1 / 0)
    lost = s.write(t.to_target("APP", "T2", "create_and_load"))
    assert lost["status"] == "failed" and lost["error"]["kind"] == "count_unavailable" and not target.exists("APP", "T2") and lost["phases"][-1]["phase"] == "cleanup"
    loose = Session(session.spark, default_target=target)
    loose.register("x", loose.spark.range(3))
    assert loose.write(loose.table_from_sql("select id from x").to_target("APP", "T3", "create_and_load"))["validation"] == "unavailable"
    bad = loose.write(loose.table_from_sql("select id div (id - 2) as id from x").to_target("APP", "T3"))
    assert bad["rows_written"] == "unavailable" and bad["partial_write_possible"]


def test_a_changed_schema_stops_a_load(session):
    from millrace.operators.load import schema_differences
    from millrace.plans.output import POLICIES, check_options, plan_output

    df = session.spark.range(1).selectExpr("id", "'x' as name")
    plan = plan_output(df, "o", "a", "b", "append_existing", check_options(None, POLICIES))
    assert schema_differences(df, plan) == [] and len(schema_differences(df.selectExpr("cast(id as int) as id", "name"), plan)) == 1
    assert len(schema_differences(session.spark.range(1).selectExpr(*[f"id as c{i}" for i in range(40)]), plan)) <= 16


def test_replay_of_explicit_caches():
    a = {"base": Alias("base", ["orders"], order=1), "lost": Alias("lost", ["base"], False, 2)}
    assert kind(plan_cache, ["base"], [["lost"], ["base"]], a) == "not_replayable"
    assert kind(plan_cache, ["base"], [["base"], ["base"]], a, [True, False]) == "not_replayable"
    assert plan_cache(["base"], [["base"], ["base"]], a, [True, True]).selected == ["base"]


def test_qualify():
    from millrace.functions.dialect import qualify

    assert qualify("select a from t qualify x = 1 order by a") == "SELECT * EXCEPT (__qualifies) FROM (SELECT a, (x = 1) AS __qualifies from t) WHERE __qualifies order by a"
    assert qualify("select distinct f(a, (select 1 from u)) as b from t where c in (1) qualify 'qualify' <> b") == "SELECT DISTINCT * EXCEPT (__qualifies) FROM (SELECT f(a, (select 1 from u)) as b, ('qualify' <> b) AS __qualifies from t where c in (1)) WHERE __qualifies "
    assert qualify("select 1 -- qualify") == "select 1 -- qualify"
    assert kind(qualify, "qualify x") == "parse_error"


def test_division(session):
    assert session.table_from_sql("select 7 / 2 as a, 7.0D / 2 as b, (id + 8) / 4 as c from orders where id = 1").df.first()[:] == (3, 3.5, 2)
    exact = Session(session.spark, integer_division="fraction")
    assert exact.table_from_sql("select 7 / 2 as a").df.first().a == 3.5
    assert kind(Session, session.spark, scan_options={"other": 1}) == "unknown_option" and kind(Session, session.spark, integer_division="x") == "invalid_option"


def test_logging(session, caplog, monkeypatch):
    from millrace import logs

    logs.init_logging("debug")
    seen = []
    s = Session(session.spark, progress=seen.append)
    s.register("x", s.spark.range(3))
    s.write_all([s.table_from_sql("select id from x").to_target("a", "b")], stream_only=True)
    assert [r.getMessage() for r in caplog.records if r.name == "millrace"] == ["write_all output started", "write_all output finished"] and len(seen) == 2
    monkeypatch.setenv(logs.VARIABLE, "error")
    assert logs.init_logging("debug") and not logs.init_logging("info")
    with pytest.raises(ValueError):
        logs.event("other", "output", "started")


def test_object_store_settings():
    env = {"AWS_REGION": "e", "AWS_ACCESS_KEY_ID": "k", "OTHER": "1"}
    assert object_store("s3://b/p", {"region": "own"}, env) == {"fs.s3a.bucket.b.access.key": "k", "fs.s3a.bucket.b.endpoint.region": "own"} and object_store("/tmp/x", {}, env) == {}
    assert auth_mode({"AWS_ACCESS_KEY_ID": "a", "aws_secret_access_key": "b"}) == "static" and auth_mode({}) == "implicit"


def test_hand_off(spark):
    assert hand_off(spark.range(1000).repartition(3), lambda b: None)["rows_out"] == 1000
