"""The read-only SQL gate and the lineage of a query, both from Catalyst's unresolved plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from millrace.errors import MillraceError
from millrace.functions.dialect import operator_place, to_spark

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_REFUSED = ("Command", "ParsedStatement", "InsertIntoStatement", "InsertIntoDir", "ScriptTransformation")
#: Functions that call Java methods by name.
_CALLS = {"reflect", "java_method", "try_reflect"}


@dataclass
class Lineage:
    """Tables a query reads by their last name part, query-local names, and qualified names, which are never collapsed."""

    tables: list[str] = field(default_factory=list)
    local: list[str] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)
    incomplete: str | None = None


def _seq(x: JavaObject) -> Iterator[JavaObject]:
    it = x.iterator()
    while it.hasNext():
        yield it.next()


def _walk(spark: SparkSession, node: JavaObject) -> Iterator[JavaObject]:
    """The node, its children, its inner children and the plans of its subquery expressions."""
    yield node
    plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.QueryPlan")
    for child in _seq(node.children()):
        yield from _walk(spark, child)
    for inner in _seq(node.innerChildren()):
        if plan.isInstance(inner):
            yield from _walk(spark, inner)
    expression = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def subqueries(e: JavaObject) -> Iterator[JavaObject]:
        if expression.isInstance(e):
            yield from _walk(spark, e.plan())
        for c in _seq(e.children()):
            yield from subqueries(c)

    for e in _seq(node.expressions()):
        yield from subqueries(e)


def walk_with_parent(spark: SparkSession, node: JavaObject, above: JavaObject | None = None) -> Iterator[tuple[JavaObject, JavaObject | None]]:
    """Each node with its parent; subqueries stand under none."""
    yield node, above
    for child in _seq(node.children()):
        yield from walk_with_parent(spark, child, node)
    for e in _seq(node.subqueries()):
        yield from walk_with_parent(spark, e)


def parse(spark: SparkSession, sql: str) -> tuple[str, JavaObject]:
    """The query in Spark's dialect and its unresolved plan; refuses everything that is not one read-only query."""
    text = (sql or "").strip()
    if not text:
        raise MillraceError("validate_sql", "empty_sql", "the query is empty")
    text = to_spark(text.rstrip().removesuffix(";"))
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (PySparkException, Py4JJavaError) as e:
        said = next((x for x in str(e).split("\n") if x.strip()), "")
        raise MillraceError("validate_sql", "parse_error", said) from None
    classes = []
    for name in _REFUSED:
        try:
            classes.append(spark._jvm.java.lang.Class.forName(_LOGICAL + name))
        except Py4JJavaError:
            continue
    for node in _walk(spark, plan):
        if any(c.isInstance(node) for c in classes):
            raise MillraceError("validate_sql", "not_read_only", f"only queries are allowed, not {node.nodeName()}")
        for e in _seq(node.expressions()):
            for name in _functions(e):
                if name.lower() in _CALLS:
                    raise MillraceError("validate_sql", "not_allowed", f"the function {name} is not allowed")
    return text, plan


def _functions(e: JavaObject) -> Iterator[str]:
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        yield list(_seq(e.nameParts()))[-1]
    for c in _seq(e.children()):
        yield from _functions(c)


def check_tables(found: Lineage, known: set[str]) -> None:
    """Every table must be registered: files, other catalogs and views of the application are out of reach."""
    for name in [*found.unknown, *found.tables]:
        if name.lower() not in known:
            raise MillraceError("plan_sql", "unknown_table", f"no table {name} is registered")


def whole_division(spark: SparkSession, text: str, df: DataFrame) -> str:
    """The text with `/` between whole numbers as `div`: the analyzed plan tells their types and where each operator stands."""
    found = []
    for node in _walk(spark, df._jdf.queryExecution().analyzed()):
        todo = list(_seq(node.expressions()))
        while todo:
            e = todo.pop()
            todo += _seq(e.children())
            if e.getClass().getSimpleName() == "Divide" and all(_from_whole(x) for x in (e.left(), e.right())):
                at = e.origin()
                if at.sqlText().isDefined() and at.sqlText().get() == text and at.startIndex().isDefined() and at.stopIndex().isDefined():
                    found += operator_place(text, at.startIndex().get(), at.stopIndex().get() + 1)
    for place in sorted(set(found), reverse=True):
        text = f"{text[:place]} div {text[place + 1 :]}"
    return text


def _from_whole(e: JavaObject) -> bool:
    """Whether analysis has made a fraction of a whole number here."""
    whole = ("byte", "short", "integer", "long")
    return e.getClass().getSimpleName() == "Cast" and e.dataType().typeName() == "double" and e.child().dataType().typeName() in whole


def lineage(spark: SparkSession, plan: JavaObject) -> Lineage:
    """What the query reads. Names of common table expressions hide catalog names."""
    out = Lineage()
    try:
        local, relations = set(), []
        for node in _walk(spark, plan):
            kind = node.getClass().getSimpleName()
            if kind == "UnresolvedWith":
                for cte in _seq(node.cteRelations()):
                    local.add(cte._1().lower())
            elif kind == "UnresolvedRelation":
                relations.append([str(p) for p in _seq(node.multipartIdentifier())])
        out.local = sorted(local)
        for parts in relations:
            if len(parts) > 1:
                out.unknown.append(".".join(parts))
            elif parts[0].lower() not in local:
                out.tables.append(parts[0].lower())
        out.tables, out.unknown = sorted(set(out.tables)), sorted(set(out.unknown))
    except (PySparkException, Py4JJavaError) as e:  # lineage advises; it never fails a query
        out.incomplete = type(e).__name__
    return out
