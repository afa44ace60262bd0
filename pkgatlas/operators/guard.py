"""Run one analytical SELECT over named frames, and nothing else."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Groups of Spark's own functions a query may use. Not among them: ``misc_funcs``, which calls Java
# methods, names files and raises errors. Functions that are not Spark's own are in no group.
ALLOWED_GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "url_funcs", "window_funcs",
)
# Expressions of the language itself, and those that a listed function is resolved to under another name.
ALLOWED_EXPRESSIONS = (
    "Alias", "AttributeReference", "Literal", "OuterReference", "SortOrder", "Cast", "MultiAlias", "AggregateExpression",
    "ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery", "LambdaFunction", "NamedLambdaVariable",
    "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame", "UnboundedPreceding",
    "UnboundedFollowing", "CurrentRow", "GetStructField", "GetArrayItem", "GetMapValue", "GetArrayStructFields",
    "GroupingID", "Grouping", "CreateNamedStruct", "CreateArray", "CreateMap", "NamePlaceholder", "InSet", "Not",
    "Ceil", "Floor", "RoundCeil", "RoundFloor", "Explode", "PosExplode", "Inline", "GeneratorOuter", "Contains", "StartsWith",
    "EndsWith", "StringLPad", "StringRPad", "ToCharacter", "Mask", "Hour", "Minute", "Second", "SecondWithFraction", "DatePart",
    "MakeTimestamp", "ParseToTimestamp", "Average", "Sum", "Mode", "Percentile", "PercentileCont", "PercentileDisc", "DateAddInterval",
    "TimestampAddInterval", "TimestampAddYMInterval", "DateAddYMInterval", "SubtractTimestamps", "SubtractDates",
    "DatetimeSub", "PivotFirst",
)
# Plan nodes a query may be made of, besides the given frames.
ALLOWED_NODES = (
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate",
    "Union", "Intersect", "Except", "Window", "Generate", "Expand", "Pivot", "Unpivot", "Sample", "SubqueryAlias", "WithCTE",
    "CTERelationDef", "CTERelationRef", "OneRowRelation", "LocalRelation", "Range", "ResolvedHint",
)
#: Bytes a query may read by the optimiser's estimate, where the caller sets no other bound.
MAX_BYTES = 1 << 50


class GuardError(ValueError):
    """The statement is not an allowed query."""


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan) -> list:
    """All plan nodes, with those inside CTEs, views and subqueries."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(_listed(node.children()))
        todo.extend(_listed(node.innerChildren()))
        todo.extend(_listed(node.subqueries()))
    return found


def _expressions(node) -> list:
    """All expressions of a node; of a function that Spark writes as another one, what the query wrote."""
    found, todo = [], _listed(node.expressions())
    while todo:
        e = todo.pop()
        found.append(e)
        todo.extend(_listed(e.parameters() if hasattr(e, "parameters") and _inherits(e) else e.children()))
    return found


def _inherits(e) -> bool:
    return any(i.getSimpleName() == "InheritAnalysisRules" for i in e.getClass().getInterfaces())


def _kind(x) -> str:
    return x.getClass().getName().rsplit(".", 1)[-1].rstrip("$")


def _allowed_expressions(spark: SparkSession) -> frozenset[str]:
    """Class names of the allowed groups, from Spark's list of its own functions."""
    known = getattr(getattr(spark._jvm.org.apache.spark.sql.catalyst.analysis, "FunctionRegistry$"), "MODULE$").builtin()
    infos = [known.lookupFunction(name).get() for name in _listed(known.listFunction())]
    names = {i.getClassName().rsplit(".", 1)[-1] for i in infos if i.getGroup() in ALLOWED_GROUPS}
    # a class that a group outside the list has too is not allowed by its group
    return frozenset(names - {i.getClassName().rsplit(".", 1)[-1] for i in infos if i.getGroup() not in ALLOWED_GROUPS})


def check_select(spark: SparkSession, sql: str, tables: Mapping[str, object]) -> None:
    """Raises ``GuardError`` unless ``sql`` is one query. Parses only, and runs nothing:
    a second statement does not parse, and commands (INSERT, DROP, SET ...) are command nodes.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:
        raise GuardError(f"not a single SQL statement: {exc}") from exc
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    commands = [
        spark._jvm.Class.forName(logical + c) for c in ("Command", "ParsedStatement", "InsertIntoStatement")
    ]
    for node in _nodes(plan):
        if any(c.isInstance(node) for c in commands):
            raise GuardError(f"only queries are allowed, found {_kind(node)}")


def _check_analyzed(spark: SparkSession, analyzed, allowed: list) -> None:
    """Every leaf is part of a given frame, and every node and expression is of a listed kind.

    Names are resolved by now, so neither a nested name nor a long list can hide a table or a
    function: the objects themselves are looked at.
    """
    known = _allowed_expressions(spark)
    todo = [analyzed]
    while todo:
        node = todo.pop()
        if any(node.sameResult(frame) for frame in allowed):
            continue  # what the caller gave is the caller's own business
        kind = _kind(node)
        if kind not in ALLOWED_NODES:
            raise GuardError(f"reads or does something other than a query over the given tables: {kind}")
        for e in _expressions(node):
            if _kind(e) not in known and _kind(e) not in ALLOWED_EXPRESSIONS:
                raise GuardError(f"function not allowed: {_kind(e)}")
        todo.extend([*_listed(node.children()), *_listed(node.subqueries())])


def _estimate(plan) -> int:
    """Bytes that the leaves of an optimised plan read; a join without a key multiplies its sides.

    Leaves whose size Spark does not know (rows of the driver's, for one) count nothing.
    """
    inner = [_estimate(child) for child in [*_listed(plan.children()), *_listed(plan.subqueries())]]
    if not inner:
        size = int(str(plan.stats().sizeInBytes()))
        return 0 if size == plan.conf().defaultSizeInBytes() else size
    if _kind(plan) == "Join" and not _has_key(plan):
        return max(1, inner[0]) * max(1, inner[1]) + sum(inner[2:])
    return sum(inner)


def _has_key(join) -> bool:
    """Whether a conjunct of the condition equates something of the one side with something of the other."""
    todo = [join.condition().get()] if join.condition().isDefined() else []
    while todo:
        e = todo.pop()
        if _kind(e) == "And":
            todo.extend(_listed(e.children()))
        elif _kind(e) in ("EqualTo", "EqualNullSafe"):
            a, b = (x.references() for x in _listed(e.children()))
            left, right = join.left().outputSet(), join.right().outputSet()
            if a.nonEmpty() and b.nonEmpty() and (
                (a.subsetOf(left) and b.subsetOf(right)) or (a.subsetOf(right) and b.subsetOf(left))
            ):
                return True
    return False


def guarded_select(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], max_rows: int | None = None, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The result of one SELECT over ``tables``; lazy, see ``run_guarded``.

    Tables are bound under private names, so no view of the session is touched; an unknown
    column or table fails. All rows are returned. With ``max_rows`` at most so many are, with
    a column ``truncated`` that says whether there were more. A query whose optimised plan reads
    more than ``max_bytes`` by Spark's estimate is refused before it runs.
    """
    check_select(spark, sql, tables)
    # the session's own views must not answer for a name: bind every table, read only these
    binding = ", ".join(f"`{t}` AS (SELECT * FROM {{{_slot(t)}}})" for t in tables)
    frames = {_slot(t): df for t, df in tables.items()}
    body = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    try:
        result = spark.sql(f"WITH {binding} SELECT * FROM ({body}\n)", **frames) if tables else spark.sql(sql)
    except PySparkException as exc:
        raise GuardError(str(exc)) from exc
    _check_analyzed(
        spark, result._jdf.queryExecution().analyzed(), [df._jdf.queryExecution().analyzed() for df in tables.values()]
    )
    size = _estimate(result._jdf.queryExecution().optimizedPlan())
    if size > max_bytes:
        raise GuardError(f"the query would read about {size} bytes, {max_bytes} are allowed")
    if max_rows is None:
        return result
    more = result.limit(max_rows + 1).agg(F.count("*")).scalar() > max_rows
    return result.limit(max_rows).withColumn("truncated", more)


def _slot(table: str) -> str:
    return "t_" + re.sub(r"\W", "_", table)


def run_guarded(
    spark: SparkSession,
    sql: str,
    tables: Mapping[str, DataFrame],
    max_rows: int | None = None,
    timeout_s: float = 30.0,
    max_bytes: int = MAX_BYTES,
) -> list[Row]:
    """Run ``guarded_select`` and return its rows; its jobs are cancelled after ``timeout_s``."""
    result = guarded_select(spark, sql, tables, max_rows, max_bytes)
    tag = f"guarded-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    fired = threading.Event()

    def cancel() -> None:
        fired.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, cancel)
    sc.addJobTag(tag)
    timer.start()
    try:
        return result.collect()
    except Exception as exc:
        if fired.is_set():
            raise TimeoutError(f"query stopped after {timeout_s} s") from exc
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
