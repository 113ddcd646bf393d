"""Which ad-hoc SELECTs may run: an allow-list over the parsed plan.

Everything a statement holds must be known to be harmless: the kinds of plan nodes, the relations (published views, or names
of its own WITH clauses where these can be seen) and the functions (Spark's own, by their documented groups). What is not on
the lists is refused, so new syntax is refused until somebody has looked at it. The text itself is never searched, so
literals may say anything, and no session setting is changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Kinds of nodes of a parsed query that only read and compute.
NODES = frozenset((
    "Aggregate", "AsOfJoin", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "ResolvedInlineTable", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "Window", "WithWindowDefinition",
))
# Documented groups of functions that depend on nothing but their arguments.
GROUPS = frozenset((
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
))
EXPRESSIONS = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis.")
# Expressions that name things at run time or reach outside the plan.
REFUSED_EXPRESSIONS = frozenset((
    "CallMethodViaReflection", "ExpressionWithUnresolvedIdentifier", "Invoke", "InvokeLike", "NewInstance", "PythonUDF", "ScalaUDF", "StaticInvoke",
))

_published: dict[str, set[str]] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def publish(name: str, view: DataFrame) -> None:
    """Registers a view that ad-hoc SELECTs may read. Other temporary views of the session stay out of their reach."""
    view.createOrReplaceTempView(name)
    _published.setdefault(_session(view.sparkSession), set()).add(name.lower())


def published(spark: SparkSession) -> set[str]:
    return set(_published.get(_session(spark), ()))


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


class _Walk:
    def __init__(self, spark: SparkSession):
        self.spark, self.functions = spark, spark._jsparkSession.sessionState().functionRegistry()
        self.faults: list[str] = []

    def plan(self, node, names: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for item in _items(node.cteRelations()):
                alias = item._1().lower()
                self.plan(item._2(), names | {alias} if node.allowRecursion() else names)
                names = names | {alias}
        elif kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in names:
                self.faults.append("relation " + ".".join(parts))
        elif kind not in NODES:
            self.faults.append(f"node {kind}")
            return
        for expression in _items(node.expressions()):
            self.expression(expression, names)
        for child in _items(node.children()):
            self.plan(child, names)

    def expression(self, e, names: frozenset[str]) -> None:
        name = e.getClass().getName()
        kind = name.rsplit(".", 1)[-1]
        if not name.startswith(EXPRESSIONS) or kind in REFUSED_EXPRESSIONS:
            self.faults.append(f"expression {kind}")
            return
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            self.function(e, kind)
        if _holds_plan(e):
            self.plan(e.plan(), names)
        for child in _items(e.children()):
            self.expression(child, names)

    def function(self, e, kind: str) -> None:
        parts = list(_items(e.nameParts())) if kind == "UnresolvedFunction" else [e.name().funcName()]
        known = None
        if len(parts) == 1:
            named = self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0])
            known = self.functions.lookupFunction(named)
        if known is None or known.isEmpty():
            self.faults.append("function " + ".".join(parts))
            return
        info = known.get()
        if info.getGroup() not in GROUPS or not info.getClassName().startswith(EXPRESSIONS[0]):
            self.faults.append(f"function {parts[0]}")


def _holds_plan(expression) -> bool:
    """Whether an expression is a subquery of any kind."""
    cls = expression.getClass()
    while cls is not None:
        if cls.getSimpleName() == "PlanExpression":
            return True
        cls = cls.getSuperclass()
    return False


def faults(spark: SparkSession, query: str, views: Iterable[str] | None = None) -> list[str]:
    """What in a statement is not allowed; empty if it may run. Text that does not parse raises Spark's ParseException.
    ``views``: names it may read, the published ones by default."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    walk = _Walk(spark)
    walk.plan(plan, frozenset(v.lower() for v in (published(spark) if views is None else views)))
    return walk.faults
