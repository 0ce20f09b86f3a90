"""Free read-only statements over a graph: SQL with bound parameters, judged by its parsed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellisgraph.graph import Graph

#: Plan nodes of queries; a statement with any other node does not run.
READS = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "OneRowRelation", "LocalRelation", "Generate", "WithWindowDefinition", "Window", "Expand", "Sample", "Pivot", "Unpivot",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedInlineTable", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedHint",
}
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack")
_CALLS = ("reflect", "java_method", "try_reflect")


class NotReadOnly(ValueError):
    """A statement that writes, changes the session, or reads more than the graph."""


def _walk(plan):
    """A plan's nodes, with those of named subqueries and of subqueries inside expressions."""
    yield plan
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for i in range(group.size()):
            yield from _walk(group.apply(i))


def problem(spark: SparkSession, statement: str) -> str | None:
    """Why a statement may not run, or null. It is parsed, not run; words in names or texts do not matter."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    seen, known = list(_walk(plan)), {"nodes", "edges"}
    for p in seen:
        if p.getClass().getSimpleName() == "UnresolvedWith":
            known |= {p.cteRelations().apply(i)._1().lower() for i in range(p.cteRelations().size())}
    for p in seen:
        name = p.getClass().getSimpleName()
        if name not in READS:
            return f"statement does more than read: {name}"
        if name == "UnresolvedRelation" and (p.multipartIdentifier().size() > 1 or p.multipartIdentifier().head().lower() not in known):
            return "only nodes and edges can be read: " + p.multipartIdentifier().mkString(".")
        if name == "UnresolvedTableValuedFunction" and p.name().mkString(".").lower() not in TABLE_FUNCTIONS:
            return "table function: " + p.name().mkString(".")
    text = plan.toString().lower()
    if any(f"'{c}(" in text for c in _CALLS):
        return "calls into the virtual machine"
    return None


def read_only(g: Graph, statement: str, parameters: dict | None = None) -> DataFrame:
    """The rows of a statement over the views ``nodes`` and ``edges``; ``:name`` takes a bound parameter.

    Raises NotReadOnly for anything but a query over these two. The views are gone afterwards; what they hid is back.
    """
    spark = g.nodes.sparkSession
    why = problem(spark, statement)
    if why:
        raise NotReadOnly(why)
    views = {"nodes": g.nodes, "edges": g.edges}
    hidden = {name: spark.table(name) for name in views if any(t.name == name and t.isTemporary for t in spark.catalog.listTables())}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(statement, args=parameters or {})
    finally:
        for name in views:
            if name in hidden:
                hidden[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
