"""Questions on an uploaded table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType

VIEW = "uploaded_data"
ROWS_SHOWN = 20

# Functions that call into the JVM or read outside the table.
_BARRED = {"reflect", "java_method", "try_reflect", "input_file_name", "read_files"}


# Operators of a parsed query; every other one writes, shows or configures something.
_OPERATORS = {
    "UnresolvedRelation", "UnresolvedWith", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "OneRowRelation",
    "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Project", "Filter", "UnresolvedHaving",
    "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join",
    "LateralJoin", "AsOfJoin", "Generate", "WithWindowDefinition", "Window", "Pivot", "Unpivot", "Sample", "Expand", "LocalRelation",
}


def bare_sql(text: str) -> str:
    """Statement without Markdown code fences."""
    return text.replace("```sql", "").replace("```", "").strip().rstrip(";").strip()


def _nodes(plan) -> Iterator:
    """All nodes of a parsed plan: operators, expressions, subqueries and named queries."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        groups = [node.children(), node.innerChildren()]
        if any(m.getName() == "expressions" for m in node.getClass().getMethods()):
            groups.append(node.expressions())
        for group in groups:
            waiting += [group.apply(i) for i in range(group.size())]


def check_read_only(spark: SparkSession, statement: str) -> None:
    """Raise unless the parsed statement is a query over the uploaded view alone.

    Looks at the plan and not at words, so a column may be called ``load`` and
    a text may say ``drop``. Named queries of the statement may be read too.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    operator = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    relations, names, allowed = [], [], {VIEW}
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if operator.isInstance(node) and kind not in _OPERATORS:
            raise ValueError("only SELECT statements are allowed")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            relations.append([parts.apply(i) for i in range(parts.size())])
        elif kind == "UnresolvedWith":
            named = node.cteRelations()
            allowed |= {named.apply(i)._1().lower() for i in range(named.size())}
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            names.append(parts.apply(parts.size() - 1).lower())
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise ValueError(f"unknown table: {'.'.join(parts)}")
    for name in names:
        if name in _BARRED:
            raise ValueError(f"function not allowed: {name}")


def ask_sql(spark: SparkSession, sql: str, n: int = ROWS_SHOWN) -> tuple[DataFrame, list[str]]:
    """Run a read-only statement on the uploaded view; returns its first ``n`` rows and its column names."""
    statement = bare_sql(sql)
    check_read_only(spark, statement)
    result = spark.sql(statement)
    return result.limit(n), result.columns


def summarise(df: DataFrame) -> tuple[int, list[str]]:
    """Row count and column names."""
    return df.count(), df.columns


def chart_frame(df: DataFrame) -> DataFrame | None:
    """First non-numeric against first numeric column; None when there is nothing to plot."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    labels = [f.name for f in df.schema.fields if f.name not in numeric]
    if len(df.columns) < 2 or not numeric or not labels:
        return None
    return df.select(labels[0], numeric[0])
