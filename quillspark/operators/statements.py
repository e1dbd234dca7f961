"""Statements that a model has written: which may run, judged by what Spark's parser makes of them, and what they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_sql

EMPTY, NOT_A_QUERY = "SQL query is empty", "Only SELECT statements are allowed"
#: Nodes of parsed queries that only read; a statement with any other node is refused.
READS = frozenset(
    """Aggregate AsOfJoin CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit Intersect Join
    LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Range RelationTimeTravel Sample Sort SubqueryAlias
    Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrderBy UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot UnpivotTransformed Window WithCTE WithWindowDefinition""".split()
)


def problem(spark: SparkSession, sql: str | None) -> str | None:
    """Why a statement is refused; null if it is one query.

    The parsed plan is walked with all its parts, common table expressions and subqueries of expressions among them, and
    refused if any of these does more than read. So words in strings, names and comments don't count, a query that begins
    with WITH or a comment is one, and what can't be parsed, or is more than one statement, is refused.
    """
    if not (sql or "").strip():
        return EMPTY
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as error:  # the parser's own, and errors of the gateway around it
        return f"Not a statement: {str(error).strip().splitlines()[0][:120]}"
    return next((f"{NOT_A_QUERY}: {name}" for name in _kinds(plan) if name not in READS), None)


def _kinds(plan) -> list[str]:
    """Names of the plan's nodes, those inside expressions and common table expressions too."""
    names, todo = [], [plan]
    while todo:
        node = todo.pop()
        names.append(node.getClass().getSimpleName())
        inner = [node.children(), node.innerChildren(), node.subqueries()]
        todo += [x.apply(i) for x in inner for i in range(x.size())]
    return names


def answers(spark: SparkSession, said: DataFrame, key: str, text: str, most: int = 1_000) -> DataFrame:
    """(key, sql, problem, answer): the statement in each answer of a model, why it is refused, or the first row of what it gives, as JSON.

    Statements are run one by one, as a model is asked one by one: more than ``most`` rows fail, none is left out.
    """
    found = said.select(key, extract_sql(F.col(text)).alias("sql")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} statements at once")
    schema = f"{key} {said.schema[key].dataType.simpleString()}, sql string, problem string, answer string"
    judged = [(r[key], r["sql"], problem(spark, r["sql"])) for r in found]
    out = spark.createDataFrame([(k, sql, why, None) for k, sql, why in judged if why], schema)
    for k, sql, why in judged:
        if why is None:
            first = spark.sql(sql.strip().rstrip(";")).limit(1)
            row = first.select(F.to_json(F.struct("*")).alias("answer"))
            out = out.unionByName(row.select(F.lit(k).cast(said.schema[key].dataType).alias(key), F.lit(sql).alias("sql"), F.lit(None).cast("string").alias("problem"), "answer"))
    return out
