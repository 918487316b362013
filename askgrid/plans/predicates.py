"""The literals that a query compares text columns with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.plans.rewrite import Schema, _is_text
from askgrid.plans.tree import parse, resolve, scopes

COLUMNS = "table_name string, column_name string, value string, operator string"
_NAMES = {"EqualTo": "eq", "EqualNullSafe": "eq", "Like": "like", "ILike": "ilike"}


def predicate_values(spark: SparkSession, sql: str, schema: Schema) -> DataFrame:
    """(table_name, column_name, value, operator), operators eq, neq, like, ilike, not_like, not_ilike, in and not_in; BETWEEN is no text predicate."""
    rows: list[tuple[str, str, str, str]] = []
    for plan, tables in scopes(parse(spark, sql)):
        negated = {n.children[0].j.hashCode(): n for n in plan.expression_nodes() if n.kind == "Not"}
        for n in plan.expression_nodes():
            sides, no = n.children, n.kind in (*_NAMES, "In") and n.j.hashCode() in negated
            if n.kind in _NAMES:
                pairs = [(sides[0], [sides[1]])] + ([(sides[1], [sides[0]])] if n.kind.startswith("Equal") else [])
                operator = {"eq": "neq"}.get(_NAMES[n.kind], f"not_{_NAMES[n.kind]}") if no else _NAMES[n.kind]
            elif n.kind == "In":
                pairs, operator = [(sides[0], sides[1:])], "not_in" if no else "in"
            else:
                continue
            for column, values in pairs:
                if _is_text(column, tables, schema):
                    table, name = resolve(column.name_parts, tables, schema)
                    rows += [(table, name, v.text, operator) for v in values if v.text is not None]
    return spark.createDataFrame(list(dict.fromkeys(rows)), COLUMNS)


def unsupported(predicates: DataFrame, similar: DataFrame) -> DataFrame:
    """Predicate values that are not among the similar values (table_name, column_name, value) found for them."""
    known = similar.select("table_name", "column_name", F.lower("value").alias("_v"))
    return predicates.withColumn("_v", F.lower("value")).join(known, ["table_name", "column_name", "_v"], "left_anti").drop("_v")
