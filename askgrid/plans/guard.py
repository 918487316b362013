"""Only queries get through: a check of the parsed statement's nodes, not of its text."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from askgrid.plans.tree import Node, parse

#: What the parser makes of statements that are not queries.
WRITES = ("plans.logical.Command", "plans.logical.ParsedStatement")


#: String literals, comments and names in backticks stay; what is in double quotes is a name.
_TOKENS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|"((?:[^"]|"")*)\"""", re.S)


class NotAQuery(ValueError):
    """The statement is not a single read-only query."""


def with_names(sql: str) -> str:
    """Names in double quotes as names in backticks, whatever the session takes double quotes for."""
    return _TOKENS.sub(lambda m: m[0] if m[1] is None else "`" + m[1].replace('""', '"').replace("`", "``") + "`", sql)


def checked(spark: SparkSession, sql: str) -> tuple[str, Node]:
    """The statement without a closing semicolon, names in backticks, and its parsed form; several statements or a write raise NotAQuery."""
    sql = with_names(sql.strip())
    while sql.endswith(";"):
        sql = sql[:-1].rstrip()
    try:
        root = parse(spark, sql)
    except ParseException as e:
        raise NotAQuery(str(e).splitlines()[0]) from e
    for plan in root.plans():
        if any(plan.is_a(spark, name) for name in WRITES):
            raise NotAQuery(f"{plan.kind} is not a query")
    return sql, root


def is_query(spark: SparkSession, sql: str) -> bool:
    try:
        checked(spark, sql)
    except NotAQuery:
        return False
    return True
