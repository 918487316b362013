"""Spark's own SQL parser, seen from Python: nodes with their place in the source text.

The one module that talks to the parser's objects; it needs a classic session, not Spark Connect.
Offsets are code points, so they index Python strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


class Node:
    """A plan or an expression."""

    def __init__(self, j):
        self.j = j
        self.kind = j.getClass().getSimpleName()

    def _seq(self, seq) -> list[Node]:
        return [Node(seq.apply(i)) for i in range(seq.size())]

    @property
    def children(self) -> list[Node]:
        return self._seq(self.j.children())

    @property
    def expressions(self) -> list[Node]:
        return self._seq(self.j.expressions()) if self.is_plan else []

    @property
    def is_plan(self) -> bool:
        return SparkContext._active_spark_context._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.QueryPlan").isInstance(self.j)

    @property
    def span(self) -> tuple[int, int] | None:
        origin = self.j.origin()
        start, stop = origin.startIndex(), origin.stopIndex()
        return (start.get(), stop.get() + 1) if start.isDefined() and stop.isDefined() else None

    @property
    def sql(self) -> str:
        return self.j.sql()

    @property
    def subquery(self) -> Node | None:
        """The plan inside a subquery expression."""
        return Node(self.j.plan()) if self.kind in ("ListQuery", "Exists", "ScalarSubquery") else None

    @property
    def name_parts(self) -> list[str]:
        parts = self.j.multipartIdentifier() if self.kind == "UnresolvedRelation" else self.j.nameParts()
        return [parts.apply(i) for i in range(parts.size())]

    @property
    def common_tables(self) -> list[tuple[str, Node]]:
        """Names and plans of a WITH clause."""
        if self.kind != "UnresolvedWith":
            return []
        found = self.j.cteRelations()
        return [(found.apply(i)._1(), Node(found.apply(i)._2())) for i in range(found.size())]

    def is_a(self, spark: SparkSession, name: str) -> bool:
        return spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}").isInstance(self.j)

    @property
    def text(self) -> str | None:
        """The value of a string literal."""
        if self.kind != "Literal" or self.j.dataType().simpleString() != "string" or self.j.value() is None:
            return None
        return self.j.value().toString()

    def walk(self) -> Iterator[Node]:
        """This node and all below it, subqueries and common tables too."""
        yield self
        below = [*self.children, *self.expressions, *(p for _, p in self.common_tables)]
        for x in [*below, *([self.subquery] if self.subquery else [])]:
            yield from x.walk()

    def plans(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.is_plan)

    def expression_nodes(self) -> Iterator[Node]:
        """Expressions of this plan node alone, outside of subqueries."""
        todo = self.expressions
        while todo:
            n = todo.pop(0)
            yield n
            todo = n.children + todo if n.subquery is None else todo


def blanked(sql: str) -> str:
    """The text with spaces for literals, quoted names and comments."""
    return _LITERAL.sub(lambda m: " " * len(m[0]), sql)


def extent(node: Node, sql: str) -> tuple[int, int] | None:
    """Where an expression with all its parts stands in the text, with the parentheses that belong to them.

    The parser's own place of a predicate begins at its keyword, and leaves parentheses out.
    """
    spans = [n.span for n in node.walk() if n.span]
    if not spans:
        return None
    start, stop = min(a for a, _ in spans), max(b for _, b in spans)
    while True:
        depth = least = 0
        for x in blanked(sql[start:stop]):
            depth += (x == "(") - (x == ")")
            least = min(least, depth)
        if least < 0:  # a closing one too many
            start = sql.rindex("(", 0, start)
        elif depth > 0:
            stop = sql.index(")", stop) + 1
        else:
            return start, stop


_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def parse(spark: SparkSession, sql: str) -> Node:
    """The parsed statement, names not resolved yet."""
    return Node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def frame(spark: SparkSession, plan: Node) -> DataFrame:
    """A DataFrame of a parsed plan, the FROM clause of a query for example."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.j), spark)


def relations(plan: Node) -> dict[str, str | None]:
    """Table by name or alias, in the scope that ``plan`` selects from; derived tables have none."""
    if plan.kind == "UnresolvedRelation":
        return {plan.name_parts[-1]: plan.name_parts[-1]}
    if plan.kind == "SubqueryAlias":
        below, alias = plan.children[0], plan.j.identifier().name()
        return {alias: below.name_parts[-1] if below.kind == "UnresolvedRelation" else None}
    out: dict[str, str | None] = {}
    for child in plan.children:
        out |= relations(child)
    return out


def scopes(root: Node) -> Iterator[tuple[Node, dict[str, str | None]]]:
    """Every plan node with expressions and the tables that its columns can be of, outer ones included."""

    def visit(plan: Node, outer: dict[str, str | None], hidden: frozenset[str]) -> Iterator[tuple[Node, dict[str, str | None]]]:
        hidden = hidden | {name.lower() for name, _ in plan.common_tables}
        for _, own in plan.common_tables:
            yield from visit(own, outer, hidden)
        here = {a: None if t is None or t.lower() in hidden else t for a, t in relations(plan).items()}
        if plan.expressions:
            yield plan, {**outer, **here}
        for n in plan.expression_nodes():
            if n.subquery is not None:
                yield from visit(n.subquery, {**outer, **here}, hidden)
        for child in plan.children:
            yield from visit(child, outer, hidden)

    return visit(root, {}, frozenset())


def resolve(name: list[str], tables: dict[str, str | None], schema: dict[str, dict[str, str]]) -> tuple[str, str] | None:
    """(table, column) that a name means: by its qualifier, or the one table that has it; None where that is unclear."""
    columns = {t.lower(): {c.lower(): c for c in cs} for t, cs in schema.items()}
    real = {t.lower(): t for t in schema}
    column = name[-1].lower()
    if len(name) > 1:
        table = next((t for a, t in tables.items() if a.lower() == name[-2].lower()), None)
        found = {table.lower()} if table and column in columns.get(table.lower(), {}) else set()
    elif None in tables.values():
        found = set()
    else:
        found = {t.lower() for t in tables.values() if column in columns.get(t.lower(), {})}
    if len(found) != 1:
        return None
    table = found.pop()
    return real[table], columns[table][column]
