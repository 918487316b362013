"""Relaxing an over-constrained query: the largest set of its constraints that has rows.

A filtered projection is relaxed in one scan. Its condition is a tree of AND and OR over constraints;
all of them are evaluated as bits, and the rows' bits are counted. How much of the condition a row
keeps is a number too: what its parts keep added up for AND, the most of them for OR. The row that
keeps most tells the branch and the constraints, however many of either there are.

Other queries (with GROUP BY, HAVING, DISTINCT, WITH, UNION, filters in subqueries, or tables joined
by their filter) have no row that shows what a constraint does to their result. Every WHERE of every
scope gives its conjuncts, and ``lattice`` searches for the fewest to drop by conflicts. Where a
query's rows needn't grow with what is dropped (HAVING, NOT IN, EXCEPT, scalar subqueries),
a failed probe tells of no other set, and after ``MOST_PROBES`` of them TooManySubsets tells the
caller so.

What is relaxed is always the query's own text with constraints cut out, so that its order, limit,
windows and names stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.plans.guard import checked
from askgrid.plans.lattice import fewest_dropped, join_sides, top_conjuncts
from askgrid.plans.masks import bit, has_bit, holding, masks
from askgrid.plans.rewrite import splice
from askgrid.plans.tree import Node, blanked, extent, frame, relations
from askgrid.sources.staging import forget, written

__all__ = ["DEFAULT_ROWS", "Relaxed", "TooManySubsets", "condition", "constraints", "masks", "profile", "relax"]

DEFAULT_ROWS = 15
#: Queries that a search may run where no probe rules out another.
MOST_PROBES = 200

#: A constraint's text, or ("and" | "or", parts).
Condition = str | tuple[str, list]


class TooManySubsets(ValueError):
    """No subset was found within the bounds."""


@dataclass
class Relaxed:
    """``probes`` is the number of queries that were run, scans for masks not counted."""

    kept: list[str]
    dropped: list[str]
    count: int
    rows: DataFrame
    probes: int = 0


def _parts(n: Node, kind: str) -> list[Node]:
    return [x for c in n.children for x in _parts(c, kind)] if n.kind == kind else [n]


def _places(n: Node, sql: str) -> list[tuple[tuple[int, int], list[Node]]]:
    """Parts of an AND or OR with their places; what the parser makes two comparisons of, such as BETWEEN, is one part."""
    out: list[tuple[tuple[int, int], list[Node]]] = []
    for x in _parts(n, n.kind):
        start, stop = extent(x, sql)
        if out and out[-1][0][0] == start:
            out[-1] = ((start, max(stop, out[-1][0][1])), [*out[-1][1], x])
        else:
            out.append(((start, stop), [x]))
    return out


def condition(n: Node, sql: str, negated: bool = False) -> Condition:
    """AND and OR over constraints, NOT moved down to them."""

    def constraint(place: tuple[int, int]) -> str:
        text = sql[slice(*place)].strip()
        while text.startswith("(") and text.endswith(")") and _one_group(text):
            text = text[1:-1].strip()
        return f"(NOT ({text}))" if negated else f"({text})"

    if n.kind == "Not" and (n.children[0].kind == "Not" or n.children[0].kind in ("And", "Or") and len(_places(n.children[0], sql)) > 1):
        return condition(n.children[0], sql, not negated)
    places = _places(n, sql) if n.kind in ("And", "Or") else [(extent(n, sql), [n])]
    if len(places) == 1:
        return constraint(places[0][0])
    kind, parts = "or" if (n.kind == "Or") != negated else "and", []
    for place, own in places:
        part = condition(own[0], sql, negated) if len(own) == 1 else constraint(place)
        parts += part[1] if isinstance(part, tuple) and part[0] == kind else [part]
    return kind, parts


def _one_group(text: str) -> bool:
    """Whether the parentheses that begin and end a text belong together."""
    depth = 0
    for k, x in enumerate(blanked(text)):
        depth += (x == "(") - (x == ")")
        if depth == 0 and k < len(text) - 1:
            return False
    return True


def _leaves(c: Condition) -> list[str]:
    """The constraints, each once, in order."""
    return list(dict.fromkeys([c] if isinstance(c, str) else [x for part in c[1] for x in _leaves(part)]))


def _kept(c: Condition, at: dict[str, int]) -> Column:
    """How many constraints of the best branch a row of masks keeps."""
    if isinstance(c, str):
        return bit(at[c])
    parts = [_kept(x, at) for x in c[1]]
    if c[0] == "or":
        return F.greatest(*parts)
    return sum(parts[1:], parts[0])


def _whole(c: Condition, at: dict[str, int]) -> Column:
    """Whether a row of masks satisfies the condition, as 0 or 1."""
    if isinstance(c, str):
        return bit(at[c])
    return (F.greatest if c[0] == "or" else F.least)(*[_whole(x, at) for x in c[1]])


def _branch(c: Condition, has: set[str]) -> list[str]:
    """The constraints of the branch that keeps most, the first of equals."""
    if isinstance(c, str):
        return [c]
    parts = [_branch(x, has) for x in c[1]]
    if c[0] == "or":
        return max(parts, key=lambda p: sum(x in has for x in p))
    return list(dict.fromkeys(x for p in parts for x in p))


def constraints(sql: str, root: Node, usable: set[str] | None = None) -> list[tuple[int, int]]:
    """Places of the conjuncts of every WHERE, in all scopes, in order; of scopes with a usable table alone, where those are named."""
    places = set()
    for plan in root.plans():
        if plan.kind != "Filter":
            continue
        tables = {t.lower() for t in relations(plan.children[0]).values() if t}
        if usable is None or tables & {t.lower() for t in usable}:
            places |= {p for n in top_conjuncts(plan.expressions[0]) if (p := extent(n, sql))}
    out: list[tuple[int, int]] = []
    for start, stop in sorted(places):  # what the parser makes two comparisons of, such as BETWEEN, is one constraint
        if out and start == out[-1][0]:
            out[-1] = (start, max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _limited(root: Node) -> bool:
    while root.kind in ("UnresolvedWith", "WithWindowDefinition", "Sort") and root.children:
        root = root.children[0]
    return root.kind in ("GlobalLimit", "LocalLimit")


def _shown(spark: SparkSession, sql: str, root: Node, max_rows: int) -> DataFrame:
    """The rows of a query; its own limit overrides ``max_rows``."""
    rows = spark.sql(sql)
    return rows if _limited(root) else rows.limit(max_rows)


def _by_lattice(spark: SparkSession, sql: str, root: Node, max_rows: int, usable: set[str] | None) -> Relaxed | None:
    """The constraints of all scopes, the fewest dropped; a dropped one becomes true."""
    places = constraints(sql, root, usable)
    texts = [sql[a:b] for a, b in places]
    inside = lambda a, b: places[b][0] <= places[a][0] and places[a][1] <= places[b][1]
    holds = lambda k: sum(inside(j, k) for j in range(len(places)))
    order = sorted(range(len(places)), key=lambda k: (holds(k), k))  # a constraint with others inside goes after them

    def without(gone: frozenset[int]) -> str:
        return splice(sql, {(*places[k], "true") for k in gone})

    def give_up(probes: int) -> None:
        if probes > MOST_PROBES:
            raise TooManySubsets(f"no rows in {MOST_PROBES} subsets of {len(places)} constraints")

    gone, probes = fewest_dropped(spark, root, sql, places, order, inside, lambda g: not spark.sql(without(g)).limit(1).isEmpty(), give_up)
    if not gone:
        return None
    relaxed = without(gone)
    return Relaxed([t for k, t in enumerate(texts) if k not in gone], [texts[k] for k in sorted(gone)], spark.sql(relaxed).count(), _shown(spark, relaxed, root, max_rows), probes)


def _filtered_projection(root: Node) -> Node | None:
    """The filter of a projection of joined tables; None of any other query."""
    node = root
    while node.kind in ("GlobalLimit", "LocalLimit", "Sort", "WithWindowDefinition"):
        node = node.children[0]
    if node.kind != "Project" or node.children[0].kind != "Filter":
        return None
    where = node.children[0]
    if any(x.subquery is not None for e in where.expressions for x in e.walk()) or any(p.kind == "Filter" for p in where.children[0].plans()):
        return None
    joins = [p for p in where.children[0].plans() if p.kind == "Join"]
    return None if any(not p.expressions and join_sides(p)[0] in ("Inner", "Cross") for p in joins) else where


def relax(spark: SparkSession, sql: str, max_rows: int = DEFAULT_ROWS, usable: set[str] | None = None) -> Relaxed | None:
    """The query with as many of its constraints as have rows; None if it has rows, or no subset has any.

    Of a filtered projection the branch that keeps most is relaxed (of rows that keep as many, the one
    with the first constraints in order), and its limit overrides ``max_rows``; constraints of scopes
    without a ``usable`` table are never dropped.
    """
    sql, root = checked(spark, sql)
    where = _filtered_projection(root)
    place = where and extent(where.expressions[0], sql)
    if where is None or place is None:
        return _by_lattice(spark, sql, root, max_rows, usable)
    if usable is not None and not constraints(sql, root, usable):
        return None
    tree = condition(where.expressions[0], sql)
    every = _leaves(tree)
    at = {c: k for k, c in enumerate(every)}
    counts = written(masks(frame(spark, where.children[0]), every), "masks")
    # One row of each set of constraints that occurs: the scan of the table is done.
    first = [F.desc(bit(k)) for k in range(len(every))]
    best = counts.select("*", _kept(tree, at).alias("kept"), _whole(tree, at).alias("whole")).orderBy(F.desc("whole"), F.desc("kept"), *first).limit(1).first()
    if best is None or best["whole"] or not best["kept"]:
        forget(counts)
        return None
    has = {c for c, k in at.items() if has_bit(best, k)}
    branch = _branch(tree, has)
    kept = [c for c in branch if c in has]
    count = holding(counts, [at[c] for c in kept]).agg(F.sum("n")).first()[0]
    forget(counts)
    return Relaxed(kept, [c for c in branch if c not in has], count, _shown(spark, splice(sql, {(*place, " AND ".join(kept))}), root, max_rows))


def profile(table: DataFrame, column: str) -> DataFrame:
    """What a dropped constraint's column holds: least and greatest number, or the five most frequent values (ties by value)."""
    kind = dict(table.dtypes)[column]
    own = F.col(f"`{column}`")
    if kind == "string":
        return table.where(own.isNotNull()).groupBy(own.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(5)
    return table.agg(F.min(own).alias("least"), F.max(own).alias("greatest"))
