"""Search of the subsets of a query's constraints, without running them one after the other.

A set of constraints that leaves no row is a *conflict*: whatever is kept, one of them has to go.
The search keeps the conflicts found so far and tries the smallest set that hits them all, first in
the order of the text. If that finds rows, nothing smaller can; if not, what was kept holds another
conflict, which is shrunk to a least one and joins the others. Forty constraints take some tens of
probes where subsets of them are a million million.

Scopes rule out subsets before any query is run: where rows of a base table have to pass a scope for
the result to have any, one grouped scan of the table counts which constraints its rows satisfy
together. What is kept must be among those of some row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from askgrid.plans.masks import holding, masks, whole_masks
from askgrid.plans.tree import Node, extent, frame, relations
from askgrid.sources.staging import forget, written

#: So many different sets of constraints of one table come to the driver; more stay a table and are asked by jobs.
MOST_MASKS = 4096

Places = list[tuple[int, int]]
#: Plan nodes that have rows only if what is below them has; and those that ask no more of a row than that it is there.
_THROUGH = {"Project", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Aggregate", "SubqueryAlias", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "WithWindowDefinition"}
_TRUE = {"Inner", "Cross", "LeftSemi"}


def join_sides(join: Node) -> tuple[str, list[Node]]:
    """The kind of a join, and the sides without which it has no rows."""
    kind = join.j.joinType().toString()
    left, right = join.children
    return kind, [left, right] if kind in _TRUE else [left] if kind in ("LeftOuter", "LeftAnti") else [right] if kind == "RightOuter" else []


def top_conjuncts(n: Node) -> list[Node]:
    return [x for c in n.children for x in top_conjuncts(c)] if n.kind == "And" else [n]


def _always_a_row(spark: SparkSession, plan: Node) -> bool:
    """Whether a select list aggregates everything into one row; unsure counts as yes."""
    if plan.kind == "Aggregate":
        return not plan.j.groupingExpressions().size()
    if plan.kind != "Project" or not any(x.kind == "UnresolvedFunction" for e in plan.expressions for x in e.walk()):
        return False
    try:
        top = Node(frame(spark, plan)._jdf.queryExecution().analyzed())
    except PySparkException:
        return True
    return top.kind == "Aggregate" and not top.j.groupingExpressions().size()


def needed_scopes(spark: SparkSession, plan: Node, sql: str, tables: dict[str, Node] | None = None, around: tuple[tuple[int, int], ...] = ()) -> Iterator[tuple[Node, dict[str, Node], tuple[tuple[int, int], ...]]]:
    """(filter, common tables, constraints around it): scopes without whose rows the result has none, unless one of those constraints goes."""
    tables = {**(tables or {}), **{name.lower(): own for name, own in plan.common_tables}}
    if plan.kind == "UnresolvedRelation":
        own = tables.get(plan.name_parts[-1].lower()) if len(plan.name_parts) == 1 else None
        if own is not None:
            yield from needed_scopes(spark, own, sql, {k: v for k, v in tables.items() if v is not own}, around)
    elif plan.kind == "Filter":
        yield plan, tables, around
        yield from needed_scopes(spark, plan.children[0], sql, tables, around)
        for n in top_conjuncts(plan.expressions[0]):
            inner = n.subquery if n.kind == "Exists" else next((q.subquery for q in n.children if n.kind == "InSubquery" and q.subquery), None)
            if inner is not None and (place := extent(n, sql)):
                yield from needed_scopes(spark, inner, sql, tables, (*around, place))
    elif plan.kind == "Join":
        for side in join_sides(plan)[1]:
            yield from needed_scopes(spark, side, sql, tables, around)
    elif plan.kind in ("Intersect", "Except"):
        for side in plan.children[: 1 if plan.kind == "Except" else 2]:
            yield from needed_scopes(spark, side, sql, tables, around)
    elif plan.kind in _THROUGH and not _always_a_row(spark, plan):
        yield from needed_scopes(spark, plan.children[0], sql, tables, around)


def keeps_growing(spark: SparkSession, plan: Node, tables: dict[str, Node] | None = None, tested: bool = False) -> bool:
    """Whether fewer constraints never mean fewer rows; False where that is unsure.

    ``tested``: something above looks at the rows' values and not only whether there are any.
    """
    tables = {**(tables or {}), **{name.lower(): own for name, own in plan.common_tables}}
    filters = lambda n: any(p.kind == "Filter" or p.kind == "UnresolvedRelation" and p.name_parts[-1].lower() in tables for p in n.plans())
    if plan.kind == "UnresolvedRelation":
        own = tables.get(plan.name_parts[-1].lower()) if len(plan.name_parts) == 1 else None
        return own is None or keeps_growing(spark, own, {k: v for k, v in tables.items() if v is not own}, True)

    def expression(n: Node, grows: bool = True) -> bool:
        if n.subquery is not None:
            return grows and n.kind != "ScalarSubquery" and keeps_growing(spark, n.subquery, tables, True) or not filters(n.subquery)
        return all(expression(c, grows and n.kind in ("And", "Or", "InSubquery")) for c in n.children)

    if not all(expression(e) for e in plan.expressions):
        return False
    below = plan.children
    if plan.kind == "Join":
        needed = {id(x.j) for x in join_sides(plan)[1]}
        kind = join_sides(plan)[0]
        sure = [x for x in below if kind in _TRUE or id(x.j) in needed and kind != "LeftAnti"]
        return all(keeps_growing(spark, x, tables, True) if any(x.j is y.j for y in sure) else not filters(x) for x in below) if sure else not any(map(filters, below))
    if plan.kind == "Except":
        return keeps_growing(spark, below[0], tables, tested) and not filters(below[1])
    if plan.kind in ("Aggregate", "GlobalLimit", "LocalLimit", "Offset") and tested or _always_a_row(spark, plan):
        return not any(map(filters, below))
    if plan.kind == "Project" and tested and any(x.kind.startswith(("WindowExpression", "UnresolvedWindow")) for e in plan.expressions for x in e.walk()):
        return not any(map(filters, below))
    tested = tested or plan.kind in ("Filter", "UnresolvedHaving", "Intersect", "Offset")
    return all(keeps_growing(spark, x, tables, tested) for x in below)


@dataclass
class Scan:
    """One base table in one scope: its rows by the constraints that they satisfy together."""

    own: list[int]
    around: frozenset[int]
    counts: DataFrame
    sets: list[frozenset[int]] | None

    def has_rows(self, kept: set[int] | frozenset[int]) -> bool:
        need = frozenset(self.own) & kept
        if self.sets is not None:
            return any(need <= s for s in self.sets)
        return not need or not holding(self.counts, [k for k, c in enumerate(self.own) if c in need]).isEmpty()

    def ways(self, gone: frozenset[int]) -> list[frozenset[int]]:
        """What else has to go, one way for each row's constraints or a constraint around the scope."""
        left = frozenset(self.own) - gone
        return [*{left - s for s in self.sets}, *(frozenset([k]) for k in self.around)]


def scans(spark: SparkSession, root: Node, sql: str, places: Places) -> list[Scan]:
    """A scan for each base table in each needed scope that has constraints of its own."""
    out, number = [], {p: k for k, p in enumerate(places)}
    for scope, common, around in needed_scopes(spark, root, sql):
        sides = {}
        todo = [scope.children[0]]
        while todo:  # tables that every row of the scope has one of
            n = todo.pop()
            if n.kind == "Join":
                todo += join_sides(n)[1]
            elif relations(n) and (n.kind == "UnresolvedRelation" or n.kind == "SubqueryAlias" and n.children[0].kind == "UnresolvedRelation"):
                name = next(iter(relations(n).values()))
                if name.lower() not in common:
                    sides[next(iter(relations(n)))] = n
        every = relations(scope.children[0])
        by: dict[str, list[int]] = {}
        for n in top_conjuncts(scope.expressions[0]):
            found = number.get(extent(n, sql) or (-1, -1))
            names = [x.name_parts for x in n.walk() if x.kind == "UnresolvedAttribute"]
            if found is None or not names or any(x.subquery is not None for x in n.walk()):
                continue
            said = {p[-2].lower() for p in names if len(p) > 1} | ({None} if any(len(p) == 1 for p in names) else set())
            table = next(iter(every)) if len(every) == 1 else next((a for a in sides if said == {a.lower()}), None)
            if table in sides and said <= {table.lower(), None} and (None not in said or len(every) == 1):
                by.setdefault(table, []).append(found)
        outer = frozenset(number[p] for p in around if p in number)
        if len(outer) < len(around):
            continue
        for table, own in by.items():
            try:
                counts = written(masks(frame(spark, sides[table]), [sql[slice(*places[k])] for k in own]), "masks")
            except PySparkException:  # a name of an outer scope: the query alone can tell
                continue
            few = counts.count() <= MOST_MASKS
            out.append(Scan(own, outer, counts, [frozenset(c for k, c in enumerate(own) if m >> k & 1) for m in whole_masks(counts, len(own))] if few else None))
    return out


def cheapest(n: int, order: list[int], conflicts: list[frozenset[int]], known: list[Scan], failed: set[frozenset[int]], proper: Callable[[frozenset[int]], bool]) -> frozenset[int] | None:
    """The smallest set, first in ``order`` among equals, that hits all conflicts, leaves rows in all scopes and isn't among the ``failed``.

    Sets grow by what the first thing that is wrong with them asks for, the smallest ones first, so
    that every set that will do grows out of its parts.
    """
    place = {k: i for i, k in enumerate(order)}
    told = [s for s in known if s.sets is not None]
    heap, seen = [(0, (), frozenset())], {frozenset()}
    while heap:
        _, _, gone = heapq.heappop(heap)
        conflict = next((c for c in conflicts if not c & gone), None)
        scan = None if conflict else next((s for s in told if not s.around & gone and not s.has_rows(frozenset(s.own) - gone)), None)
        if conflict:
            more = [frozenset([k]) for k in conflict]
        elif scan:
            more = scan.ways(gone)
        elif gone in failed or not proper(gone):
            more = [frozenset([k]) for k in range(n) if k not in gone] if failed else []
        else:
            return gone
        for own in (gone | x for x in more):
            if own not in seen:
                seen.add(own)
                heapq.heappush(heap, (len(own), tuple(sorted(place[k] for k in own)), own))
    return None


def least_conflict(kept: list[int], empty: Callable[[set[int]], bool]) -> frozenset[int]:
    """A subset of ``kept`` that is empty and of which every part has rows, by halving; ``kept`` itself is empty."""

    def halved(base: set[int], grown: bool, left: list[int]) -> list[int]:
        if grown and empty(base):
            return []
        if len(left) == 1:
            return left
        first, second = left[: len(left) // 2], left[len(left) // 2 :]
        of_second = halved(base | set(first), True, second)
        return halved(base | set(of_second), bool(of_second), first) + of_second

    return frozenset(halved(set(), False, kept))


def fewest_dropped(spark: SparkSession, root: Node, sql: str, places: Places, order: list[int], inside: Callable[[int, int], bool], has_rows: Callable[[frozenset[int]], bool], give_up: Callable[[int], None]) -> tuple[frozenset[int] | None, int]:
    """The smallest set of constraints (first in ``order`` among equals) without which ``has_rows``, and how many were tried.

    None if there is none. ``inside(a, b)``: constraint a stands inside of b. ``give_up`` is told the
    number of probes where a query's rows needn't grow with what is dropped, so that all that failed
    is worth is itself.
    """
    probes = 1
    if has_rows(frozenset()):
        return frozenset(), probes
    every, grows = frozenset(range(len(places))), keeps_growing(spark, root)
    outermost = frozenset(k for k in every if not any(inside(k, j) for j in every if j != k))
    probes += 1
    if grows and not has_rows(outermost):
        return None, probes
    known, conflicts, failed = scans(spark, root, sql, places), [], set() if grows else {frozenset()}
    proper = lambda gone: not any(inside(a, b) for a in gone for b in gone if a != b)
    try:
        while True:
            gone = cheapest(len(places), order, conflicts, known, failed, proper)
            if gone is None:
                return None, probes
            kept = every - gone
            scan = next((s for s in known if not s.around & gone and not s.has_rows(kept)), None)
            if scan is not None:
                conflicts.append(least_conflict([k for k in scan.own if k in kept], lambda ks, scan=scan: not scan.has_rows(ks)) | scan.around)
                continue
            probes += 1
            if has_rows(gone):
                return gone, probes
            if not grows:
                give_up(probes)
                failed.add(gone)
                continue

            def empty(ks: set[int]) -> bool:
                nonlocal probes
                # Where a needed scope has no rows, neither has the query.
                if any(s.around <= ks and not s.has_rows(ks) for s in known):
                    return True
                probes += 1
                dropped = every - ks
                return not has_rows(frozenset(k for k in dropped if not any(inside(k, j) for j in dropped if j != k)))

            conflicts.append(least_conflict([k for k in order if k in kept], empty))
    finally:
        for s in known:
            forget(s.counts)
