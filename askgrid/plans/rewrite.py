"""Rewrites of a query's text, made where the parser says its parts are.

Text predicates compare without regard to case, in every scope; stars become the linked columns
of their own scope; functions of the dialect that queries are written in become Spark's.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from askgrid.plans.tree import Node, blanked, extent, parse, relations, resolve, scopes

#: What the catalog's views with lower-case companions end in.
FOLDED = "__folded"
Schema = dict[str, dict[str, str]]
Edit = tuple[int, int, str]


def splice(sql: str, edits: set[Edit]) -> str:
    for start, stop, text in sorted(edits, reverse=True):
        sql = sql[:start] + text + sql[stop:]
    return sql


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _is_text(node: Node, tables: dict[str, str | None], schema: Schema) -> bool:
    if node.kind != "UnresolvedAttribute":
        return False
    found = resolve(node.name_parts, tables, schema)
    return bool(found) and schema[found[0]][found[1]].lower() in ("string", "text")


def _literals_folded(sql: str, values: list[Node]) -> set[Edit] | None:
    """Edits that lower literals; None if a literal's text could change its meaning."""
    places = [(v.span, sql[slice(*v.span)] if v.span else "") for v in values]
    if any(v.text is None or not place or "\\" in text for v, (place, text) in zip(values, places)):
        return None
    return {(*place, text.lower()) for place, text in places}


def _shown_with_companions(sql: str, root: Node, tables: set[str], schema: Schema) -> set[Edit] | None:
    """Edits that read ``tables`` (lower-case names) from the views with companions, stars meaning the other columns still; None where that can't be said."""
    if tables & {name.lower() for p in root.plans() for name, _ in p.common_tables}:
        return None
    edits: set[Edit] = set()
    real = {t.lower(): t for t in schema}
    plans = list(root.plans())
    for p in plans:
        if p.kind == "SubqueryAlias" and p.children[0].kind == "UnresolvedRelation" and p.children[0].name_parts[-1].lower() in tables:
            own = p.children[0]
            edits.add((*own.span, quoted(real[own.name_parts[-1].lower()] + FOLDED)))
        if p.kind not in ("Project", "Aggregate"):
            continue
        stars = [n for n in p.expression_nodes() if n.kind == "UnresolvedStar"]
        here = relations(p.children[0])
        if not stars or not tables & {(t or "").lower() for t in here.values()}:
            continue
        if any(j.kind == "Join" and j.j.joinType().toString().startswith(("Using", "Natural")) for j in p.children[0].plans()) or any(not n.span for n in stars):
            return None
        for n in stars:
            target = n.j.target()
            wanted = target.get().apply(target.get().size() - 1).lower() if target.isDefined() else None
            said = [f"{quoted(a)}.{quoted(c)}" if t and t.lower() in tables else f"{quoted(a)}.*" for a, t in here.items() if wanted in (None, a.lower()) for c in (schema[real[t.lower()]] if t and t.lower() in tables else [""])]
            edits.add((*n.span, ", ".join(said)))
    done = {(a, b) for a, b, _ in edits}
    for p in plans:
        if p.kind == "UnresolvedRelation" and p.name_parts[-1].lower() in tables:
            if not p.span:
                return None
            if p.span not in done:
                edits.add((*p.span, f"{quoted(real[p.name_parts[-1].lower()] + FOLDED)} AS {quoted(p.name_parts[-1])}"))
    return edits


def fold_case(spark: SparkSession, sql: str, schema: Schema, companions: dict[str, dict[str, str]] | None = None) -> str:
    """Text columns compared by =, <>, LIKE or IN with literals are compared in lower case.

    Columns with a lower-case companion in the catalog are read from there, so that the predicate
    reaches the scan; all others have lower() round them.
    """
    known = {t.lower(): {c.lower(): own for c, own in cs.items()} for t, cs in (companions or {}).items()}
    plain: set[Edit] = set()
    low: set[Edit] = set()
    used: set[str] = set()
    root = parse(spark, sql)
    for plan, tables in scopes(root):
        for n in plan.expression_nodes():
            sides, found = n.children, []
            if n.kind in ("EqualTo", "EqualNullSafe", "Like"):
                pairs = [(sides[0], sides[1])] if n.kind == "Like" else [(sides[0], sides[1]), (sides[1], sides[0])]
                found = [(column, [value]) for column, value in pairs if value.text is not None and _is_text(column, tables, schema)]
            elif n.kind == "In" and _is_text(sides[0], tables, schema):
                found = [(sides[0], sides[1:])]
            for column, values in found:
                literals = _literals_folded(sql, values)
                if literals is None or not column.span:
                    continue
                said, (table, name) = sql[slice(*column.span)], resolve(column.name_parts, tables, schema)
                own = known.get(table.lower(), {}).get(name.lower())
                aliases = [a for a, t in tables.items() if t and t.lower() == table.lower()]
                alias = column.name_parts[-2] if len(column.name_parts) > 1 else aliases[0]
                plain |= {(*column.span, f"lower({said})"), *literals}
                low |= {(*column.span, f"{quoted(alias)}.{quoted(own)}" if own else f"lower({said})"), *literals}
                used |= {table.lower()} if own else set()
    shown = _shown_with_companions(sql, root, used, schema) if used else None
    return splice(sql, plain if shown is None else low | shown)


def expand_stars(spark: SparkSession, sql: str, linked: Schema) -> str:
    """``*`` and ``t.*`` become the linked columns of the tables in their scope; a star that has none stays."""
    edits: set[Edit] = set()
    known = {t.lower(): cs for t, cs in linked.items()}
    for plan, _ in scopes(parse(spark, sql)):
        if plan.kind not in ("Project", "Aggregate"):
            continue
        tables = relations(plan.children[0])
        if None in tables.values() and len(tables) > 1:
            continue
        for n in plan.expression_nodes():
            if n.kind != "UnresolvedStar" or not n.span:
                continue
            target = n.j.target()
            wanted = target.get().apply(target.get().size() - 1).lower() if target.isDefined() else None
            names = [(a, t) for a, t in tables.items() if t is not None and wanted in (None, a.lower())]
            columns = [f"{quoted(a)}.{quoted(c)}" for a, t in names for c in known.get(t.lower(), {})]
            if columns:
                edits.add((*n.span, ", ".join(columns)))
    return splice(sql, edits)


#: Units, format codes and modifiers of the dialect's dates, in Spark's words. {t} is the time.
_UNITS = "day|month|year|hour|minute|second"
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm"}
_PARTS = {
    "%w": "cast(dayofweek({t}) - 1 AS string)",
    "%u": "cast(pmod(dayofweek({t}) - 2, 7) + 1 AS string)",
    "%W": "lpad(cast((dayofyear({t}) + 6 - pmod(dayofweek({t}) - 2, 7)) div 7 AS string), 2, '0')",
    "%s": "cast(unix_seconds(cast({t} AS timestamp)) AS string)",
    "%J": "cast(unix_micros(cast({t} AS timestamp)) / 86400000000D + 2440587.5D AS string)",
    "%%": "'%'",
}
_DATES = {"date": "cast({t} AS date)", "datetime": "date_format({t}, 'yyyy-MM-dd HH:mm:ss')", "time": "date_format({t}, 'HH:mm:ss')", "julianday": "(unix_micros(cast({t} AS timestamp)) / 86400000000D + 2440587.5D)", "unixepoch": "unix_seconds(cast({t} AS timestamp))"}
_NO_CHANGE = {"localtime", "utc", "auto", "subsec", "subsecond"}
_PREDICATES = {"EqualTo", "EqualNullSafe", "Like", "ILike", "RLike", "In", "InSubquery", "And", "Or", "Not", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "IsNull", "IsNotNull", "Exists", "Between"}
_COMPARED = {"Between", "EqualTo", "EqualNullSafe", "In", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual"}
_ARITHMETIC = {"Add", "Subtract", "Multiply"}
_INTEGRAL = {"tinyint", "smallint", "int", "integer", "bigint", "long"}

#: What the analyzed plan says of a node of the text: types of its parts, and which of them are columns.
Types = dict[tuple[str, tuple[int, int]], list[tuple[str, bool]]]


def _function(node: Node) -> str | None:
    return node.name_parts[-1].lower() if node.kind == "UnresolvedFunction" else None


def _kind(node: Node) -> str:
    """The kind of a node; the parser tells BETWEEN as a function."""
    return "Between" if _function(node) == "between" else node.kind


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _moved(time: str, modifier: str, whole_days: bool) -> str | None:
    """A time after a modifier; None if that is unknown. Months count from the first day, as days beyond a month's end run over."""
    said = modifier.strip().lower()
    if said in _NO_CHANGE:
        return time
    if found := re.fullmatch(r"start of (day|month|year)", said):
        return f"trunc({time}, '{found[1]}')" if whole_days and found[1] != "day" else time if whole_days else f"date_trunc('{found[1]}', {time})"
    if found := re.fullmatch(r"weekday ([0-6])", said):
        return f"({time} + make_interval(0, 0, 0, pmod({found[1]} + 1 - dayofweek({time}), 7)))" if not whole_days else f"date_add({time}, pmod({found[1]} + 1 - dayofweek({time}), 7))"
    found = re.fullmatch(rf"([+-]?)\s*(\d+)\s+({_UNITS})s?", said)
    if not found:
        return None
    sign, n, unit = found[1] or "+", found[2], found[3]
    if unit in ("month", "year"):
        first = f"trunc({time}, 'month')" if whole_days else f"date_trunc('month', {time})"
        rest = f"dayofmonth({time}) - 1"
        moved = f"{first} {sign} interval {n} {unit}"
        return f"date_add({moved}, {rest})" if whole_days else f"({moved} + ({time} - {first}))"
    return f"{time} {sign} interval {n} {unit}"


def _time(given: list[Node], parts: list[str], whole_days: bool) -> str | None:
    """The time that a function's arguments name: now, a text or a column, then modifiers."""
    if not given:
        out = "current_date()" if whole_days else "current_timestamp()"
    elif (given[0].text or "").strip().lower() == "now":
        out = "current_date()" if whole_days else "current_timestamp()"
    else:
        out = f"try_cast({parts[0]} AS {'date' if whole_days else 'timestamp'})" if given[0].text is not None or len(given) > 1 else parts[0]
    for n in given[1:]:
        out = None if n.text is None else _moved(out, n.text, whole_days)
        if out is None:
            return None
    return out


def _call(sql: str, node: Node) -> str | None:
    """A dialect function in Spark's words; None for all others."""
    name, given = _function(node), node.children
    parts = [sql[slice(*x)] if (x := extent(n, sql)) else "" for n in given]
    if name in _DATES and (name != "date" or len(given) != 1 or given[0].text is not None):
        whole_days = name == "date" and not any(re.search("hour|minute|second", (n.text or "").lower()) for n in given[1:])
        time = _time(given, parts, whole_days)
        return time if time is None or whole_days else _DATES[name].format(t=time)
    if name == "strftime" and given and given[0].text is not None:
        time = _time(given[1:], parts[1:], False)
        codes = re.findall(r"%.|[^%]+|%$", given[0].text, re.S)
        if time is None:
            return None
        if any(c[0] == "%" and c not in _FORMATS and c not in _PARTS for c in codes):
            return "cast(NULL AS string)"
        if all(c in _FORMATS or not re.search(r"[A-Za-z'\[\]{}#%]", c) for c in codes):
            return f"date_format({time}, '{''.join(_FORMATS.get(c, c) for c in codes)}')"
        said = [f"date_format({time}, '{_FORMATS[c]}')" if c in _FORMATS else _PARTS[c].format(t=time) if c in _PARTS else _text(c) for c in codes]
        return f"concat({', '.join(said)})"
    if name == "group_concat" and len(given) in (1, 2):
        return f"listagg({'DISTINCT ' if node.j.isDistinct() else ''}{parts[0]}, {parts[1] if len(given) == 2 else repr(',')})"
    if name == "iif" and len(given) == 3:
        return f"if({', '.join(parts)})"
    if name == "total" and len(given) == 1:
        return f"coalesce(cast(sum({parts[0]}) AS double), 0D)"
    return None


def _types(spark: SparkSession, sql: str) -> Types | None:
    """Types that the analyzed plan gives to the parts of arithmetic and comparisons, by their place; None if it can't be analyzed yet.

    Casts that the analyzer put in are looked through: they stand at the place of what they are put into.
    """
    try:
        root = Node(spark.sql(sql)._jdf.queryExecution().analyzed())
    except PySparkException:
        return None
    out: Types = {}
    for n in root.walk():
        if n.is_plan or n.kind not in _COMPARED | {"Divide", "Remainder"} or not n.span:
            continue
        parts = []
        for x in n.children:
            while x.kind == "Cast" and x.span in (n.span, None):
                x = x.children[0]
            kind = "double" if x.kind in ("Round", "BRound") else x.j.dataType().simpleString()
            parts.append((kind, x.kind in ("AttributeReference", "OuterReference")))
        out[n.kind, n.span] = parts
    for (kind, span), parts in list(out.items()):
        if kind == "GreaterThanOrEqual" and (most := out.get(("LessThanOrEqual", span))):
            out["Between", span] = parts + most[1:]
    return out


def _dialect_edits(spark: SparkSession, sql: str, schema: Schema) -> set[Edit]:
    edits: set[Edit] = set()
    root = parse(spark, sql)

    def as_number(n: Node) -> None:
        if _kind(n) in _PREDICATES and (place := extent(n, sql)):
            edits.add((*place, f"cast(({sql[slice(*place)]}) AS int)"))

    typed: list[Node] = []
    for plan, tables in scopes(root):
        shown = plan.expressions if plan.kind in ("Project", "Aggregate") else []
        for n in shown:
            as_number(n.children[0] if n.kind in ("Alias", "UnresolvedAlias") else n)
        for n in plan.expression_nodes():
            if (own := _call(sql, n)) is not None and n.span:
                edits.add((*n.span, own))
            elif _function(n) in ("max", "min", "sum", "avg") or n.kind in _ARITHMETIC:
                for x in n.children:
                    as_number(x)
            elif n.kind in ("Divide", "Remainder"):
                for x in n.children:
                    as_number(x)
                typed.append(n)
            elif _kind(n) in _COMPARED:
                typed.append(n)
                for x in n.children:
                    for y in n.children:
                        if _is_text(x, tables, schema):
                            edits |= _as_text(sql, y)
    if edits or not typed:
        return edits
    known = _types(spark, sql) or {}
    for n in typed:
        kinds = known.get((_kind(n), n.span)) if n.span else None
        if kinds is None or len(kinds) != len(n.children):
            continue
        if n.kind in ("Divide", "Remainder"):
            edits |= _divided(sql, n, [k for k, _ in kinds])
            continue
        for x, (kind, is_column) in zip(n.children, kinds):
            for y in n.children:
                if kind == "string" and is_column:
                    edits |= _as_text(sql, y)
                elif kind in _INTEGRAL and is_column and y.text is not None and y.span and not re.fullmatch(r"\s*[+-]?\d+\s*", y.text):
                    edits.add((*y.span, f"try_cast({sql[slice(*y.span)]} AS double)"))
    return edits


def _as_text(sql: str, literal: Node) -> set[Edit]:
    """A number that meets a text column is text."""
    said = sql[slice(*literal.span)] if literal.kind == "Literal" and literal.text is None and literal.span else ""
    return {(*literal.span, f"'{said}'")} if re.fullmatch(r"-?[\d.]+", said) else set()


def _divided(sql: str, n: Node, kinds: list[str]) -> set[Edit]:
    """Whole numbers are divided without a rest, other numbers' rest is that of their whole parts, and by zero gives null."""
    left, right = (extent(x, sql) for x in n.children)
    sign = "/" if n.kind == "Divide" else "%"
    at = blanked(sql).find(sign, left[1], right[0]) if left and right else -1
    if at < 0:
        return set()
    edits, whole = set(), all(k in _INTEGRAL for k in kinds)
    said = sql[slice(*right)]
    if n.kind == "Remainder" and not whole:
        place = sql[slice(*left)]
        if not place.startswith("cast("):
            edits |= {(*left, f"cast({place} AS bigint)"), (*right, f"nullif(cast({said} AS bigint), 0)")}
        return edits
    if n.kind == "Divide" and whole:
        edits.add((at, at + 1, " div "))
    zero_free = n.children[1].kind == "Literal" and not re.fullmatch(r"[0.]*", n.children[1].sql.strip("LDSB"))
    if not zero_free and not said.startswith("nullif("):
        edits.add((*right, f"nullif({said}, 0)"))
    return edits


def to_spark(spark: SparkSession, sql: str, schema: Schema | None = None) -> str:
    """The dialect in Spark's words, at the places that the parser names and so never inside of literals.

    Functions (GROUP_CONCAT, strftime, DATE('now', ...)) are renamed; predicates used as values are
    0 and 1. What depends on types goes by those of the analyzed statement, whatever an expression is
    made of: whole numbers are divided without a rest, and by zero give null; a text column meets a
    number as text, and a number that meets other text is compared with null. Innermost parts go
    first, and the text is parsed again until nothing is left to rewrite.
    """
    while True:
        edits = _dialect_edits(spark, sql, schema or {})
        inner = {e for e in edits if not any(o != e and e[0] <= o[0] and o[1] <= e[1] for o in edits)}
        if not inner:
            return sql
        sql = splice(sql, inner)


def insensitive_like(sql: str) -> str:
    """LIKE as the dialect means it, without regard to case, for queries whose columns are not known."""
    return re.sub(r"'(?:[^']|'')*'|\blike\b", lambda m: m[0] if m[0].startswith("'") else "ILIKE", sql, flags=re.I)


def refined(spark: SparkSession, sql: str, schema: Schema, linked: Schema | None = None, companions: dict[str, dict[str, str]] | None = None) -> str:
    """All rewrites; the text comes back as it was if none applies."""
    return fold_case(spark, expand_stars(spark, to_spark(spark, sql, schema), linked if linked is not None else {}), schema, companions)
