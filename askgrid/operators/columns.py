"""Column groups, typed schemas and coercion of rows."""

from __future__ import annotations

import asyncio
import inspect
from collections import Counter, deque
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions.text import SPARK_TYPES, number_in, sql_type, unit_in

LEAST_COMMON = 5


def common_length(a: str, b: str) -> int:
    """Length of the longest common block, without regard to case: ``b`` is read once through an automaton of the blocks of ``a``."""
    a, b = a.lower(), b.lower()
    steps: list[dict[str, int]] = [{}]
    longest, shorter = [0], [-1]
    last = 0
    for x in a:
        own, at = len(steps), last
        steps.append({})
        longest.append(longest[last] + 1)
        shorter.append(0)
        while at >= 0 and x not in steps[at]:
            steps[at][x] = own
            at = shorter[at]
        if at >= 0:
            to = steps[at][x]
            if longest[to] > longest[at] + 1:  # blocks that end here in more places than the longest one does
                copy = len(steps)
                steps.append(dict(steps[to]))
                longest.append(longest[at] + 1)
                shorter.append(shorter[to])
                while at >= 0 and steps[at].get(x) == to:
                    steps[at][x] = copy
                    at = shorter[at]
                shorter[to] = to = copy
            shorter[own] = to
        last = own
    best = at = n = 0
    for x in b:
        while at and x not in steps[at]:
            at = shorter[at]
            n = longest[at]
        if x in steps[at]:
            at, n = steps[at][x], n + 1
        best = max(best, n)
    return best


@F.pandas_udf(T.IntegerType())
def common_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b)], dtype="Int32")


def blocks(text: Column, n: int) -> Column:
    """Every block of ``n`` characters of a text, each once, in one pass over it."""
    # The second half of a surrogate pair begins no character.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), 1))


def related_columns(rows: DataFrame, columns: list[str], least: int = LEAST_COMMON) -> DataFrame:
    """(left, right, related): whether two columns share ``least`` characters in a row, or one holds the other, in every row where both have text.

    Texts share a block of ``least`` characters or more if they share one of just so many. So each
    cell is cut into such blocks once, the pairs of a row's cells are compared where the row is, and
    only their verdicts are gathered, after each task has combined its own; the plan does not grow
    with the number of columns. Pairs without a row that has both are not related.
    """
    text = lambda c: F.lower(F.trim(F.col(f"`{c}`").cast("string")))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), text(c).alias("t"), blocks(text(c), least).alias("b")) for k, c in enumerate(columns)])
    each = rows.select(F.filter(cells, lambda x: x["t"] != "").alias("cells"))
    # Outer, as a filter on the number of cells would compute all of them once more.
    each = each.select("cells", F.explode_outer("cells").alias("x"))
    each = each.select("x", F.explode(F.filter("cells", lambda y: y["k"] > F.col("x.k"))).alias("y"))
    good = F.contains("x.t", F.col("y.t")) | F.contains("y.t", F.col("x.t")) | F.arrays_overlap("x.b", "y.b")
    found = each.select(F.col("x.k").alias("i"), F.col("y.k").alias("j"), good.alias("good")).groupBy("i", "j").agg(F.bool_and("good").alias("good"))
    pairs = rows.sparkSession.createDataFrame([(i, j, columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2)], "i int, j int, left string, right string")
    return pairs.join(found, ["i", "j"], "left").select("left", "right", F.coalesce("good", F.lit(False)).alias("related"))


def rule_groups(columns: list[str], edges: list[tuple[str, str]], most: int = 10) -> list[list[str]]:
    """Connected columns in table order; neighbouring small groups are put together up to ``most``."""
    near: dict[str, set[str]] = {c: set() for c in columns}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, groups = set(), []
    for c in columns:
        if c in seen:
            continue
        group, todo = [], deque([c])
        seen.add(c)
        while todo:
            x = todo.popleft()
            group.append(x)
            for y in sorted(near[x] - seen, key=columns.index):
                seen.add(y)
                todo.append(y)
        groups.append(sorted(group, key=columns.index))
    out: list[list[str]] = []
    for g in groups:
        if out and len(out[-1]) + len(g) <= most:
            out[-1] += g
        else:
            out.append(list(g))
    return out


def repaired(columns: list[str], groups: list[list[str]]) -> list[list[str]]:
    """A partition of exactly the columns: unknown and repeated names go, missing ones stand alone."""
    seen: set[str] = set()
    out = []
    for g in groups:
        own = [c for c in g if c in columns and not (c in seen or seen.add(c))]
        if own:
            out.append(own)
    return out + [[c] for c in columns if c not in seen]


def hybrid_groups(columns: list[str], rules: list[list[str]], semantic: list[list[str]], least: int = 3, most: int = 10) -> list[list[str]]:
    """Rule groups sorted into semantic ones by majority, packed to ``most``, small ones put together at the end."""
    if len(columns) <= most:
        return [list(columns)]
    home = {c: k for k, g in enumerate(repaired(columns, semantic)) for c in g}
    large, buckets = [g for g in rules if len(g) > most], {}
    for g in rules:
        if len(g) <= most:
            vote = Counter(home[c] for c in g)
            buckets.setdefault(min(vote, key=lambda k: (-vote[k], k)), []).append(g)
    packed = []
    for k in sorted(buckets):
        packed += rule_groups([c for g in buckets[k] for c in g], [(g[0], c) for g in buckets[k] for c in g[1:]], most)
    small = [c for g in packed if len(g) < least for c in g]
    out = large + [g for g in packed if len(g) >= least]
    chunks = [small[i : i + most] for i in range(0, len(small), most)]
    if chunks and out and len(chunks[-1]) < least and len(out[-1]) + len(chunks[-1]) <= most:
        out[-1] = out[-1] + chunks.pop()
    return out + chunks


def inferred_types(rows: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """JSON type of each text column by what all its values are; Boolean before integer. One scan."""
    columns = columns or rows.columns
    text = {c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns}
    tests = {"boolean": lambda v: F.lower(v).isin("true", "false"), "integer": lambda v: v.rlike(r"^[+-]?\d{1,18}$"), "number": lambda v: v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")}
    names = [(c, t) for c in columns for t in tests]
    got = rows.agg(*[F.bool_and(tests[t](text[c])).alias(f"t{k}") for k, (c, t) in enumerate(names)]).first()
    out = {c: "string" for c in columns}
    for k, (c, t) in reversed(list(enumerate(names))):
        if got[k]:
            out[c] = t
    return out


def schema_errors(original: list[str], schema: dict) -> list[str]:
    """What is wrong with a designed schema: columns that are missing, or new ones that name no original column."""
    names = list(schema.get("properties", {}))
    plain = [c.replace(" ", "_") for c in original]
    missing = [c for c in original if c not in names]
    strange = [n for n in names if n not in original and not any(p in n.replace(" ", "_") for p in plain)]
    return [f"missing: {c}" for c in missing] + [f"names no column: {n}" for n in strange]


def designed_schema(groups: list[list[str]], design: Callable[[list[str]], dict], attempts: int = 3) -> dict:
    """The merged schema of all groups; only groups that failed are asked again, and the last errors are raised."""
    done: dict[int, dict] = {}
    errors: dict[int, list[str]] = {}
    for _ in range(attempts):
        for k, g in enumerate(groups):
            if k not in done:
                schema = design(g)
                errors[k] = schema_errors(g, schema)
                if not errors[k]:
                    done[k] = schema
    if len(done) < len(groups):
        raise ValueError("; ".join(e for k, es in errors.items() if k not in done for e in es))
    merged: dict = {}
    for k in range(len(groups)):
        merged |= done[k]["properties"]
    return {"title": "RowData", "type": "object", "properties": merged}


def expanded_group(group: list[str], names: list[str]) -> list[str]:
    """A group with the derived columns that name one of its columns, sorted."""
    plain = [c.replace(" ", "_") for c in group]
    return sorted({*group, *(n for n in names if any(p in n.replace(" ", "_") for p in plain))})


def coerced(rows: DataFrame, schema: dict) -> DataFrame:
    """Text columns in their types; what doesn't fit becomes null and is named in ``errors``, so no row is lost."""
    made, bad = [], []
    for name, p in schema["properties"].items():
        own = F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))
        kind = SPARK_TYPES[sql_type(p.get("type"))]
        if (p.get("type") or "").lower() == "boolean":
            value = F.when(F.lower(own).isin("true", "1"), 1).when(F.lower(own).isin("false", "0"), 0).cast("bigint")
        elif kind == "bigint":
            value = F.coalesce(own.try_cast("bigint"), F.regexp_extract(own, r"^([+-]?\d+)\.0*$", 1).try_cast("bigint"))
        else:
            value = own if kind == "string" else own.try_cast(kind)
        made.append(value.alias(name))
        bad.append(F.when(own.isNotNull() & value.isNull(), F.lit(name)))
    extra = [F.col(c) for c in rows.columns if c == "rowid" and c not in schema["properties"]]
    return rows.select(*extra, *made, F.array_compact(F.array(*bad)).alias("errors"))


def components(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """Derived columns ``{column}_{component}``: of a date day, month and year, of a quantity number and unit."""
    own = F.col(f"`{column}`")
    if kind == "date":
        day = F.to_date(F.try_to_timestamp(own, F.lit("dd/MM/yyyy")))
        return rows.withColumns({f"{column}_ngày": F.dayofmonth(day).cast("bigint"), f"{column}_tháng": F.month(day).cast("bigint"), f"{column}_năm": F.year(day).cast("bigint")})
    if kind == "quantity":
        return rows.withColumns({f"{column}_số": number_in(own), f"{column}_đơn vị": unit_in(own)})
    raise ValueError(f"no components of {kind}")


async def _all_asked(rows: list[dict], names: list[str], transform: Callable[[dict], dict | Awaitable[dict]], attempts: int, at_once: int) -> list[dict | None]:
    """Answers in the order of the rows, ``at_once`` calls at a time; None for a row without a fitting one."""
    gate, wanted = asyncio.Semaphore(at_once), set(names)
    with ThreadPoolExecutor(at_once) as pool:

        async def one(row: dict) -> dict | None:
            if inspect.iscoroutinefunction(transform):
                found = await transform(dict(row))
            else:
                found = await asyncio.get_running_loop().run_in_executor(pool, transform, dict(row))
            if not isinstance(found, dict) or set(found) != wanted:
                raise ValueError("other names")
            return found

        async def tried(row: dict) -> dict | None:
            for _ in range(attempts):
                async with gate:
                    try:
                        return await one(row)
                    except Exception:  # whatever a model or its transport raises: the row is asked again, then set aside
                        continue
            return None

        return await asyncio.gather(*map(tried, rows))


def transformed(rows: DataFrame, names: list[str], transform: Callable[[dict], dict | Awaitable[dict]], attempts: int = 3, given: list[str] | None = None, at_once: int = 10) -> DataFrame:
    """``rows`` with the columns ``names`` as ``transform`` gives them for each row's ``given`` columns (``names`` without it), as texts.

    ``transform`` may be a coroutine; a task has up to ``at_once`` calls under way, batch by batch of
    its rows, whose order stays. Other columns never reach it. An answer must have exactly the names
    asked for; a row is asked up to ``attempts`` times, keeps its values (null in columns that are
    new) if no answer fits, and ``errors`` names the columns then, so one bad row stops no others.
    """
    given = names if given is None else given
    kept = [c for c in rows.columns if c not in names and c != "errors"]
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([*[T.StructField(c, kinds[c]) for c in kept], *[T.StructField(c, T.StringType()) for c in names], T.StructField("errors", T.ArrayType(T.StringType()))])
    asked = rows.select(*[F.col(f"`{c}`") for c in kept], F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in dict.fromkeys([*given, *(c for c in names if c in kinds)])]).alias("_ag_given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            had = batch.column(len(kept)).to_pylist()
            said = asyncio.run(_all_asked([{c: r[c] for c in given} for r in had], names, transform, attempts, at_once))
            value = lambda c: pa.array([None if (v := (s or h).get(c)) is None else str(v) for s, h in zip(said, had)], pa.string())
            errors = pa.array([list(names) if s is None else [] for s in said], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(value, names), errors], [*kept, *names, "errors"])

    return asked.mapInArrow(run, out)
