"""From grids of cells to tables: merged cells, table detection, headers, types.

A grid is long: (sheet, r, c, v). Merged cells are filled by a join; detection keeps state from row
to row and runs per sheet in applyInPandas, a sheet being small while files and sheets are many.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.functions.text import cell_type

TABLES = "sheet string, table_index int, start_row int, end_row int, start_col int, num_cols int, num_data_rows int"
#: Words that begin a table's footer.
FOOTER = ("total", "sum", "average", "note", "source")


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range has the value of its first cell.

    Ranges are spread to their cells and joined by place: an equi-join, not a comparison of all
    cells with all ranges. Where ranges overlap the first in reading order wins.
    """
    spread = merges.select("sheet", "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("r"), "max_col")
    spread = spread.select("sheet", "min_row", "min_col", "r", F.explode(F.sequence("min_col", "max_col")).alias("c"))
    spread = spread.groupBy("sheet", "r", "c").agg(F.min(F.struct("min_row", "min_col")).alias("m")).select("sheet", "r", "c", "m.*")
    first = cells.select("sheet", F.col("r").alias("min_row"), F.col("c").alias("min_col"), F.col("v").alias("merged"))
    filled = spread.join(first, ["sheet", "min_row", "min_col"], "left").select("sheet", "r", "c", "merged", F.lit(True).alias("inside"))
    both = cells.select("sheet", "r", "c", "v").join(filled, ["sheet", "r", "c"], "full")
    return both.select("sheet", "r", "c", F.when(F.col("inside"), F.col("merged")).otherwise(F.col("v")).alias("v")).where("v is not null")


def _grid(frame: pd.DataFrame) -> dict[int, dict[int, str]]:
    rows: dict[int, dict[int, str]] = {}
    for r, c, v in zip(frame["r"], frame["c"], frame["v"]):
        if v is not None and str(v) != "":
            rows.setdefault(int(r), {})[int(c)] = v
    return rows


def _run(row: dict[int, str], start: int) -> int:
    n = 0
    while start + n in row:
        n += 1
    return n


def detect_tables(cells: DataFrame, min_rows: int = 1, min_cols: int = 1) -> DataFrame:
    """Tables divided by blanks: a header is a run of filled cells, its rows go on until a row is empty below it or reaches further than it does."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        grid, out = _grid(frame), []
        at, last = min(grid, default=1), max(grid, default=0)
        while at <= last:
            if at not in grid:
                at += 1
                continue
            start = min(grid[at])
            width = _run(grid[at], start)
            end = at
            while end + 1 <= last:
                row = grid.get(end + 1, {})
                if not any(start <= c < start + width for c in row) or _run(row, start) > width:
                    break
                end += 1
            if width >= min_cols and end - at >= min_rows:
                out.append((frame["sheet"].iloc[0], len(out), at, end, start, width, end - at))
                at = end + 1
            else:
                at += 1
        return pd.DataFrame(out, columns=[x.split()[0] for x in TABLES.split(", ")])

    return cells.where("v is not null").groupBy("sheet").applyInPandas(find, TABLES)


def detect_typed_tables(cells: DataFrame, min_rows: int = 2) -> DataFrame:
    """Tables whose rows have compatible cell types: wider rows extend a table, unknown types are refined, used cells aren't used again."""
    typed = cells.withColumn("vtype", cell_type(F.col("v")))

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        kinds: dict[int, dict[int, str]] = {}
        for r, c, t in zip(frame["r"], frame["c"], frame["vtype"]):
            if t != "NULL":
                kinds.setdefault(int(r), {})[int(c)] = t
        out, used = [], set()
        for at in sorted(kinds):
            start = next((c for c in sorted(kinds[at]) if (at, c) not in used), None)
            if start is None:
                continue
            types = {start + k: kinds[at][start + k] for k in range(_run(kinds[at], start)) if (at, start + k) not in used}
            end = at
            while end + 1 in kinds:
                row = {c: t for c, t in kinds[end + 1].items() if c >= start and (end + 1, c) not in used}
                row = {start + k: row[start + k] for k in range(max((c - start + 1 for c in row), default=0)) if start + k in row}
                if not row or start not in row or any(types.get(c, t) != t for c, t in row.items()):
                    break
                types |= row
                end += 1
            if end - at + 1 >= min_rows:
                used |= {(r, c) for r in range(at, end + 1) for c in types}
                out.append((frame["sheet"].iloc[0], len(out), at, end, start, max(types) - start + 1, end - at + 1))
        return pd.DataFrame(out, columns=[x.split()[0] for x in TABLES.split(", ")])

    return typed.groupBy("sheet").applyInPandas(find, TABLES)


def header_and_footer(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """``tables`` with has_header (the row above is at least half texts) and has_footer (the row below begins like one)."""
    near = cells.withColumn("vtype", cell_type(F.col("v"))).join(tables.select("sheet", "table_index", "start_row", "end_row", "start_col", "num_cols"), "sheet")
    near = near.where("c between start_col and start_col + num_cols - 1 and r in (start_row - 1, end_row + 1)")
    lead = F.lower(F.col("v"))
    foot = F.lit(False)
    for word in FOOTER:
        foot = foot | F.contains(lead, F.lit(word))
    above = F.col("r") == F.col("start_row") - 1
    marks = near.groupBy("sheet", "table_index").agg(
        F.coalesce(F.count_if(above & (F.col("vtype") == "STRING")) * 2 >= F.nullif(F.count_if(above), F.lit(0)), F.lit(False)).alias("has_header"),
        F.coalesce(F.bool_or(~above & foot), F.lit(False)).alias("has_footer"),
    )
    return tables.join(marks, ["sheet", "table_index"], "left").fillna(False, ["has_header", "has_footer"])


def typed_with_headers(cells: DataFrame) -> DataFrame:
    """Typed tables the way that ``table_rows`` and ``labels`` read them, from the row above on, and whether that is a header."""
    found = header_and_footer(cells, detect_typed_tables(cells))
    return found.withColumn("start_row", F.col("start_row") - 1).select(*[x.split()[0] for x in TABLES.split(", ")], "has_header")


def table_rows(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(sheet, table_index, rowid, cells): data rows, one array of cells each, with gaps as nulls."""
    inside = cells.join(tables, "sheet").where("r > start_row and r <= end_row and c >= start_col and c < start_col + num_cols")
    rows = inside.groupBy("sheet", "table_index", (F.col("r") - F.col("start_row")).cast("bigint").alias("rowid"), "num_cols").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c") - F.col("start_col"), F.trim("v")))).alias("m"))
    return rows.select("sheet", "table_index", "rowid", F.transform(F.sequence(F.lit(0), F.col("num_cols") - 1), lambda k: F.col("m")[k]).alias("cells"))


def labels(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(sheet, table_index, labels): the header row's texts, ``Column i`` where it has none."""
    spots = tables.select("*", F.explode(F.sequence(F.lit(0), F.col("num_cols") - 1)).alias("k")).withColumns({"r": F.col("start_row"), "c": F.col("start_col") + F.col("k")})
    named = spots.join(cells.select("sheet", "r", "c", "v"), ["sheet", "r", "c"], "left")
    name = F.coalesce(F.nullif(F.trim("v"), F.lit("")), F.concat(F.lit("Column "), (F.col("k") + 1).cast("string")))
    return named.groupBy("sheet", "table_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", name.alias("name")))), lambda x: x["name"]).alias("labels"))


def filled_runs(cells: DataFrame) -> DataFrame:
    """(sheet, r, start, n): runs of filled cells in each row."""
    place = Window.partitionBy("sheet", "r").orderBy("c")
    island = cells.where("v is not null").withColumn("i", F.col("c") - F.row_number().over(place))
    return island.groupBy("sheet", "r", "i").agg(F.min("c").alias("start"), F.count("*").alias("n")).drop("i")


def snippet(rows: DataFrame, n: int, rowid: str = "rowid", seed: int = 42) -> DataFrame:
    """The first n rows, n of the middle by hash order, and the last n; all rows if there are no more than 3n."""
    total = rows.agg(F.max(rowid)).first()[0] or 0
    if total <= 3 * n:
        return rows
    ends = rows.where((F.col(rowid) <= n) | (F.col(rowid) > total - n))
    middle = rows.where((F.col(rowid) > n) & (F.col(rowid) <= total - n)).orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col(rowid).cast("string"))), rowid).limit(n)
    return ends.unionByName(middle)


def row_objects(rows: DataFrame) -> DataFrame:
    """Each row as JSON."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("row"))
