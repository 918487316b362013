"""From workbooks to typed tables with metadata: cells, merged ranges, tables, labels, types, rows, sink.

What a language model may decide (headers, footers, labels, groups) is asked of one where it is
given, and every answer is checked: an answer that doesn't fit leaves the rules' result in place.
Loops of the driver are over tables and columns, never over rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators import columns as col
from askgrid.operators import sheets
from askgrid.plans.assist import LanguageModel, last_block
from askgrid.sources.catalog import EAV, TableCatalog
from askgrid.sources.staging import written
from askgrid.sources.xlsx import XlsxSource

#: Rows of either end of a table that a model sees.
SHOWN = 6


def read_grid(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """The cells (sheet, r, c, v) of a workbook or of a folder of them, merged ranges filled."""
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx")
    reader = reader.option("sheets", wanted) if wanted else reader
    merges = reader.option("relation", "merges").load(path)
    cells = reader.option("relation", "cells").load(path)
    return sheets.fill_merged(cells.select("sheet", "r", "c", "v"), merges.select("sheet", "min_row", "max_row", "min_col", "max_col"))


def _said(model: LanguageModel, step: str, **given):
    """A model's JSON answer; None where it has no form."""
    answer = model.ask(step, **given)
    try:
        return json.loads(last_block(answer, "json") or answer)
    except ValueError:
        return None


def header_and_footer(model: LanguageModel, rows: list[list], indices: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Indices of header and footer rows among those shown, the first and last of a table; none of them twice, none outside."""
    indices = list(range(len(rows))) if indices is None else indices
    said = _said(model, "edges", rows=rows, indices=indices)
    said = said if isinstance(said, dict) else {}
    good = lambda xs, taken: sorted({x for x in xs or [] if isinstance(x, int) and x in indices and x not in taken})
    header = good(said.get("header"), ())
    return header, good(said.get("footer"), header)


def generated_labels(model: LanguageModel, rows: list[list], labels: list[str]) -> list[str]:
    """A model's labels for a table without any; the rules' ones unless there is one text for each column."""
    said = _said(model, "labels", rows=rows)
    fits = isinstance(said, list) and len(said) == len(labels) and all(isinstance(x, str) and x.strip() for x in said)
    return [x.strip() for x in said] if fits else labels


def grouped(rows: DataFrame, names: list[str], model: LanguageModel | None) -> list[list[str]]:
    """Groups of related columns: by their values, sorted into those that a model finds by their meaning."""
    edges = [(r["left"], r["right"]) for r in col.related_columns(rows, names).where("related").collect()] if len(names) > 1 else []
    rules = col.rule_groups(names, edges)
    said = _said(model, "groups", columns=names) if model else None
    if not isinstance(said, list) or not all(isinstance(g, list) for g in said):
        return rules
    return col.hybrid_groups(names, rules, col.repaired(names, said))


def put_together(header: list[list]) -> list[str]:
    """One label for each column out of several header rows, ``Column i`` where they have none."""
    parts = [[str(x).strip() for x in column if x is not None and str(x).strip()] for column in zip(*header)]
    return ["_".join(p) or f"Column {k}" for k, p in enumerate(parts, 1)]


def distinct_labels(labels: list[str]) -> list[str]:
    """Labels with a number after those that stand there again, whatever their case."""
    seen: dict[str, int] = {}
    out = []
    for x in labels:
        n = seen[x.lower()] = seen.get(x.lower(), 0) + 1
        out.append(x if n == 1 else f"{x}_{n}")
    return out


def edges(model: LanguageModel, rows: DataFrame, labels: list[str]) -> tuple[list[list], DataFrame]:
    """Header rows that a model names, none if it names none, and the data rows: neither those above the header nor the footer."""
    last = rows.agg(F.max("rowid")).first()[0] or 0
    shown = [(0, labels), *((r["rowid"], r["cells"]) for r in rows.where((F.col("rowid") <= SHOWN) | (F.col("rowid") > last - SHOWN)).orderBy("rowid").collect())]
    header, footer = header_and_footer(model, [cells for _, cells in shown], [k for k, _ in shown])
    rows = rows.where((F.col("rowid") > header[0]) & ~F.col("rowid").isin(header)) if header else rows
    rows = rows.where(~F.col("rowid").isin(footer)) if footer else rows
    before = header[0] + len(header) - 1 if header else 0
    return [cells for k, cells in shown if k in header], rows.withColumn("rowid", F.col("rowid") - before)


def schema_of(model: LanguageModel | None, groups: list[list[str]], kinds: dict[str, str], examples: dict[str, list]) -> dict:
    """The schema that a model designs group by group, with new columns that name the ones they come from; the inferred types without one."""
    plain = {"properties": {c: {"type": kinds[c]} for g in groups for c in g}}
    if model is None:
        return plain

    def design(group: list[str]) -> dict:
        said = _said(model, "schema", columns=group, types={c: kinds[c] for c in group}, examples={c: examples[c] for c in group})
        said = said if isinstance(said, dict) else {}
        own = said.get("properties", said)
        return {"properties": {c: p if isinstance(p, dict) else {"type": p} for c, p in own.items()}}

    try:
        return col.designed_schema(groups, design)
    except ValueError:
        return plain


#: What the parts of dates and quantities are called.
_COMPONENTS = {"date": ("ngày", "tháng", "năm"), "quantity": ("số", "đơn vị")}


def derived(rows: DataFrame, labels: list[str], new: list[str], model: LanguageModel | None) -> DataFrame:
    """``rows`` with the columns ``new``: parts of dates and quantities by rule, all others as a model tells them row by row."""
    left = list(new)
    for c in labels:
        for kind, parts in _COMPONENTS.items():
            own = [f"{c}_{p}" for p in parts]
            if set(own) <= set(left):
                rows = col.components(rows, c, kind)
                left = [x for x in left if x not in own]
    if not left or model is None:
        return rows.withColumn("errors", F.array().cast("array<string>"))
    return col.transformed(rows, left, lambda row: _said(model, "transform", row=row, names=left), given=labels)


def ingest(spark: SparkSession, catalog: TableCatalog, path: str, wanted: str | None = None, if_exists: str = "replace", least_rows: int = 1, model: LanguageModel | None = None, typed: bool = False) -> list[str]:
    """Write every table of a workbook to the catalog, typed, with a rowid and metadata; the names written.

    Tables are divided by blanks, or with ``typed`` by their cells' types, their header being the row
    above if that is texts. A model, where there is one, names header rows (several are put together)
    and footer rows of those at both ends, labels for a table without a header, groups of columns
    and a schema of each group; what the schema adds to the columns is derived by rule or asked row
    by row. A sheet's only table has the sheet's name, several have numbers after it. Cells that
    don't fit their column's type, and rows that a model had no fitting answer to, become null there
    and are counted in the metadata.
    """
    grid = written(read_grid(spark, path, wanted), "grid")
    tables = written(sheets.typed_with_headers(grid) if typed else sheets.detect_tables(grid).withColumn("has_header", F.lit(True)), "tables")
    rows = written(sheets.table_rows(grid, tables), "rows")
    found = tables.join(sheets.labels(grid, tables), ["sheet", "table_index"]).orderBy("sheet", "table_index").collect()  # a row a table
    several = {r["sheet"] for r in found if r["table_index"] > 0}
    names = []
    for t in found:
        name = f"{t['sheet']} {t['table_index'] + 1}" if t["sheet"] in several else t["sheet"]
        own = rows.where((F.col("sheet") == t["sheet"]) & (F.col("table_index") == t["table_index"]))
        labels = list(t["labels"]) if t["has_header"] else [f"Column {k + 1}" for k in range(t["num_cols"])]
        if model:
            header, own = edges(model, own, list(t["labels"]))
            labels = put_together(header) if header else labels
            if all(x.startswith("Column ") for x in labels):
                labels = generated_labels(model, [r["cells"] for r in own.orderBy("rowid").limit(SHOWN).collect()], labels)
        labels = distinct_labels(labels)
        flat = own.select("rowid", *[F.col("cells")[k].alias(x) for k, x in enumerate(labels)])
        kinds = col.inferred_types(flat, labels)
        groups = grouped(flat, labels, model)
        some = flat.orderBy("rowid").limit(SHOWN).collect() if model else []
        schema = schema_of(model, groups, kinds, {c: [r[c] for r in some] for c in labels})
        every = list(schema["properties"])
        made = written(derived(flat, labels, [c for c in every if c not in labels], model), "made")
        fit = col.coerced(made.select("rowid", *[F.col(f"`{c}`") if c in made.columns else F.lit(None).cast("string").alias(c) for c in every]), schema)
        if catalog.write(name, fit.drop("errors"), if_exists, least_rows=least_rows) is None:
            continue
        group = {c: k for k, g in enumerate(groups) for c in col.expanded_group(g, every)}
        bad = fit.select(F.explode("errors").alias("c")).unionByName(made.select(F.explode("errors").alias("c")))
        bad = {r["c"]: r["n"] for r in bad.groupBy("c").agg(F.count("*").alias("n")).collect()}
        kinds |= {c: (p.get("type") or "string") for c, p in schema["properties"].items()}
        notes = {c: p.get("description") or c for c, p in schema["properties"].items()}
        facts = [(c, a, str(v)) for c in every for a, v in (("description", notes[c]), ("type", kinds[c]), ("group", group[c]), ("unfit", bad.get(c, 0)))]
        catalog.describe(name, spark.createDataFrame(facts, EAV))
        catalog.describe_tables(spark.createDataFrame([(name, "summary", f"{name}: {', '.join(every)}"), (name, "data_source", "sql")], EAV))
        names.append(name)
    return names
