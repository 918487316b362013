"""Queries of table detection, ingest, sinks and logs, each with its DuckDB statement over the driver's tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.operators import columns, search, sheets
from askgrid.plans.assist import OfflineModel
from askgrid.plans.ingest import ingest
from askgrid.plans.rewrite import refined
from askgrid.queries import query, read
from askgrid.sources import catalog, logs, xlsx
from askgrid.sources.staging import new_path

#: Sheets, one a region: its name over all columns in row 2, labels in row 3, a row a nation from row 4 on, and a total.
_PLACED = "SELECT n.*, r_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS total FROM nation n JOIN region ON n_regionkey = r_regionkey"


def _grid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The cells and merged ranges of the sheets."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    cell = lambda r, c, v: F.struct(F.lit(r).cast("int").alias("r") if isinstance(r, int) else r.cast("int").alias("r"), F.lit(c).alias("c"), v.cast("string").alias("v"))
    own = F.array(cell(F.col("k") + 3, 2, F.col("n_nationkey")), cell(F.col("k") + 3, 3, F.col("n_name")), cell(F.col("k") + 3, 4, F.col("r_name")))
    top = F.array(cell(1, 2, F.col("r_name")), cell(3, 2, F.lit("Key")), cell(3, 3, F.lit("Name")), cell(3, 4, F.lit("Region")), cell(F.col("n") + 4, 2, F.lit("Total")))
    regions = rows.groupBy("r_name").agg(F.count("*").alias("n"))
    cells = rows.select(F.col("r_name").alias("sheet"), F.explode(own).alias("x")).unionByName(regions.select(F.col("r_name").alias("sheet"), F.explode(top).alias("x")))
    merged = regions.select(F.col("r_name").alias("sheet"), *[F.lit(v).alias(k) for k, v in (("min_row", 1), ("max_row", 1), ("min_col", 2), ("max_col", 4))])
    return cells.select("sheet", "x.*"), merged


@query(f"SELECT r_name AS sheet, 0 AS table_index, 3 AS start_row, (total + 4)::INT AS end_row, 2 AS start_col, 3 AS num_cols, (total + 1)::INT AS num_data_rows FROM ({_PLACED}) GROUP BY r_name, total")
def table_detect(spark, sf_dir):
    return sheets.detect_tables(_grid(spark, sf_dir)[0])


@query(f"SELECT r_name AS sheet, 0 AS table_index, 4 AS start_row, (total + 3)::INT AS end_row, 2 AS start_col, 3 AS num_cols, total::INT AS num_data_rows, true AS has_header, true AS has_footer FROM ({_PLACED}) GROUP BY r_name, total")
def typed_tables(spark, sf_dir):
    """Tables of rows whose cells have compatible types, with the header above and the footer below."""
    cells, _ = _grid(spark, sf_dir)
    return sheets.header_and_footer(cells, sheets.detect_typed_tables(cells))


@query(f"SELECT r_name AS sheet, 1 AS r, c, r_name AS v FROM region JOIN (SELECT unnest([2, 3, 4]) AS c) ON true")
def merge_fill(spark, sf_dir):
    cells, merged = _grid(spark, sf_dir)
    return sheets.fill_merged(cells, merged).where("r = 1")


@query(f"SELECT r_name AS sheet, 0 AS table_index, k AS rowid, n_nationkey::VARCHAR || '|' || n_name || '|' || r_name AS cells, 'Key|Name|Region' AS labels FROM ({_PLACED}) UNION ALL SELECT DISTINCT r_name, 0, total + 1, 'Total|-|-', 'Key|Name|Region' FROM ({_PLACED})")
def table_rows(spark, sf_dir):
    cells, _ = _grid(spark, sf_dir)
    tables = sheets.detect_tables(cells)
    labels = sheets.labels(cells, tables).select("sheet", "table_index", F.array_join("labels", "|").alias("labels"))
    return sheets.table_rows(cells, tables).withColumn("cells", F.array_join("cells", "|", "-")).join(labels, ["sheet", "table_index"])


@query(f"SELECT r_name AS sheet, (k + 3)::INT AS r, 2 AS start, 3::BIGINT AS n FROM ({_PLACED}) UNION ALL SELECT DISTINCT r_name, unnest([1, 3, total + 4])::INT, 2, unnest([1, 3, 1])::BIGINT FROM ({_PLACED})")
def filled_runs(spark, sf_dir):
    return sheets.filled_runs(_grid(spark, sf_dir)[0])


@query("WITH p AS (SELECT p_partkey + 1 AS rowid, p_name, count(*) OVER () AS n FROM part), m AS (SELECT * FROM p WHERE rowid > 10 AND rowid <= n - 10 ORDER BY md5('42-' || rowid), rowid LIMIT 10) SELECT '{\"rowid\":' || rowid || ',\"p_name\":\"' || p_name || '\"}' AS row FROM (SELECT * FROM m UNION ALL SELECT * FROM p WHERE rowid <= 10 OR rowid > n - 10)")
def table_snippet(spark, sf_dir):
    """The first and last rows and ten of the middle, as JSON."""
    return sheets.row_objects(sheets.snippet(read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("rowid"), "p_name"), 10))


@query("SELECT n_regionkey AS \"group\", string_agg(n_name, ',' ORDER BY n_name) AS columns FROM nation GROUP BY 1")
def column_groups(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    row = lambda a, v: nation.select(F.col("n_name").alias("entity"), F.lit(a).alias("attribute"), v.cast("string").alias("value"))
    eav = row("group", F.col("n_regionkey")).unionByName(row("description", F.col("n_name"))).unionByName(row("group", F.lit("x")))
    return catalog.column_groups(eav).withColumn("columns", F.array_join("columns", ","))


_MESSY = "SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR || CASE WHEN l_linenumber = 2 THEN '.0' WHEN l_linenumber = 3 THEN ' pcs' ELSE '' END AS part, ' ' || l_quantity::VARCHAR AS quantity, CASE l_returnflag WHEN 'A' THEN 'True' WHEN 'N' THEN '0' ELSE 'maybe' END AS flag, l_linestatus AS status FROM lineitem"


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN trunc(part::DOUBLE)::BIGINT END AS part, trim(quantity)::DOUBLE AS quantity, CASE flag WHEN 'True' THEN 1::BIGINT WHEN '0' THEN 0::BIGINT END AS flag, status,"
    f" CASE WHEN l_linenumber = 3 THEN 'part,' ELSE '' END || CASE WHEN flag = 'maybe' THEN 'flag,' ELSE '' END AS errors FROM ({_MESSY})"
)
def coerced_rows(spark, sf_dir):
    """Texts in the types of a schema; what doesn't fit is null and named."""
    text = F.col("l_partkey").cast("string")
    part = F.when(F.col("l_linenumber") == 2, F.concat(text, F.lit(".0"))).when(F.col("l_linenumber") == 3, F.concat(text, F.lit(" pcs"))).otherwise(text)
    flag = F.when(F.col("l_returnflag") == "A", "True").when(F.col("l_returnflag") == "N", "0").otherwise("maybe")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"), part.alias("part"), F.concat(F.lit(" "), F.col("l_quantity").cast("string")).alias("quantity"), flag.alias("flag"), F.col("l_linestatus").alias("status"))
    kinds = {"l_orderkey": "integer", "l_linenumber": "integer", "part": "integer", "quantity": "number", "flag": "boolean", "status": "string"}
    out = columns.coerced(rows, {"properties": {c: {"type": t} for c, t in kinds.items()}})
    return out.withColumns({"l_linenumber": F.col("l_linenumber").cast("int"), "errors": F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(","))), "")})


def _types_sql() -> str:
    number, whole = "regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')", "regexp_matches(v, '^[+-]?[0-9]{1,18}$')"
    one = "SELECT '{c}' AS name, CASE WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'boolean' WHEN bool_and({w}) THEN 'integer' WHEN bool_and({n}) THEN 'number' ELSE 'string' END AS kind FROM (SELECT trim({c}::VARCHAR) AS v FROM part)"
    return " UNION ALL ".join(one.format(c=c, w=whole, n=number) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


@query(_types_sql())
def inferred_types(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    kinds = columns.inferred_types(part.select(*[F.col(c).cast("string").alias(c) for c in part.columns]))
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


@query("SELECT o_orderkey, day(o_orderdate)::BIGINT AS \"day_ngày\", month(o_orderdate)::BIGINT AS \"day_tháng\", year(o_orderdate)::BIGINT AS \"day_năm\", round(o_totalprice, 1) AS \"price_số\", 'km' AS \"price_đơn vị\" FROM orders")
def derived_components(spark, sf_dir):
    """Parts of dates and of numbers with units, as columns of their own."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.concat(F.round("o_totalprice", 1).cast("decimal(20,1)").cast("string"), F.lit(" km")).alias("price"))
    return columns.components(columns.components(rows, "day", "date"), "price", "quantity").drop("day", "price")


@query("SELECT min(p_partkey) FILTER (p_size = most) AS rowid FROM (SELECT *, max(p_size) OVER (PARTITION BY floor((p_partkey - 1) / 3)) AS most FROM part) GROUP BY floor((p_partkey - 1) / 3)")
def reranked_rows(spark, sf_dir):
    """What a judge of three rows at a time keeps: the largest of them, the first of several."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rowid"), "p_size")
    return search.rerank(rows, lambda batch: [max(batch, key=lambda r: (r["p_size"], -r["rowid"]))["rowid"], -1]).select("rowid")


@query("SELECT s_suppkey AS \"Key\", s_name AS \"Name\", s_acctbal AS \"Balance\", s_suppkey % 2 AS \"Odd\", strftime(DATE '2020-02-28' + s_suppkey::INT, '%Y-%m-%d') AS \"Since\", row_number() OVER (ORDER BY s_suppkey) AS rowid, 'string' AS since_kind, 0 AS unfit FROM supplier")
def workbook_to_table(spark, sf_dir):
    """Suppliers as a workbook with dates and flags, ingested, and read from a catalog that is opened anew."""
    since = F.date_add(F.lit("2020-02-28").cast("date"), F.col("s_suppkey").cast("int"))
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_acctbal", F.col("s_suppkey") % 2 == 1, since).toDF("Key", "Name", "Balance", "Odd", "Since")
    folder = new_path(spark, "workbook")
    book = f"{folder.removeprefix('file:').replace('///', '/')}.xlsx"
    spark.dataSource.register(xlsx.XlsxSource)
    rows.write.format("xlsx").mode("overwrite").option("sheet", "Suppliers").save(book)
    ingest(spark, catalog.TableCatalog(spark, folder), book)
    found = catalog.TableCatalog(spark, folder).tables
    facts = catalog.pivoted(found["Suppliers__metadata"], ["type", "unfit"]).where("entity = 'Since'").select(F.col("type").alias("since_kind"), F.col("unfit").cast("int").alias("unfit"))
    return found["Suppliers"].join(F.broadcast(facts), F.lit(True))  # one row


def _lines(header: list[str], rows: DataFrame):
    yield header
    for r in rows.toLocalIterator():
        yield list(r)


@query("SELECT *, row_number() OVER (ORDER BY grp, c_custkey) AS rowid FROM (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS grp FROM customer)")
def appended_table(spark, sf_dir):
    """A table written in two parts; numbers of the second follow those of the first."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(1).alias("grp"))
    own = catalog.TableCatalog(spark, new_path(spark, "catalog"))
    own.write("khách hàng", rows.where("grp = 1"), order=["c_custkey"])
    return own.write("khách hàng", rows.where("grp = 2"), "append", order=["c_custkey"])


@query("SELECT 'nation' AS name, count(*) AS n, 'n_name=countries; n_regionkey=where' AS notes, 'the nation table' AS summary FROM nation UNION ALL SELECT 'region', count(*), '', 'the region table' FROM region")
def catalog_listing(spark, sf_dir):
    """Tables and metadata that a new catalog finds; one table too small and one ignored are not listed."""
    folder = new_path(spark, "catalog")
    own = catalog.TableCatalog(spark, folder)
    for name in ("nation", "region", "supplier"):
        own.write(name, read(spark, sf_dir, name))
        own.describe_tables(spark.createDataFrame([(name, "summary", f"the {name} table")], catalog.EAV))
    own.write("empty", read(spark, sf_dir, "nation").where("n_nationkey < 0"), least_rows=1)
    own.describe("nation", spark.createDataFrame([("n_name", "description", "names"), ("n_regionkey", "description", "where")], catalog.EAV))
    own.describe("nation", spark.createDataFrame([("n_name", "description", "countries")], catalog.EAV))
    again = catalog.TableCatalog(spark, folder, ignore=["supplier"])
    summary = catalog.pivoted(again.tables[catalog.HIDDEN], ["summary"])
    parts = []
    for name in again.names():
        notes = ""
        if f"{name}__metadata" in again.tables:
            notes = "; ".join(f"{r['entity']}={r['value']}" for r in again.tables[f"{name}__metadata"].orderBy("entity").collect())
        parts.append(again.tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(notes).alias("notes")))
    return reduce(DataFrame.unionByName, parts).join(summary.withColumnRenamed("entity", "name"), "name")


@query("SELECT 'part' AS table_name, 'p_brand' AS column_name, p_brand AS value, 256 AS dimensions FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'part', 'p_type', p_type, 256 FROM (SELECT DISTINCT p_type FROM part)")
def kept_value_index(spark, sf_dir):
    """A value index written to a catalog and loaded by another one."""
    folder, embedder = new_path(spark, "catalog"), search.HashingEmbedder()
    index = search.embed_values(search.distinct_values(read(spark, sf_dir, "part"), "part", ["p_brand", "p_type"]), embedder)
    catalog.TableCatalog(spark, folder).write_index("part", index)
    return catalog.TableCatalog(spark, folder).index(["part"]).select("table_name", "column_name", "value", F.size("embedding").alias("dimensions"))


_TRACED = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user'"


def _write_traces(spark, sf_dir) -> str:
    """User turns as a trace log, every fifth of another tag, and a broken line a file."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    history = F.to_json(F.when(before.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), before.alias("content")))).otherwise(F.array().cast("array<struct<role: string, content: string>>")))
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = turns.select(F.col("conv_id").cast("string").alias("sessionId"), at.alias("timestamp"), F.array(F.when(F.col("conv_id") % 5 == 0, "test").otherwise("live")).alias("tags"), F.col("text").alias("input"), F.struct(history.alias("history")).alias("metadata"))
    path = new_path(spark, "traces")
    rows.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([('{"sessionId": "broken',)], "value string")).write.text(path)
    return path


@query(f"SELECT conv_id::VARCHAR AS session, turn AS second, md5(text) AS question, coalesce(md5(before), '') AS history FROM ({_TRACED}) WHERE conv_id % 5 <> 0")
def trace_log(spark, sf_dir):
    rows = logs.traces(spark, _write_traces(spark, sf_dir), "live")
    return rows.select("session", (F.unix_timestamp("at") - 1_700_000_000).alias("second"), F.md5("question").alias("question"), F.coalesce(F.md5(F.get("conversation_history", F.lit(0))["content"]), F.lit("")).alias("history"))


@query(f"SELECT md5(text) AS message, coalesce(md5(before), '') AS history FROM ({_TRACED}) WHERE conv_id % 5 = 0 ORDER BY md5('42-' || conv_id || '-' || strftime(to_timestamp(1700000000 + turn) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')), conv_id::VARCHAR, turn LIMIT 20")
def replay_samples(spark, sf_dir):
    """Twenty test samples from the log, the same ones every time, written and read as JSON lines."""
    path = new_path(spark, "samples")
    logs.write_lines(logs.replay_samples(spark, _write_traces(spark, sf_dir), "test", 20), path)
    return logs.samples(spark, path).select(F.md5("current_message").alias("message"), F.coalesce(F.md5(F.get("conversation_history", F.lit(0))["content"]), F.lit("")).alias("history"))


@query("SELECT n_nationkey, n_name, n_regionkey, 'json' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'csv' FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'xlsx' FROM nation")
def exported_tables(spark, sf_dir):
    """A table written as JSON arrays, CSV and a workbook, and read again."""
    nation, path = read(spark, sf_dir, "nation"), new_path(spark, "export")
    schema = ", ".join(f"{c} {t}" for c, t in nation.dtypes)
    logs.write_json(nation, f"{path}-json")
    logs.export(nation, f"{path}-csv", "csv")
    book = f"{path.removeprefix('file:').replace('///', '/')}.xlsx"
    logs.export(nation, book, "xlsx", footer=[["Total"]])
    spark.dataSource.register(xlsx.XlsxSource)
    cells = spark.read.format("xlsx").load(book).where("r > 1 and not (c = 1 and v = 'Total')")
    wide = cells.groupBy("r").pivot("c", [1, 2, 3]).agg(F.first("v")).select(*[F.col(str(k + 1)).cast(t).alias(c) for k, (c, t) in enumerate(nation.dtypes)])
    found = {"json": logs.read_json(spark, f"{path}-json", schema), "csv": spark.read.option("header", True).schema(schema).csv(f"{path}-csv"), "xlsx": wide}
    return reduce(DataFrame.unionByName, [t.withColumn("kind", F.lit(k)) for k, t in found.items()])


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_brand) IN ('brand#3', 'brand#7') AND lower(p_type) LIKE 'sm%' AND lower(p_name) <> 'x'")
def casefold_pushed(spark, sf_dir):
    """Predicates on lower-case companions, which the scan takes; the columns of the table are as they were."""
    own = catalog.TableCatalog(spark, new_path(spark, "catalog"))
    own.write("part", read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), fold=["p_name", "p_brand", "p_type"])
    return spark.sql(refined(spark, "SELECT * FROM part WHERE p_brand IN ('BRAND#3', 'brand#7') AND p_type LIKE 'sM%' AND p_name <> 'X'", own.schema(), None, own.folded))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY (o_orderstatus <> 'F') ORDER BY o_orderdate, o_orderkey) + CASE WHEN o_orderstatus <> 'F' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') ELSE 0 END AS rowid FROM orders")
def versioned_table(spark, sf_dir):
    """A table replaced, appended to and compacted; the row numbers of what is appended follow."""
    own, orders = catalog.TableCatalog(spark, new_path(spark, "catalog")), read(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    own.write("orders", rows.limit(3))
    own.write("orders", rows.where("o_orderstatus = 'F'"), "replace", order=["o_orderdate", "o_orderkey"])
    own.write("orders", rows.where("o_orderstatus <> 'F'"), "append", order=["o_orderdate", "o_orderkey"])
    return own.compact("orders").select("o_orderkey", "o_orderpriority", "rowid")


@query("""
SELECT row_number() OVER (ORDER BY s_suppkey) AS rowid, s_suppkey AS "Supplier_Key", s_name AS "Supplier_Name", round(abs(s_acctbal), 1) AS "Terms_Price_số", 'km' AS "Terms_Price_đơn vị",
       strftime(DATE '2020-02-28' + s_suppkey::INT, '%d/%m/%Y') AS "Terms_Since", month(DATE '2020-02-28' + s_suppkey::INT)::BIGINT AS "Terms_Since_tháng",
       upper(s_name) AS "Supplier_Name_upper", n_name AS nation, 'Terms' AS group_of_since
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey <= 60
""")
def ingested_book(spark, sf_dir):
    """Suppliers as a workbook with a title, two header rows, merged ranges and a footer, ingested with a scripted model to the end: groups, schema, parts of dates and quantities, a column asked row by row."""
    since = F.date_format(F.date_add(F.lit("2020-02-28").cast("date"), F.col("s_suppkey").cast("int")), "dd/MM/yyyy")
    price = F.concat(F.format_string("%.1f", F.abs("s_acctbal")), F.lit(" km"))
    rows = read(spark, sf_dir, "supplier").where("s_suppkey <= 60").orderBy("s_suppkey").select("s_suppkey", "s_name", price, since, "s_nationkey")
    folder = new_path(spark, "homes")
    book = f"{folder.removeprefix('file:').replace('///', '/')}.xlsx"
    lines = [["All suppliers", None, None, None, None], ["Supplier", None, "Terms", None, "Nation"], *_lines(["Key", "Name", "Price", "Since", "Key"], rows)]
    lines.append(["Total", None, None, None, None])
    xlsx.write_workbook(book, {"Suppliers": lines}, {"Suppliers": ["A1:E1", "A2:B2", "C2:D2", f"A{len(lines)}:E{len(lines)}"]})
    added = {"Supplier_Name": {"Supplier_Name_upper": "string"}, "Terms_Price": {"Terms_Price_số": "number", "Terms_Price_đơn vị": "string"}, "Terms_Since": {f"Terms_Since_{p}": "integer" for p in ("ngày", "tháng", "năm")}}
    model = OfflineModel({
        "edges": lambda rows, indices: json.dumps({"header": [1, 2], "footer": [indices[-1]]}),
        "groups": json.dumps([["Supplier_Key", "Supplier_Name", "Nation_Key"], ["Terms_Price", "Terms_Since"]]),
        "schema": lambda columns, types, examples: json.dumps({"properties": {n: k for c in columns for n, k in {c: types[c], **added.get(c, {})}.items()}}),
        "transform": lambda row, names: json.dumps({n: row["Supplier_Name"].upper() for n in names}),
    })
    own = catalog.TableCatalog(spark, folder)
    ingest(spark, own, book, model=model)
    facts = catalog.pivoted(own.tables["Suppliers__metadata"], ["group"])
    same = facts.where("entity = 'Terms_Since'").alias("a").join(facts.where("entity = 'Terms_Since_tháng'").alias("b"), F.col("a.group") == F.col("b.group")).select(F.lit("Terms").alias("group_of_since"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("Nation_Key"), F.col("n_name").alias("nation"))
    out = own.tables["Suppliers"].join(F.broadcast(nation), "Nation_Key").join(F.broadcast(same.limit(1)), F.lit(True))  # one row
    return out.select("rowid", "Supplier_Key", "Supplier_Name", "`Terms_Price_số`", "`Terms_Price_đơn vị`", "Terms_Since", "`Terms_Since_tháng`", "Supplier_Name_upper", "nation", "group_of_since")
