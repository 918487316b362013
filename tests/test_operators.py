import json
import random
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askgrid.functions import metrics
from askgrid.operators import chatlog, columns, search, sheets
from askgrid.plans.assist import Assistant, OfflineModel, choice, cursor, execute, needs_follow_up, replay
from askgrid.sources import catalog, logs, xlsx
from askgrid.streaming import sessions

CELLS = "sheet string, r int, c int, v string"


def grid(spark, rows, sheet="s"):
    return spark.createDataFrame([(sheet, r, c, str(v)) for r, line in enumerate(rows, 1) for c, v in enumerate(line, 1) if v is not None], CELLS)


def found(frame):
    return sorted((r.start_row, r.start_col, r.num_cols, r.num_data_rows) for r in frame.collect())


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([["h", "i"], [1, 2], [3, 4], [5, 6]], [(1, 1, 2, 3)]),
        ([["h", "i"], [1, 2], [None], ["j", "k"], [3, 4]], [(1, 1, 2, 1), (4, 1, 2, 1)]),
        ([["a"], [1], ["x", "y", "z"], [1, 2, 3]], [(1, 1, 1, 1), (3, 1, 3, 1)]),
        ([[None]] * 3 + [[None, None, "h"], [None, None, 1]], [(4, 3, 1, 1)]),
        ([["only", "a", "header"]], []),
    ],
)
def test_tables_divided_by_blanks(spark, rows, wanted):
    assert found(sheets.detect_tables(grid(spark, rows))) == wanted


def test_typed_tables_extend(spark):
    rows = [["Title"], [1, "a"], [2, "b", 3.5], [3, None, 1], ["Total of all", 6]]
    assert (2, 1, 3, 3) in found(sheets.detect_typed_tables(grid(spark, rows)))


def test_headers_footers_rows_and_labels(spark):
    cells = grid(spark, [["Name", None], ["a", 1], ["b", 2], ["Total", 3]])
    tables = spark.createDataFrame([("s", 0, 2, 3, 1, 2, 1)], sheets.TABLES)
    row = sheets.header_and_footer(cells, tables).first()
    assert row.has_header and row.has_footer
    own = sheets.detect_tables(grid(spark, [["Name", "Price"], [" a ", None], ["b", 2]]))
    assert [r.cells for r in sheets.table_rows(grid(spark, [["Name", "Price"], [" a ", None], ["b", 2]]), own).orderBy("rowid").collect()] == [["a", None], ["b", "2"]]
    assert sheets.labels(cells, spark.createDataFrame([("s", 0, 1, 4, 1, 2, 3)], sheets.TABLES)).first().labels == ["Name", "Column 2"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=3))
def test_rendered_tables_are_detected(spark, shapes):
    rows, at, wanted = [], 1, []
    for n, width in shapes:
        rows += [["x"] * width] * (n + 1) + [[None]]
        wanted.append((at, 1, width, n))
        at += n + 2
    assert found(sheets.detect_tables(grid(spark, rows))) == wanted


def test_runs_and_snippets(spark):
    assert sorted((r.r, r.start, r.n) for r in sheets.filled_runs(grid(spark, [["a", "b", None, "c"]])).collect()) == [(1, 1, 2), (1, 4, 1)]
    rows = spark.range(1, 31).withColumnRenamed("id", "rowid")
    some = [r.rowid for r in sheets.snippet(rows, 3).collect()]
    assert len(some) == 9 and set(some) >= {1, 2, 3, 28, 29, 30} and sheets.snippet(rows.limit(9), 3).count() == 9
    assert json.loads(sheets.row_objects(rows).first().row) == {"rowid": 1}


SHEET = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData>{}</worksheet>'


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="Một" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Tên</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c><c r="D2" t="e"><v>#N/A</v></c></row>', '<mergeCells><mergeCell ref="A2:A4"/><mergeCell ref="C2:D3"/><mergeCell ref="A1:B1"/></mergeCells>'))
        z.writestr("xl/worksheets/sheet2.xml", SHEET.format('<row r="3"><c r="AB3"><v>7</v></c></row>', ""))


def test_spreadsheets(spark, tmp_path):
    workbook(tmp_path / "b.xlsx")
    spark.dataSource.register(xlsx.XlsxSource)
    cells = spark.read.format("xlsx").load(str(tmp_path / "b.xlsx"))
    assert sorted(map(tuple, cells.collect())) == [("Một", 1, 1, "Tên", "STRING"), ("Một", 1, 2, "rich", "STRING"), ("Một", 2, 1, "1.5", "NUMBER"), ("Một", 2, 2, "true", "BOOLEAN"), ("Một", 2, 3, "in", "STRING"), ("Two", 3, 28, "7", "NUMBER")]
    assert spark.read.format("xlsx").option("sheets", "Two").load(str(tmp_path / "b.xlsx")).count() == 1
    merges = spark.read.format("xlsx").option("relation", "merges").load(str(tmp_path / "b.xlsx"))
    assert {r.range_str: r.merge_type for r in merges.collect()} == {"A2:A4": "VERTICAL", "C2:D3": "BOTH", "A1:B1": "HORIZONTAL"}
    filled = {(r.r, r.c): r.v for r in sheets.fill_merged(cells.where("sheet = 'Một'"), merges).collect()}
    assert filled[(4, 1)] == "1.5" and filled[(3, 4)] == "in" and filled[(1, 2)] == "Tên"


def test_column_groups(spark):
    rows = spark.createDataFrame([("Địa chỉ: 12 Lê Lợi", "12 Lê Lợi", "x"), ("Địa chỉ: 5 Hai Bà Trưng", "5 Hai Bà Trưng", "y")], "a string, b string, c string")
    edges = [(r.left, r.right) for r in columns.related_columns(rows, ["a", "b", "c"]).where("related").collect()]
    assert edges == [("a", "b")]
    assert columns.rule_groups(["a", "b", "c"], edges, most=2) == [["a", "b"], ["c"]]
    assert columns.repaired(["a", "b", "c"], [["a", "zz"], ["a", "b"]]) == [["a"], ["b"], ["c"]]
    names = [f"c{i}" for i in range(14)]
    groups = columns.hybrid_groups(names, [[n] for n in names], [names[:7], names[7:]])
    assert sorted(c for g in groups for c in g) == sorted(names) and max(map(len, groups)) <= 10
    assert columns.hybrid_groups(names[:4], [], []) == [names[:4]]


def test_schemas_are_designed_validated_and_applied(spark):
    rows = spark.createDataFrame([("1", "TRUE", "2.5", "28/10/2025", "6.0 km"), ("2", "false", "x", None, "7 km")], "i string, b string, n string, d string, q string")
    assert columns.inferred_types(rows) == {"i": "integer", "b": "boolean", "n": "string", "d": "string", "q": "string"}
    asked = []

    def design(group):
        asked.append(tuple(group))
        properties = {c: {"type": {"i": "integer", "b": "boolean", "n": "number"}.get(c, "string")} for c in group}
        return {"properties": properties if len(asked) != 2 else {}}

    schema = columns.designed_schema([["i", "b"], ["n"]], design)
    assert asked == [("i", "b"), ("n",), ("n",)]
    out = columns.coerced(rows, schema).orderBy("i").collect()
    assert [tuple(r) for r in out] == [(1, 1, 2.5, []), (2, 0, None, ["n"])]
    with pytest.raises(ValueError, match="missing: n"):
        columns.designed_schema([["n"]], lambda g: {"properties": {}})
    assert columns.schema_errors(["Giá thuê"], {"properties": {"Giá thuê": {}, "Giá_thuê_số": {}, "other": {}}}) == ["names no column: other"]
    parts = columns.components(columns.components(rows, "d", "date"), "q", "quantity").first()
    assert (parts["d_ngày"], parts["d_tháng"], parts["d_năm"], parts["q_số"], parts["q_đơn vị"]) == (28, 10, 2025, 6.0, "km")
    assert columns.expanded_group(["Giá thuê"], ["Giá_thuê_số", "x"]) == ["Giá thuê", "Giá_thuê_số"]


def test_runs_of_equal_roles_keep_every_text(spark):
    turns = spark.createDataFrame([(1, 1, "u", "a"), (1, 2, "u", "b"), (1, 3, "u", "c"), (1, 4, "u", "c"), (1, 5, "a", "d")], "s int, t int, role string, text string")
    out = chatlog.merged_runs(turns, "s", ["t"], "role", "text").orderBy("run").collect()
    assert [(r.role, r.text) for r in out] == [("u", "a\nb\nc"), ("a", "d")]


def test_messages_are_normalised(spark):
    history = [("system", "x"), ("system", "y"), ("user", "q"), ("assistant", "1"), ("assistant", "2"), ("tool", "r")]
    row = spark.createDataFrame([(history,)], f"h {chatlog.HISTORY}").select(chatlog.normalised_messages(F.col("h")).alias("h")).first()
    assert [tuple(m) for m in row.h] == [("system", "x\ny"), ("user", "q"), ("assistant", "1\n2"), ("user", "<tool_response>\nr\n</tool_response>")]


def test_search_and_index(spark):
    table = spark.createDataFrame([(1, " Hà Nội "), (2, "Hà Nội"), (3, "Đà Nẵng"), (4, ""), (5, None)], "rowid long, city string")
    embedder = search.HashingEmbedder()
    index = search.embed_values(search.distinct_values(table, "t"), embedder)
    assert sorted(r.value for r in index.collect()) == ["Hà Nội", "Đà Nẵng"]
    assert search.extend_index(index, search.distinct_values(table, "t"), embedder).count() == 2
    best = search.similar_to_message("city: ha noi", index, embedder, 1).collect()
    assert [r.value for r in best] == ["Hà Nội"]
    kept = search.rerank(table, lambda rows: [r["rowid"] for r in rows if r["city"] and "Nội" in r["city"]] + [99])
    assert sorted(r.rowid for r in kept.collect()) == [1, 2]


@pytest.fixture
def tables(spark, tmp_path):
    own = catalog.TableCatalog(spark, str(tmp_path))
    rows = [(i, f"Quận {i % 3}", float(i), ["a", "b"]) for i in range(1, 13)]
    own.write("BĐS Bán 500", spark.createDataFrame(rows, "k long, `Quận/Huyện` string, `Diện tích (m²)` double, tags array<string>"), order=["k"])
    return own


def test_catalog(spark, tables):
    table = tables.tables["BĐS Bán 500"]
    assert sorted(r.rowid for r in table.collect()) == list(range(1, 13)) and table.first().tags == "a; b"
    assert tables.write("small", table, least_rows=20) is None
    with pytest.raises(FileExistsError):
        tables.write("BĐS Bán 500", table.drop("rowid"))
    tables.describe("BĐS Bán 500", spark.createDataFrame([("Quận/Huyện", "description", "old"), ("k", "group", "1"), ("tags", "group", "x")], catalog.EAV))
    tables.describe("BĐS Bán 500", spark.createDataFrame([("Quận/Huyện", "description", "district")], catalog.EAV))
    assert tables.names() == ["BĐS Bán 500"]
    ddl = tables.ddl("BĐS Bán 500", ["Quận/Huyện", "k"], {"Quận/Huyện": ["Quận 1"], "k": [1]}, comments=True)
    assert ddl == 'CREATE TABLE "BĐS Bán 500" (\n  "Quận/Huyện" TEXT -- district; Sample values: "Quận 1",\n  "k" INTEGER -- Sample values: 1\n)'
    assert [tuple(r) for r in catalog.column_groups(tables.tables["BĐS Bán 500__metadata"]).collect()] == [(1, ["k"])]
    with pytest.raises(ValueError):
        catalog.TableCatalog(spark, "/tmp/x", include=["a"], ignore=["b"])
    assert catalog.collapsed_columns([("Giá", "string"), ("giá", "double"), ("x", "string")]) == [("Giá", "double"), ("x", "string")]
    assert catalog.empty_like(spark, {"a": "integer", "A": "string"}).dtypes == [("a", "bigint")]
    assert spark.sql('SELECT count(*) FROM "BĐS Bán 500"').first()[0] == 12


def test_samples_spend_their_budget(spark):
    frame = spark.createDataFrame([(f"{i:03d}",) for i in range(100)] * 2, "v string")
    assert [r.value for r in catalog.samples(frame, "v", 10).collect()] == ["000", "001", "002", "003"]


def test_assistant(spark, tables):
    index = search.embed_values(search.distinct_values(tables.tables["BĐS Bán 500"], "BĐS Bán 500"), search.HashingEmbedder())
    helper = Assistant(spark, tables, OfflineModel(), index=index, retry=True)
    out = helper.respond([("user", "nhà ở quận 1")])
    assert out["error"] is None and {r["Quận/Huyện"] for r in out["db_output"]} == {"Quận 1"} and "lower" in out["executed_query"]
    empty = Assistant(spark, tables, OfflineModel({"sql": "```sql\nSELECT k FROM `BĐS Bán 500` WHERE `Quận/Huyện` = 'Quận 1' AND k > 900\n```"}))
    state = empty.search([("user", "q")])
    assert state.rows == [] and state.relaxed.count == 4 and "k > 900" in state.message
    many = Assistant(spark, tables, OfflineModel({"sql": "SELECT * FROM `BĐS Bán 500`"}), answers=True)
    assert len(many.search([("user", "q")]).rows) == 5
    bad = Assistant(spark, tables, OfflineModel({"sql": "DROP TABLE x"}))
    assert bad.respond([("user", "q")])["error"]
    assert execute(spark, "SELECT nothing FROM nowhere")["result"] == []
    assert execute(spark, "SELECT k FROM `BĐS Bán 500` WHERE k > :least ORDER BY k", args={"least": 3}, fetch="one")["result"] == [{"k": 4}]
    assert len(list(cursor(spark, "SELECT * FROM `BĐS Bán 500`;"))) == 12
    got = replay(helper, [{"current_message": "quận 2"}, {"current_message": "quận 0", "conversation_history": [{"role": "user", "content": "x"}]}], 2)
    assert [r["index"] for r in got] == [0, 1] and all(r["output"] for r in got)
    assert needs_follow_up([]) and not needs_follow_up(["a"])


def test_routing(spark, tables):
    metadata = spark.createDataFrame([("homes", "summary", "homes for sale with prices"), ("homes", "data_source", "sql"), ("faq", "summary", "questions about policy"), ("faq", "data_source", "vector")], catalog.EAV)
    helper = Assistant(spark, tables, OfflineModel())
    assert helper.route("prices of homes", metadata) == "sql" and helper.route("what is the policy", metadata) == "vector"
    assert choice("none of these") == "none" and choice("?") == "vector"


def test_logs(spark, tmp_path):
    line = {"sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "tags": ["t"], "input": "q", "output": "{}", "metadata": {"history": json.dumps([{"role": "user", "content": "h"}])}}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(line), "broken {", json.dumps({**line, "tags": [], "metadata": None})]))
    rows = logs.traces(spark, str(tmp_path / "log.jsonl")).collect()
    assert len(rows) == 2 and logs.traces(spark, str(tmp_path / "log.jsonl"), "t").first().conversation_history[0].content == "h"
    logs.export(spark.range(3).toDF("x"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        logs.export(spark.range(1), "x", "xls")


def test_streams_equal_tables(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make in (("counts", sessions.windowed_counts), ("visits", sessions.sessions)):
        running = make(stream).writeStream.outputMode("complete" if name == "counts" else "append").format("memory").queryName(name).start()
        running.processAllAvailable()
        running.stop()
        got = spark.table(name)
        wanted = make(events)
        if name == "counts":
            assert got.exceptAll(wanted).count() == wanted.exceptAll(got).count() == 0
        else:  # the last sessions stay open until the watermark passes them
            assert got.exceptAll(wanted).count() == 0


def test_blocks_of_queries_find_the_same_neighbours(spark, sf, monkeypatch):
    index = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    wanted = index.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = []
    for block in (512, 7):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "ROW_BLOCK", 60)
        found.append(sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.nearest(wanted, index, 4, [], "vec_id", leave_self=True).collect()))
    assert found[0] == found[1] and len(found[0]) == 4 * wanted.count()


def test_settings(tmp_path):
    from askgrid.session import settings

    (tmp_path / "env").write_text("# note\nexport A='x y'\nB=1=2\n\n")
    assert settings(str(tmp_path / "env")) == {"A": "x y", "B": "1=2"}


@pytest.mark.parametrize("table, order", [("orders", ["o_orderdate"]), ("lineitem", ["l_shipdate", "l_orderkey"]), ("lineitem", ["l_returnflag"])])
def test_row_numbers_lose_no_row_of_whole_tables(spark, table, order):
    rows = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").repartition(7)
    numbered = catalog.dense_rowid(rows, order)
    n = rows.count()
    assert tuple(numbered.selectExpr("count(*)", "count(distinct rowid)", "min(rowid)", "max(rowid)").first()) == (n, n, 1, n)
    assert numbered.drop("rowid").exceptAll(rows).count() == 0
    keys = [tuple(r) for r in numbered.orderBy("rowid").select(*order).collect()]
    assert keys == sorted(keys)


def test_execution_match_sees_every_row(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    got = metrics.execution_match(orders, orders.repartition(5), ["o_orderkey"], ["o_orderkey"]).first()
    assert (got.left_rows, got.right_rows, got.correct) == (15000, 15000, True)
    other = orders.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") == 7, 1).otherwise(0)).drop("o_orderpriority")
    got = metrics.execution_match(orders, other, ["o_orderkey"], ["o_orderkey"]).first()
    assert (got.matched, got.correct) == (4, False)


def test_a_workbook_becomes_typed_tables_that_a_new_catalog_finds(spark, tmp_path):
    import datetime

    from askgrid.plans.ingest import ingest

    day, at = datetime.date(2024, 2, 29), datetime.datetime(2023, 12, 31, 18, 30)
    rows = [["Name", "Day", "At", "Price", "Open"], ["a", day, at, 1.5, True], ["b", day, at, 2, False], ["c", None, None, "x", True]]
    book = str(tmp_path / "book.xlsx")
    xlsx.write_workbook(book, {"Homes": [[None], [None, *rows[0]], *[[None, *r] for r in rows[1:]]], "Two": [["k"], [1], [2], [], ["k", "K"], ["3", "x"]]}, {"Two": ["A2:A3"]})
    own = catalog.TableCatalog(spark, str(tmp_path / "tables"))
    assert ingest(spark, own, book) == ["Homes", "Two 1", "Two 2"]
    again = catalog.TableCatalog(spark, str(tmp_path / "tables"))
    assert again.names() == ["Homes", "Two 1", "Two 2"]
    got = again.tables["Homes"].orderBy("rowid")
    assert dict(got.dtypes) == {"rowid": "bigint", "Name": "string", "Day": "string", "At": "string", "Price": "string", "Open": "bigint"}
    assert tuple(got.first()) == (1, "a", "2024-02-29", "2023-12-31 18:30:00", "1.5", 1)
    assert [r.k for r in again.tables["Two 1"].orderBy("rowid").collect()] == [1, 1] and again.tables["Two 2"].columns == ["rowid", "k", "K_2"]
    assert again.tables["Homes__metadata"].where("entity = 'Open' and attribute = 'type'").first().value == "boolean"
    assert again.tables["tables_metadata"].where("attribute = 'data_source'").count() == 3
    logs.export(again.tables["Homes"].orderBy("rowid"), str(tmp_path / "out.xlsx"), "xlsx", footer=[["Total", None, 2]])
    spark.dataSource.register(xlsx.XlsxSource)
    assert spark.read.format("xlsx").load(str(tmp_path / "out.xlsx")).where("r = 5").orderBy("c").select("v").collect()[0].v == "Total"
    assert {r.sheet for r in spark.read.format("xlsx").load(str(tmp_path)).select("sheet").distinct().collect()} == {"book/Homes", "book/Two", "out/Sheet1"}


def test_only_fitting_rows_are_appended(spark, tmp_path):
    own = catalog.TableCatalog(spark, str(tmp_path))
    own.write("t", spark.range(3), order=["id"])
    with pytest.raises(FileExistsError):
        own.write("t", spark.range(3))
    with pytest.raises(ValueError):
        own.write("t", spark.createDataFrame([("x",)], "name string"), "append")
    own.write("t", spark.range(3, 5), "append", order=["id"])
    assert sorted(map(tuple, own.tables["t"].collect())) == [(k, k + 1) for k in range(5)]
    own.write("t", own.tables["t"].where("id > 3"), "replace")
    assert own.tables["t"].count() == 1
    own.write("twins", spark.createDataFrame([("1", 2.0)], "a string, b double").toDF("x", "X"))
    assert own.tables["twins"].dtypes == [("x", "double")]
    index = spark.createDataFrame([("t", "c", "v", [1.0, 2.0]), ("t", "c", None, [1.0, 2.0]), ("t", "c", "w", None)], search.INDEX)
    own.write_index("t", index)
    assert [r.value for r in catalog.TableCatalog(spark, str(tmp_path)).index().collect()] == ["v"] and "t__index" not in own.names()


def test_rows_are_transformed_or_kept(spark):
    def tidy(row):
        if row["a"] == "bad":
            return {"other": 1}
        return {"a": row["a"].upper()}

    rows = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "rowid long, a string")
    got = sorted(tuple(r) for r in columns.transformed(rows, ["a"], tidy).collect())
    assert got == [(1, "X", []), (2, "bad", ["a"]), (3, "Y", [])]


def test_a_models_answers_about_tables_are_checked(spark):
    from askgrid.plans import ingest

    model = OfflineModel({"edges": '```json\n{"header": [0, 9], "footer": [0, 2, "x"]}\n```', "labels": '["p", "q"]', "groups": '[["b", "a"], ["zz"]]'})
    assert ingest.header_and_footer(model, [["a"], ["1"], ["Total"]]) == ([0], [2])
    assert ingest.generated_labels(model, [], ["Column 1", "Column 2"]) == ["p", "q"] and ingest.generated_labels(model, [], ["only"]) == ["only"]
    frame = spark.createDataFrame([("abcdefg", "abcdefg", "1")], "a string, b string, c string")
    assert ingest.grouped(frame, ["a", "b", "c"], model) == [["a", "b", "c"]] and ingest.header_and_footer(OfflineModel({"edges": "no idea"}), [["a"]]) == ([], [])


def test_json_arrays_come_back(spark, tmp_path):
    logs.write_json(spark.range(7).selectExpr("id", "concat('t\"', id) AS t"), str(tmp_path / "j"))
    assert sorted(map(tuple, logs.read_json(spark, str(tmp_path / "j"), "id long, t string").collect())) == [(k, f't"{k}') for k in range(7)]


def test_nearest_is_alike_in_one_and_in_many_blocks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.unionByName(spark.createDataFrame([(9001, 1, None), (9050, 1, [1.0, 2.0]), (9051, 1, [2.0, 1.0]), (9052, 2, [1.0, 2.0]), (9003, 1, [0.0] * 64), (9100, 1, [float("nan")] * 64), (9101, 1, [float("inf")] + [0.0] * 63), (9150, 1, []), (9200, 1, [None, 1.0])], "vec_id long, label int, embedding array<float>"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    for keys, k, least in ((["label"], 3, None), ([], 4, None), ([], None, 0.3)):
        got = []
        for most in (8192, 0):
            monkeypatch.setattr(search, "MOST_QUERIES", most)
            found = search.nearest(asked, rows, k, keys, "vec_id", least=least, leave_self=True)
            got.append(sorted((r.query_id, r.vec_id, r.score) for r in found.collect()))
        assert got[0] == got[1] and len(got[0]) > 20
        assert {q for q, _, _ in got[0] if q > 9000} == {9050} and {v for q, v, _ in got[0] if q == 9050} <= {9051, 9052}
        assert not {9001, 9100, 9101, 9150, 9200} & {v for _, v, _ in got[0]}


@pytest.mark.parametrize("n, width, asked", [(10_000, 64, 600), (2_500, 2_048, 40)])
def test_scores_held_at_once_are_bounded(n, width, asked):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rows = np.random.default_rng(5).standard_normal((n, width)).astype(np.float32)
    wanted = np.divide(rows[:asked], np.linalg.norm(rows[:asked].astype(float), axis=1, keepdims=True))
    lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, x.reshape(-1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), lists(rows)], ["vec_id", "embedding"])
    table = pa.table({"query_id": pa.array(range(asked)), "_q": lists(wanted)})
    best = search._best_of_batches(table, "query_id", [], [], "vec_id", 3, None, True)
    tracemalloc.start()
    found: dict[int, list] = {}
    for out in best(iter([batch])):
        for v, q, score in zip(*(out[c].to_pylist() for c in ("vec_id", "query_id", "score"))):
            found.setdefault(q, []).append((-score, v))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    scores = wanted @ (rows / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)).T
    np.fill_diagonal(scores, -np.inf)
    assert [[v for _, v in sorted(found[q])[:3]] for q in range(asked)] == np.argsort(-scores, axis=1)[:, :3].tolist()


def test_blocks_of_many_queries_are_multiplied_and_lose_nothing(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").where("vec_id < 300")
    rows = rows.unionByName(spark.createDataFrame([(9050, 1, [1.0, 2.0]), (9051, 1, [2.0, 1.0]), (9052, 2, [1.0, 2.0])], "vec_id long, label int, embedding array<float>"))
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    asked = asked.unionByName(asked.where("query_id < 20").withColumn("label", (F.col("label") + 1) % 10))  # an id that asks in two groups
    for keys, k, least in ((["label"], 3, None), ([], 4, None), ([], None, 0.3)):
        got = []
        for blocks in (False, True):
            if blocks:  # few components at once, so that even these queries are joined in blocks
                monkeypatch.setattr(search, "CELLS", 700, raising=False)
                monkeypatch.setattr(search, "ASKED_BLOCK", 9, raising=False)
                monkeypatch.setattr(search, "ROW_BLOCK", 70)
            found = search.nearest(asked, rows, k, keys, "vec_id", least=least, leave_self=True)
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "MapInArrow" in plan and "zip_with" not in plan.partition("MapInArrow")[0] and ("Join" in plan) == blocks
            got.append(sorted((r.query_id, r.vec_id, r.score) for r in found.collect()))
        assert got[0] == got[1] and len(got[0]) > 60
        monkeypatch.undo()


def test_longest_common_blocks_of_any_length():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abAB") for _ in range(rng.randint(0, 30))) for _ in range(2))
        low = [b.lower()[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1)]
        assert columns.common_length(a, b) == max([len(x) for x in low if x in a.lower()], default=0)
    shared = "xyzzy " * 60
    assert columns.common_length("p q " * 200 + shared, "r s t-" * 3000 + shared) == 360


def test_columns_of_long_texts_are_related_without_python(spark):
    shared = "".join(chr(97 + k % 7) for k in range(360))
    long = ["".join(chr(0x4E00 + (k * k * n) % 900) for k in range(20_000)) for n in (7, 11)]
    rows = spark.createDataFrame(
        [(long[0] + shared, shared.upper() + long[1], " x" * 5000, "\U00010000abcd", "\U00010400abcd"), ("Plain Text", "ain tex", "no", None, "x"), (" ", "z", "zzzzzz", "\U00010000abcd", None)],
        "a string, b string, `c d` string, e string, f string",
    )
    found = columns.related_columns(rows, rows.columns)
    assert {(r.left, r.right) for r in found.where("related").collect()} == {("a", "b")} and found.count() == 10
    assert columns.related_columns(rows.where("false"), ["a", "b"]).collect()[0].related is False
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_bucketed_tables_leave_no_names(spark):
    from askgrid.sources import staging

    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("ag_")}
    before = names()
    a, b = (staging.bucketed(spark.range(9), "units", "id", 2) for _ in range(2))
    assert len(names() - before) == 2 and a.count() == 9
    staging.forget(a)
    assert len(names() - before) == 1 and b.count() == 9
    staging.sweep(spark)
    assert names() == before


def test_readers_and_writers_of_versions(spark, tmp_path):
    one, two = catalog.TableCatalog(spark, str(tmp_path)), catalog.TableCatalog(spark, str(tmp_path))
    one.write("t", spark.range(3), order=["id"])
    pinned = one.tables["t"]
    two.write("t", spark.range(10, 14), "replace", order=["id"])
    assert pinned.count() == 3 and two.tables["t"].count() == 4 and one.refresh("t").count() == 4
    # Another writer commits between this one's look at the table and its own commit.
    real = one._commit
    one._commit = lambda *given: (two.write("t", spark.range(20, 22), "append", order=["id"]), real(*given))
    with pytest.raises(catalog.Conflict):
        one.write("t", spark.range(30, 33), "append", order=["id"])
    one._commit = real
    one.write("t", spark.range(30, 33), "append", order=["id"])
    rows = sorted(map(tuple, catalog.TableCatalog(spark, str(tmp_path)).tables["t"].collect()))
    assert [r[1] for r in rows] == list(range(1, 10)) and len({r[0] for r in rows}) == 9
    # A crash after the rows, before the version: nobody sees them.
    one._commit = lambda *given: 1 / 0
    with pytest.raises(ZeroDivisionError):
        one.write("u", spark.range(3))
    with pytest.raises(ZeroDivisionError):
        one.write("t", spark.range(3), "replace")
    one._commit = real
    again = catalog.TableCatalog(spark, str(tmp_path))
    assert again.names() == ["t"] and again.tables["t"].count() == 9
    assert sorted(map(tuple, again.compact("t").collect())) == rows
    again.vacuum("t")
    assert len([x for x in (tmp_path / one.path("t").rsplit("/", 1)[1]).iterdir() if x.name.startswith("rows-")]) == 1
    assert sorted(map(tuple, catalog.TableCatalog(spark, str(tmp_path)).tables["t"].collect())) == rows


def test_metadata_of_two_writers_are_merged(spark, tmp_path):
    one, two = catalog.TableCatalog(spark, str(tmp_path)), catalog.TableCatalog(spark, str(tmp_path))
    facts = lambda *rows: spark.createDataFrame(list(rows), catalog.EAV)
    real, calls = one._commit, []

    def raced(*given):
        if not calls:
            calls.append(1)
            two.describe("t", facts(("a", "description", "theirs"), ("b", "description", "theirs")))
        return real(*given)

    one._commit = raced
    one.describe("t", facts(("a", "description", "ours"), ("c", "description", "ours")))
    assert sorted((r.entity, r.value) for r in one.tables["t__metadata"].collect()) == [("a", "ours"), ("b", "theirs"), ("c", "ours")]


def test_folded_predicates_reach_the_scan(spark, tmp_path):
    from askgrid.plans.rewrite import refined

    rows = spark.range(40_000).selectExpr("id", "concat('Name ', id % 20000 * 2) AS name", "if(id % 3 = 0, 'NORTH', 'South') AS `the side`")
    own = catalog.TableCatalog(spark, str(tmp_path))
    own.write("Homes", rows, fold=["name", "the side"])
    other = spark.createDataFrame([(1, "x")], "id long, note string")
    own.write("notes", other)
    again = catalog.TableCatalog(spark, str(tmp_path))
    assert again.tables["Homes"].columns == ["id", "name", "the side"] and again.names() == ["Homes", "notes"] and list(again.schema()["Homes"]) == ["id", "name", "the side"]

    def both(sql):
        fast, slow = (spark.sql(refined(spark, sql, again.schema(), None, low)) for low in (again.folded, None))
        assert fast.columns == slow.columns and sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())), sql
        return fast

    scan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = both("SELECT * FROM Homes WHERE name = 'NAME 6'")
    assert one.count() == 2 and "EqualTo(_ag_low_name,name 6)" in scan(one)
    assert "In(_ag_low_name, [name 4,name 8])" in scan(both("SELECT h.id FROM homes h WHERE h.name IN ('NAME 4', 'Name 8') ORDER BY h.id"))
    assert "StringStartsWith(`_ag_low_the side`,nor)" in scan(both("SELECT count(*) AS n FROM Homes WHERE `the side` LIKE 'NOR%' AND name <> 'x'"))
    both("SELECT h.*, n.note FROM Homes h JOIN notes n ON h.id = n.id WHERE 'south' = h.`the side` AND n.note = 'X'")
    both("SELECT * FROM Homes h, notes WHERE h.id = notes.id AND h.name LIKE '%2'")
    both("SELECT id FROM notes n WHERE EXISTS (SELECT * FROM Homes WHERE Homes.id = n.id AND name = 'name 2')")
    both("WITH a AS (SELECT * FROM Homes WHERE name = 'name 2') SELECT a.* FROM a UNION ALL SELECT * FROM Homes WHERE `the side` = 'x'")
    both("WITH homes AS (SELECT 1 AS id, 'A' AS name) SELECT * FROM homes WHERE name = 'a'")
    # A value that the bloom filter doesn't have, between the least and the greatest: no row group is read.
    none = both("SELECT id FROM Homes WHERE name = 'Name 3333'")
    plan = none._jdf.queryExecution().executedPlan()
    reads = lambda p: [p] if "Scan" in p.nodeName() else [x for k in range(p.children().size()) for x in reads(p.children().apply(k))]
    none.collect()
    assert [reads(plan)[0].metrics().apply("numOutputRows").value()] == [0]
    own.write("Homes", rows.limit(1), "append")
    assert again.refresh("Homes").count() == 40_001


def test_ten_rows_are_asked_at_once_and_never_more(spark):
    import asyncio

    state = {"now": 0, "most": 0, "calls": 0}

    async def slow(row):
        state["now"] += 1
        state["calls"] += 1
        state["most"] = max(state["most"], state["now"])
        try:
            await asyncio.sleep(0.02)
            if row["k"] == "13" or row["k"] == "7" and state["calls"] < 20:
                raise ConnectionError(row["k"])
            return {"x": row["k"] + "!", "most": state["most"]}
        finally:
            state["now"] -= 1

    rows = spark.range(40).selectExpr("id AS k", "'keep' AS other").coalesce(1)
    got = columns.transformed(rows, ["x", "most"], slow, given=["k"]).collect()
    assert [r.k for r in got] == list(range(40)) and {r.other for r in got} == {"keep"}
    assert [r.x for r in got] == [None if k == 13 else f"{k}!" for k in range(40)]
    assert [r.k for r in got if r.errors] == [13] and got[13].errors == ["x", "most"]
    assert max(int(r.most) for r in got if r.most) == 10
    assert columns.transformed(rows.where("k < 0"), ["x"], slow, given=["k"]).collect() == []


def test_a_whole_ingest(spark, tmp_path):
    from askgrid.plans.ingest import ingest

    book = str(tmp_path / "homes.xlsx")
    head = [["Homes for sale", None, None, None], ["Home", None, "Terms", None], ["No", "Area", "Price", "Since"]]
    data = [[1, "70 ha", "1.5 bn", "28/02/2020"], [2, "80.5 ha", "on request", "01/03/2021"], [3, "90 ha", "2 bn", "x"]]
    xlsx.write_workbook(book, {"Homes": [*head, *data, ["Note: prices of May", None, None, None]]}, {"Homes": ["A1:D1", "A2:B2", "C2:D2", "A7:D7"]})

    def schema(columns, types, examples):
        own = {c: {"type": types[c], "description": f"the {c}"} for c in columns}
        if "Home_Area" in own:
            own |= {"Home_Area_số": {"type": "number"}, "Home_Area_đơn vị": {"type": "string"}}
        if "Terms_Since" in own:
            own |= {f"Terms_Since_{p}": {"type": "integer"} for p in ("ngày", "tháng", "năm")}
        if "Terms_Price" in own:
            own["Terms_Price_bn"] = {"type": "number"}
        return json.dumps({"properties": own})

    def transform(row, names):
        return json.dumps({"Terms_Price_bn": row["Terms_Price"].removesuffix(" bn")}) if row["Terms_Price"].endswith("bn") else "no idea"

    seen = []
    model = OfflineModel({"edges": lambda rows, indices: seen.append(indices) or '{"header": [1, 2], "footer": [6]}', "groups": '[["Home_No", "Home_Area"], ["Terms_Price", "Terms_Since"]]', "schema": schema, "transform": transform})
    own = catalog.TableCatalog(spark, str(tmp_path / "tables"))
    assert ingest(spark, own, book, model=model) == ["Homes"] and seen == [[0, 1, 2, 3, 4, 5, 6]]
    got = own.tables["Homes"].orderBy("rowid").collect()
    assert [r["Home_No"] for r in got] == [1, 2, 3] and [r["Home_Area_số"] for r in got] == [70.0, 80.5, 90.0] and got[0]["Home_Area_đơn vị"] == "ha"
    assert [(r["Terms_Since_ngày"], r["Terms_Since_năm"]) for r in got] == [(28, 2020), (1, 2021), (None, None)] and [r["Terms_Price_bn"] for r in got] == [1.5, None, 2.0]
    facts = {(r.entity, r.attribute): r.value for r in own.tables["Homes__metadata"].collect()}
    assert facts["Terms_Price_bn", "unfit"] == "1" and facts["Terms_Price_bn", "group"] == facts["Terms_Price", "group"] and facts["Home_No", "description"] == "the Home_No"
    # Without a model, by types: the title and both header rows are above the row that is the header.
    own = catalog.TableCatalog(spark, str(tmp_path / "typed"))
    assert ingest(spark, own, book, typed=True) == ["Homes 1", "Homes 2"] or own.names()
    # A model that says nothing of use changes nothing.
    plain, idle = (catalog.TableCatalog(spark, str(tmp_path / x)) for x in ("plain", "idle"))
    ingest(spark, plain, book)
    ingest(spark, idle, book, model=OfflineModel())
    assert plain.tables["Homes"].exceptAll(idle.tables["Homes"]).count() == 0 and plain.tables["Homes"].count() == 6


def test_tasks_write_the_parts_of_a_workbook(spark, tmp_path):
    import datetime

    path = str(tmp_path / "deep" / "out.xlsx")
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, concat('<', id, '&')) AS text", "id % 2 = 0 AS even", "date_add(DATE '2024-01-01', cast(id AS int)) AS day", "id / 8 AS x").orderBy(F.desc("id"))
    spark.dataSource.register(xlsx.XlsxSource)
    logs.export(rows.repartitionByRange(7, F.desc("id")).sortWithinPartitions(F.desc("id")), path, "xlsx", footer=[["Total", None, 2000]])
    cells = {(c.r, c.c): c.v for c in spark.read.format("xlsx").load(path).collect()}
    assert [cells[1, k] for k in range(1, 6)] == ["id", "text", "even", "day", "x"] and cells[2002, 1] == "Total" and cells[2002, 3] == "2000" and (2002, 2) not in cells
    for k in range(2000):
        i = 1999 - k
        day = str(datetime.date(2024, 1, 1) + datetime.timedelta(i))
        assert tuple(cells.get((k + 2, c)) for c in range(1, 6)) == (str(i), None if i % 3 == 0 else f"<{i}&", "true" if i % 2 == 0 else "false", day, repr(i / 8))
    assert [x.name for x in (tmp_path / "deep").iterdir() if not x.name.startswith(".")] == ["out.xlsx"]
    # A task that fails leaves neither a workbook nor parts, and an older workbook as it was.
    before = (tmp_path / "deep" / "out.xlsx").read_bytes()
    with pytest.raises(Exception):
        rows.selectExpr("id", "assert_true(id <> 77) AS t").write.format("xlsx").mode("overwrite").save(path)
    assert (tmp_path / "deep" / "out.xlsx").read_bytes() == before and len(list((tmp_path / "deep").iterdir())) == 1
    with pytest.raises(Exception):
        rows.write.format("xlsx").mode("append").save(path)
    logs.export(rows.where("id < 0"), path, "xlsx", header=False)
    assert spark.read.format("xlsx").load(path).count() == 0
