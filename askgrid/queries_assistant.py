"""Queries of the assistant with an offline model, each with its DuckDB statement over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators import search
from askgrid.plans.assist import Assistant, OfflineModel, execute, replay
from askgrid.queries import query, read
from askgrid.sources import catalog
from askgrid.sources.staging import new_path

_KEPT = ("nation", "region", "supplier", "part")


def _catalog(spark: SparkSession, sf_dir: str) -> catalog.TableCatalog:
    """Four tables with a value index of their names and kinds, and what routes a question to them."""
    own, embedder = catalog.TableCatalog(spark, new_path(spark, "catalog")), search.HashingEmbedder()
    for name in _KEPT:
        own.write(name, read(spark, sf_dir, name), fold=["n_name", "r_name", "p_brand", "p_type"])
    for name, columns in (("region", ["r_name"]), ("nation", ["n_name"]), ("part", ["p_brand", "p_type"])):
        own.write_index(name, search.embed_values(search.distinct_values(own.tables[name], name, columns), embedder))
    facts = [(n, a, v) for n, text, kind in (("nation", "nations and their regions", "sql"), ("part", "parts with brands and sizes", "sql"), ("manual", "how to return goods", "vector")) for a, v in (("summary", text), ("data_source", kind))]
    own.describe_tables(spark.createDataFrame(facts, catalog.EAV))
    return own


def _nations_of(question: str, ddl: str, schema: dict, samples: list) -> str:
    """SQL as a model writes it: a value in its own spelling, stars, the dialect's functions."""
    name = next((v for t, c, v in samples if c == "r_name" and v.lower() in question.lower()), "nowhere")
    return f"```sql\nSELECT r.*, count(*) AS n, GROUP_CONCAT(DISTINCT n_name) AS names, count(*) / 2 AS half FROM nation JOIN region r ON n_regionkey = r_regionkey WHERE r_name = '{name.title()}' GROUP BY r_regionkey, r_name\n```"


@query("""
SELECT 'Nations of ' || r_name || ', please' AS question, r_regionkey AS region, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) // 2 AS half, 'nation,region' AS tables, '1 rows' AS answer
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey
""")
def assistant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every region: rewriting, tables, values, columns, SQL, refinement, rows, answer."""
    own = _catalog(spark, sf_dir)
    model = OfflineModel({"choose": "nation, region, no table", "rewrite": lambda messages: messages[-1][1].replace("them", messages[0][1]), "sql": _nations_of})
    helper = Assistant(spark, own, model, index=own.index(), retry=True, answers=True)
    out = []
    for r in read(spark, sf_dir, "region").collect():  # five of them
        s = helper.search([("user", r["r_name"]), ("assistant", "yes?"), ("user", "Nations of them, please")])
        got = s.rows[0]
        out.append((s.question, got["r_regionkey"], got["n"], ",".join(sorted(got["names"].split(","))), got["half"], ",".join(sorted(s.linked)), s.message.split(":")[0]))
    return spark.createDataFrame(out, "question string, region int, n long, names string, half long, tables string, answer string")


_CASES = {
    "capped": "SELECT s_name AS v FROM supplier ORDER BY s_suppkey",
    "folded": "SELECT count(*) AS v FROM part WHERE p_brand IN ('BRAND#1', 'brand#2') AND p_type LIKE 'ECONOMY%'",
    "relaxed": "SELECT p_partkey AS v FROM part WHERE p_size > 1000 AND p_retailprice > 0 ORDER BY p_partkey LIMIT 3",
    "refused": "DROP TABLE part",
    "empty": "SELECT p_partkey AS v FROM part WHERE p_size > 1000",
    "quoted": 'SELECT max("n_name") AS v FROM "nation"',
}


@query("""
SELECT 'capped' AS name, least(count(*), 5) AS n, min(s_name) AS first, CASE WHEN count(*) > 5 THEN 'More rows than shown; please narrow the question.' END AS message FROM supplier
UNION ALL SELECT 'folded', 1, count(*)::VARCHAR, NULL FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#2') AND lower(p_type) LIKE 'economy%'
UNION ALL SELECT 'relaxed', 0, min(p_partkey)::VARCHAR, 'No rows; ' || count(*) || ' without: (p_size > 1000)' FROM part WHERE p_retailprice > 0
UNION ALL SELECT 'refused', 0, NULL, 'DropTable is not a query' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'empty', 0, NULL, NULL FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'quoted', 1, max(n_name), NULL FROM nation
UNION ALL SELECT 'follow_up', 0, NULL, 'Which of these is it about: nation, part, region, supplier?' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'route of ' || d, 0, d, NULL FROM (VALUES ('sql'), ('vector')) v(d)
UNION ALL SELECT 'one row', 1, min(n_name), NULL FROM nation
""")
def assistant_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assistant returns where a result is cut off, empty, relaxed or refused, and where it asks back or routes."""
    own = _catalog(spark, sf_dir)
    out = []
    for name, sql in _CASES.items():
        s = Assistant(spark, own, OfflineModel({"choose": "part, nation, supplier, region", "sql": sql})).search([("user", name)])
        rows = s.rows or ([r.asDict() for r in s.relaxed.rows.collect()] if s.relaxed else [])
        message = s.message or (s.error.replace("DropTableCommand", "DropTable") if s.error else None)
        out.append((name, len(s.rows), str(rows[0]["v"]) if rows else None, message))
    asking = Assistant(spark, own, OfflineModel({"choose": "nation, part, region, supplier"}), follow_up=True).search([("user", "everything")])
    out.append(("follow_up", len(asking.rows), None, asking.message))
    helper = Assistant(spark, own, OfflineModel())
    out += [(f"route of {d}", 0, helper.route(q, own.tables[catalog.HIDDEN]), None) for d, q in (("sql", "which brands of parts have large sizes"), ("vector", "how do I return goods"))]
    one = execute(spark, "SELECT n_name FROM nation ORDER BY n_name", fetch="one")["result"]
    out.append(("one row", len(one), one[0]["n_name"], None))
    return spark.createDataFrame(out, "name string, n int, first string, message string")


@query("""
SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS index, n_name AS asked, '[{"k": ' || n_nationkey || '}]' AS output, 'SELECT n_nationkey AS k FROM nation WHERE n_name = ''' || lower(n_name) || '''' AS sql
FROM nation WHERE n_regionkey = 0
""")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test samples asked ten at a time; the answers come back in the samples' order."""
    own = _catalog(spark, sf_dir)
    model = OfflineModel({"choose": "nation", "sql": lambda question, **_: f"SELECT n_nationkey AS k FROM nation WHERE n_name = '{question.lower()}'"})
    names = [r["n_name"] for r in read(spark, sf_dir, "nation").where("n_regionkey = 0").orderBy("n_nationkey").collect()]
    found = replay(Assistant(spark, own, model), [{"current_message": n, "conversation_history": []} for n in names])
    rows = [(a["index"], n, json.dumps(a["output"]["db_output"]), a["output"]["sql_query"]) for n, a in zip(names, found)]
    return spark.createDataFrame(rows, "index int, asked string, output string, sql string").where(F.col("output").isNotNull())
