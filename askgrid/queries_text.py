"""Queries of the text functions, the dialect and relaxation, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.functions import metrics, text
from askgrid.operators import chatlog
from askgrid.plans import relax
from askgrid.plans.guard import checked
from askgrid.queries import folded, query, read, same

_RAW = "SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN ' ' ELSE ' ' || p_name || ': <' || p_type || '>/?*' || chr(9) || 'É' END AS raw FROM part"


@query(
    r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(raw, '[\x00-\x1f<>:"/\\|?*]+', '_', 'g')), ''), 'unnamed') AS file, regexp_replace(raw, '[^\p{L}\p{Nd} ._-]', '', 'g') AS sheet,"""
    f" coalesce(raw, '') AS plain, lower(raw) AS low, p_brand || '_' || p_type AS header, nullif(trim(raw), '') AS cell FROM ({_RAW})"
)
def names_of_files_and_columns(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    raw = F.col("raw")
    header = text.flat_header(F.array("p_brand", F.lit(" "), F.lit(None).cast("string"), "p_type"))
    rows = spark.sql(_RAW)
    return rows.select("p_partkey", text.safe_filename(raw).alias("file"), text.sheet_filename(raw).alias("sheet"), text.normalised(raw).alias("plain"), text.lower_any(raw).alias("low"), header.alias("header"), F.nullif(F.trim(raw), F.lit("")).alias("cell"))


@query(
    r"""SELECT conv_id, turn, '{"choice": "' || kind || '"}' AS json, 'SELECT ' || conv_id AS sql, CASE WHEN kind = 'elsewhere' THEN 'sql' ELSE lower(kind) END AS choice,"""
    r""" 'find' AS first_name, '{"k":' || turn || '}' AS first_arguments, 2 AS calls, md5(regexp_replace(text, '^[\t\n\v\f\r ]+|[\t\n\v\f\r ]+$', '', 'g')) AS plain"""
    " FROM (SELECT *, CASE turn % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'vector' WHEN 2 THEN 'none' ELSE 'elsewhere' END AS kind FROM conversations)"
)
def parts_of_model_answers(spark, sf_dir):
    """Answers are written around each turn, then taken apart again."""
    kind = F.when(F.col("turn") % 4 == 0, "SQL").when(F.col("turn") % 4 == 1, "vector").when(F.col("turn") % 4 == 2, "none").otherwise("elsewhere")
    call = lambda name, n: F.concat(F.lit(f'<tool_call>\n{{"name": "{name}", "arguments": {{"k": '), n, F.lit("}}\n</tool_call>\n"))
    said = F.concat(F.lit('```json\n{"choice": "'), kind, F.lit('"}\n```\n```sql\nSELECT 0\n```\n```sql\nSELECT '), "conv_id", F.lit("\n```\n"), call("find", F.col("turn")), call("show", F.col("conv_id")))
    rows = read(spark, sf_dir, "conversations").withColumn("said", said)
    first = text.tool_call(F.col("said"))
    plain = F.md5(text.without_reasoning(F.concat(F.lit("<think>a\nb</think>"), "text")))
    return rows.select("conv_id", "turn", text.json_block(F.col("said")).alias("json"), text.sql_block(F.col("said")).alias("sql"), text.route_choice(F.col("said")).alias("choice"), first["name"].alias("first_name"), first["arguments"].alias("first_arguments"), F.size(text.tool_calls(F.col("said"))).alias("calls"), plain.alias("plain"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%A, %B ') || d || CASE WHEN d IN (11, 12, 13) THEN 'th' WHEN d % 10 = 1 THEN 'st' WHEN d % 10 = 2 THEN 'nd' WHEN d % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(o_orderdate, ', %Y') AS english,"
    " ['Chủ Nhật', 'Thứ Hai', 'Thứ Ba', 'Thứ Tư', 'Thứ Năm', 'Thứ Sáu', 'Thứ Bảy'][dayofweek(o_orderdate) + 1] || ', ngày ' || d || ' tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) AS vietnamese FROM (SELECT *, day(o_orderdate) AS d FROM orders)"
)
def spoken_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.english_date(F.col("o_orderdate")).alias("english"), text.vietnamese_date(F.col("o_orderdate")).alias("vietnamese"))


@query("SELECT p_partkey, 'select ' || lower(p_name) || ' from t' AS sql FROM part")
def normal_sql(spark, sf_dir):
    said = F.concat(F.lit("\n SELECT   "), "p_name", F.lit("\n\tFROM t ;  "))
    return read(spark, sf_dir, "part").select("p_partkey", text.normal_sql(said).alias("sql"))


@query(r"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, '|')) AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '([\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|[\t\n\v\f\r ]+|[^\t\n\v\f\r ])', 1) AS t FROM documents)")
def human_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens"))


@query("SELECT p_partkey, p_name AS \"Answer\", p_type AS \"Reason\", NULL::VARCHAR AS \"Source\" FROM part")
def sections_of_answers(spark, sf_dir):
    said = F.concat(F.lit("Answer: "), "p_name", F.lit("\nReason:\n"), "p_type", F.lit("\n"))
    return read(spark, sf_dir, "part").select("p_partkey", text.sections(said, ["Answer", "Reason", "Source"]).alias("s")).select("p_partkey", "s.*")


@query("SELECT doc_id, round((q / 5.0::DOUBLE * 2 + quality + toxic) / 4 * 5, 6) AS score, (q / 5.0::DOUBLE * 2 + quality + toxic) / 4 * 5 >= 3.5 AS related FROM (SELECT *, doc_id % 6 AS q FROM labels)")
def question_relatedness(spark, sf_dir):
    score = text.relatedness(F.col("doc_id") % 6, F.col("quality"), F.col("toxic"))
    return read(spark, sf_dir, "labels").select("doc_id", F.round(score, 6).alias("score"), (score >= 3.5).alias("related"))


@query("SELECT conv_id, string_agg(said, chr(10) ORDER BY turn) AS messages FROM (SELECT conv_id, turn, CASE WHEN role = 'system' AND turn > 0 THEN 'user:<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' ELSE role || ':' || text END AS said FROM conversations) GROUP BY conv_id")
def tool_answers_as_messages(spark, sf_dir):
    """Later system turns stand for answers of tools."""
    role = F.when((F.col("role") == "system") & (F.col("turn") > 0), "tool").otherwise(F.col("role"))
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), "text"))).alias("all"))
    history = chatlog.normalised_messages(F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))))
    return turns.select("conv_id", F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("messages"))


@query("SELECT event_id, user_id FROM events ORDER BY md5('42-' || event_id), event_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return chatlog.sampled(read(spark, sf_dir, "events"), 100, "event_id").select("event_id", "user_id")


@query("SELECT count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events")
def request_totals(spark, sf_dir):
    out = metrics.request_totals(read(spark, sf_dir, "events"), "value", F.col("event_type") != "error")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#3'")
def bound_parameters(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    own, _ = checked(spark, "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN :low AND :high AND p_brand = :brand;")
    return spark.sql(own, args={"low": 10, "high": 20, "brand": "Brand#3"})


same("null_checks", "SELECT c.c_custkey, CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END AS idle FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE c.c_name IS NOT NULL AND (o.o_orderkey IS NULL OR o.o_orderpriority IS NOT NULL)")
same("concatenated", "SELECT s_suppkey, s_name || ' (' || n_name || ')' AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
same("quoted_names", 'SELECT "p_brand" AS "the brand", count(*) AS "how many" FROM "part" GROUP BY "p_brand"')
folded("dialect_bool_max", "SELECT p_brand, max(p_name LIKE '%WIDGET%') AS widgets, sum((p_size > 20) AND (p_retailprice < 1500)) AS cheap, (max(p_size) > 49) + 1 AS big FROM part GROUP BY p_brand", "SELECT p_brand, max((p_name ILIKE '%widget%')::INT) AS widgets, sum((p_size > 20 AND p_retailprice < 1500)::INT)::BIGINT AS cheap, (max(p_size) > 49)::INT + 1 AS big FROM part GROUP BY p_brand")
folded("dialect_int_div", "SELECT p_partkey, p_size / 7 AS whole, (p_size + 1) / (p_size - 10) AS by_zero, p_retailprice / 8 AS exact FROM part", "SELECT p_partkey, (p_size // 7)::BIGINT AS whole, CASE WHEN p_size <> 10 THEN trunc((p_size + 1) / (p_size - 10))::BIGINT END AS by_zero, p_retailprice / 8 AS exact FROM part")
folded("dialect_nested", "SELECT strftime('%Y', coalesce(o_orderdate, DATE('now'))) AS year, count(*) AS n, 'group_concat(x)' AS said FROM orders WHERE o_orderdate < DATE('now', '-7 days') GROUP BY 1", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n, 'group_concat(x)' AS said FROM orders WHERE o_orderdate < current_date - INTERVAL 7 DAY GROUP BY 1")
folded("dialect_loose", "SELECT s_suppkey, s_name FROM supplier WHERE s_name <> 5 AND s_nationkey = '7' OR s_suppkey = '3rd'", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")


def _relaxed(spark, sf_dir, sql, *tables):
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    found = relax.relax(spark, sql, max_rows=1_000_000)
    return found.rows.withColumn("dropped", F.lit("; ".join(found.dropped)))


@query("SELECT p_brand, count(*) AS n, 'p_size > 1000' AS dropped FROM part WHERE p_retailprice > 905 GROUP BY p_brand")
def relax_cte(spark, sf_dir):
    return _relaxed(spark, sf_dir, "WITH big AS (SELECT * FROM part WHERE p_size > 1000 AND p_retailprice > 905) SELECT p_brand, count(*) AS n FROM big GROUP BY p_brand", "part")


@query("SELECT c_custkey, 'o_totalprice < 0' AS dropped FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def relax_subquery(spark, sf_dir):
    return _relaxed(spark, sf_dir, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0 AND o_orderstatus = 'F') AND c_acctbal > 0", "customer", "orders")


@query("SELECT DISTINCT c_nationkey AS k, 'c_acctbal > 1e9' AS dropped FROM customer")
def relax_union(spark, sf_dir):
    return _relaxed(spark, sf_dir, "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 1e9 UNION SELECT s_nationkey FROM supplier WHERE s_suppkey < 0", "customer", "supplier")


@query("SELECT p_partkey, 'p_name = ''none''' AS dropped FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 7")
def relax_ordered(spark, sf_dir):
    """The order is applied before the limit."""
    found = _relaxed(spark, sf_dir, "SELECT p_partkey FROM part WHERE p_size > 10 AND p_name = 'none' ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 7", "part")
    return found.withColumn("dropped", F.translate("dropped", "()", ""))


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n, '(s_name LIKE ''none%'')' AS dropped FROM supplier WHERE s_acctbal > 0")
def relax_window(spark, sf_dir):
    return _relaxed(spark, sf_dir, "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier WHERE s_acctbal > 0 AND s_name LIKE 'none%'", "supplier")


def _fits(column: str, n: int) -> str:
    """``n`` constraints that every row satisfies."""
    return " AND ".join(f"{column} <> -{k}" for k in range(1, n + 1))


@query("SELECT c_custkey, count(*) AS n, 'o_totalprice < 0; o_orderstatus = ''none''; c_mktsegment = ''none''; l_quantity > 1000' AS dropped FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY c_custkey")
def relax_many_scopes(spark, sf_dir):
    """Some forty constraints in a common table, two joined scopes and a subquery, of which four have to go."""
    sql = f"""WITH o AS (SELECT * FROM orders WHERE {_fits("o_orderkey", 12)} AND o_totalprice < 0 AND o_orderstatus = 'none' AND o_orderstatus = 'F')
              SELECT c_custkey, count(*) AS n FROM customer JOIN o ON c_custkey = o_custkey
              WHERE c_acctbal > 0 AND {_fits("c_custkey", 10)} AND c_mktsegment = 'none'
                AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 1000 AND l_returnflag = 'R' AND {_fits("l_suppkey", 10)})
              GROUP BY c_custkey"""
    return _relaxed(spark, sf_dir, sql, "customer", "orders", "lineitem")


folded(
    "dialect_casts",
    "SELECT p_partkey, CAST(p_size AS INTEGER) / 3 AS third, p_size % 7 / 2 AS half, CASE WHEN p_size > 20 THEN p_size ELSE 1 END / 4 AS quarter, (SELECT count(*) FROM part) / (p_size + 1) AS share, p_size % (p_size - 10) AS rest FROM part",
    "SELECT p_partkey, p_size::INT // 3 AS third, p_size % 7 // 2 AS half, CASE WHEN p_size > 20 THEN p_size ELSE 1 END // 4 AS quarter, (SELECT count(*) FROM part) // (p_size + 1) AS share, CASE WHEN p_size <> 10 THEN p_size % (p_size - 10) END AS rest FROM part",
)
folded(
    "dialect_dates",
    "SELECT o_orderkey, strftime('%Y, week %W, day %w; it''s %j', o_orderdate) AS said, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS month_end, date(o_orderdate, 'weekday 1') AS monday, datetime(o_orderdate, '-30 minutes') AS earlier FROM orders WHERE o_orderdate >= date('1995-03-15', 'start of year')",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y, week %W, day %w; it''s %j') AS said, last_day(o_orderdate) AS month_end, (o_orderdate + INTERVAL 1 DAY * ((8 - dayofweek(o_orderdate)) % 7))::DATE AS monday, strftime(o_orderdate - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS earlier FROM orders WHERE o_orderdate >= DATE '1995-01-01'",
)
