"""The engine's own queries over the driver's tables, and the DuckDB statement each must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askgrid.functions import metrics, text
from askgrid.operators import chatlog, columns, search
from askgrid.plans import predicates, relax, rewrite
from askgrid.plans.guard import checked
from askgrid.sources import catalog
from askgrid.streaming import replay, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "embeddings", "pages")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str, sql: str, linked: rewrite.Schema | None = None, fold: bool = True) -> DataFrame:
    """A question's SQL the way the engine runs it: guarded, refined, executed over the tables as views."""
    schema = {}
    for name in TABLES:
        if name in sql:
            table = read(spark, sf_dir, name)
            table.createOrReplaceTempView(name)
            schema[name] = dict(table.dtypes)
    own, _ = checked(spark, sql)
    return spark.sql(rewrite.refined(spark, own, schema if fold else {}, linked))


def same(name: str, sql: str) -> None:
    """A query whose text both engines understand alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asked(spark, sf_dir, sql, fold=False)

    QUERIES[name], ORACLE[name] = run, sql


def folded(name: str, sql: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asked(spark, sf_dir, sql)

    QUERIES[name], ORACLE[name] = run, oracle


same("guarded_projection", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10 AND p_retailprice <= 1500;".rstrip(";"))
folded("casefold_eq", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'buILding'", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
folded("casefold_neq", "SELECT c.c_custkey FROM customer c WHERE c.c_mktsegment <> 'Building' AND c_acctbal > 0", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) <> 'building' AND c_acctbal > 0")
folded("casefold_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-urgent', '2-HIGH')", "SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
folded("casefold_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%WIDGET%'", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%'")
folded(
    "casefold_every_scope",
    "WITH b AS (SELECT p_partkey FROM part WHERE p_name LIKE '%WidGet%') SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM b) AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l_partkey AND p.p_name <> 'X') GROUP BY l_returnflag",
    "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) LIKE '%widget%' AND lower(p_name) <> 'x' GROUP BY l_returnflag",
)
same("join_multiway_filter", "SELECT c_mktsegment, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND l_quantity BETWEEN 5 AND 30 GROUP BY c_mktsegment, l_returnflag")
same("join_left_outer", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(max(o_totalprice), 2), 0) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
same("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey")
same("group_having_subquery", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean FROM part WHERE p_size < 40 GROUP BY p_brand HAVING avg(p_retailprice) < (SELECT avg(p_retailprice) FROM part)")
same("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
same("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
same("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier")
same("cte_nested", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, s FROM a WHERE s > (SELECT avg(s) FROM a)) SELECT c_mktsegment, count(*) AS n, round(sum(s), 2) AS total FROM b JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
same("topn_nulls_first", "SELECT c_custkey, nullif(c_acctbal, abs(c_acctbal)) AS debt FROM customer ORDER BY debt ASC NULLS FIRST, c_custkey LIMIT 20")
folded("dialect_group_concat", "SELECT p_type, GROUP_CONCAT(DISTINCT p_brand) AS n FROM part WHERE p_size > 45 GROUP BY p_type", "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS n FROM part WHERE p_size > 45 GROUP BY p_type")
folded("dialect_strftime", "SELECT strftime('%Y-%m', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")


def dialect_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are sorted for comparing: the dialect leaves their order open."""
    out = asked(spark, sf_dir, "SELECT p_type, GROUP_CONCAT(DISTINCT p_brand) AS n FROM part WHERE p_size > 45 GROUP BY p_type")
    return out.withColumn("n", F.array_join(F.array_sort(F.split("n", ",")), ","))


QUERIES["dialect_group_concat"] = dialect_group_concat


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def star_linked(spark, sf_dir):
    linked = {"nation": {"n_nationkey": "int", "n_name": "string"}, "region": {"r_name": "string"}}
    return asked(spark, sf_dir, "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", linked)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def join_left_semi(spark, sf_dir):
    poor = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(poor, "o_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def group_concat_distinct(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT p_brand, max((p_name ILIKE '%Widget%')::INT) AS widgets, max((p_type ILIKE 'small%')::INT) AS small FROM part GROUP BY p_brand")
def bool_flags_max(spark, sf_dir):
    flag = lambda c, p: F.max(F.col(c).ilike(p).cast("int"))
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(flag("p_name", "%Widget%").alias("widgets"), flag("p_type", "small%").alias("small"))


def _samples_sql() -> str:
    parts = []
    for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment")):
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, v AS value, '\"' || v || '\"' AS shown FROM (SELECT v, coalesce(sum(length(v)) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)) WHERE used < 1000")
    return " UNION ALL ".join(parts)


@query(_samples_sql())
def distinct_samples(spark, sf_dir):
    out = None
    for t, c in (("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"), ("customer", "c_mktsegment")):
        own = catalog.samples(read(spark, sf_dir, t), c).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "value", "shown")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT * FROM (VALUES ('customer','c_mktsegment','BUILDING','in'), ('customer','c_mktsegment','MACHINERY','in'), ('orders','o_orderstatus','F','neq'), ('customer','c_name','%7%','like')) t(table_name, column_name, value, operator)")
def predicate_literals(spark, sf_dir):
    schema = {t: dict(read(spark, sf_dir, t).dtypes) for t in ("customer", "orders")}
    return predicates.predicate_values(spark, "SELECT o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND o.o_orderstatus <> 'F' AND c_name LIKE '%7%' AND o_totalprice BETWEEN 1 AND 2 AND missing = 'x'", schema)


_CONDITIONS = ["p_size > 40", "p_name LIKE '%widget%'", "p_retailprice < 1000", "p_brand = 'none'"]


@query(f"SELECT ({' + '.join(f'CASE WHEN {c} THEN {1 << k} ELSE 0 END' for k, c in enumerate(_CONDITIONS))})::BIGINT AS mask, count(*) AS n FROM part GROUP BY 1")
def relax_masks(spark, sf_dir):
    return relax.masks(read(spark, sf_dir, "part"), _CONDITIONS)


@query(f"SELECT p_partkey, p_size FROM part WHERE {' AND '.join(_CONDITIONS[:3])} ORDER BY p_partkey LIMIT 15")
def relax_best(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    found = relax.relax(spark, f"SELECT p_partkey, p_size FROM part WHERE {' AND '.join(_CONDITIONS)} LIMIT 1000000")
    if found is None or len(found.kept) != 3:
        return spark.createDataFrame([], "p_partkey long, p_size int")
    return found.rows.orderBy("p_partkey").limit(15)


@query("SELECT min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem")
def profile_min_max(spark, sf_dir):
    return relax.profile(read(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def profile_top5(spark, sf_dir):
    return relax.profile(read(spark, sf_dir, "part"), "p_type")


_EAV = "SELECT user_id::VARCHAR AS entity, event_type AS attribute, round(max(value), 4)::VARCHAR AS value FROM events GROUP BY 1, 2"


@query("SELECT user_id::VARCHAR AS entity, max(CASE WHEN event_type = 'click' THEN props END) AS click, max(CASE WHEN event_type = 'view' THEN props END) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def eav_pivot(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("attribute"), F.col("props").alias("value"))
    return catalog.pivoted(rows, ["click", "view"])


@query("SELECT entity, attribute, coalesce(max(CASE WHEN fresh THEN value END), max(value)) AS value FROM (SELECT user_id::VARCHAR AS entity, event_type AS attribute, props AS value, event_id % 2 = 1 AS fresh FROM events) GROUP BY 1, 2")
def eav_upsert_latest(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("attribute"), F.col("props").alias("value"), (F.col("event_id") % 2).alias("new"))
    return catalog.upserted(rows.where("new = 0").drop("new"), rows.where("new = 1").drop("new"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE)"
_KNN = f"WITH e AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(a.v, b.v), 4) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"


def _knn(spark, sf_dir, k, least=None):
    """The stated query set, every fiftieth vector, against all vectors but itself."""
    index = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    wanted = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.nearest(wanted, index, k, [], "vec_id", least=least, leave_self=True)


@query(f"{_KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, score FROM r WHERE k <= 5")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir, 5).select("query_id", "vec_id", "score")


@query(f"{_KNN} SELECT query_id, vec_id, score FROM s WHERE score >= 0.4")
def knn_threshold(spark, sf_dir):
    return _knn(spark, sf_dir, None, 0.4).select("query_id", "vec_id", "score")


@query("SELECT 'part' AS table_name, column_name, value, column_name || ': ' || value AS text FROM (SELECT DISTINCT 'p_name' AS column_name, trim(p_name) AS value FROM part UNION ALL SELECT DISTINCT 'p_brand', trim(p_brand) FROM part UNION ALL SELECT DISTINCT 'p_type', trim(p_type) FROM part) WHERE value <> ''")
def value_index_distinct(spark, sf_dir):
    return search.distinct_values(read(spark, sf_dir, "part"), "part")


_TRIGRAMS = (
    "WITH vals AS (SELECT DISTINCT 'p_name' AS c, trim(p_name) AS v FROM part UNION SELECT DISTINCT 'p_brand', trim(p_brand) FROM part UNION SELECT DISTINCT 'p_type', trim(p_type) FROM part),"
    " texts AS (SELECT c, v, 0 AS q, '  ' || lower(c || ': ' || v) || ' ' AS t FROM vals UNION ALL SELECT c, v, 1, '  ' || lower({shown}) || ' ' FROM {asked}),"
    " grams AS (SELECT c, v, q, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2])) AS g FROM texts),"
    " codes AS (SELECT c, v, q, ('0x' || substr(md5(g), 1, 8))::BIGINT AS code FROM grams),"
    " dims AS (SELECT c, v, q, code % 256 AS d, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS w FROM codes GROUP BY ALL),"
    " norms AS (SELECT c, v, q, sqrt(sum(w * w)) AS n FROM dims GROUP BY ALL),"
    " pairs AS (SELECT a.c AS ac, a.v AS av, b.c, b.v FROM texts a JOIN texts b ON a.q = 1 AND b.q = 0 {same}),"
    " dots AS (SELECT a.c AS ac, a.v AS av, b.c, b.v, sum(a.w * b.w) AS dot FROM dims a JOIN dims b ON a.q = 1 AND b.q = 0 AND a.d = b.d GROUP BY ALL),"
    " scored AS (SELECT p.c AS column_name, p.av AS asked, p.v AS value, round(coalesce(d.dot, 0) / x.n / y.n, 4) AS score FROM pairs p LEFT JOIN dots d ON d.ac = p.ac AND d.av = p.av AND d.c = p.c AND d.v = p.v"
    " JOIN norms x ON x.q = 1 AND x.c = p.ac AND x.v = p.av JOIN norms y ON y.q = 0 AND y.c = p.c AND y.v = p.v),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name, asked ORDER BY score DESC, value)::INT AS rank FROM scored)"
)


@query(_TRIGRAMS.format(shown="c || ': ' || v", same="AND a.c = b.c", asked="(VALUES ('p_name', 'smal widgit'), ('p_type', 'standrd')) a(c, v)") + " SELECT 'part' AS table_name, column_name, asked, value, score, rank FROM ranked WHERE rank <= 3")
def similar_part_values(spark, sf_dir):
    """Closest values of two misspelt predicates, by hashed trigrams."""
    part = read(spark, sf_dir, "part")
    embedder = search.HashingEmbedder()
    index = search.embed_values(search.distinct_values(part, "part"), embedder)
    wanted = spark.createDataFrame([("part", "p_name", "smal widgit", "eq"), ("part", "p_type", "standrd", "eq")], predicates.COLUMNS)
    return search.similar_values(wanted, index, embedder, 3)


@query(_TRIGRAMS.format(shown="v", same="", asked="(VALUES ('', 'which widgets are small')) a(c, v)") + " SELECT 'part' AS table_name, column_name, value, score, rank FROM ranked WHERE rank <= 3")
def values_like_a_message(spark, sf_dir):
    """The closest values of every text column to a whole question; the index grows by what it lacks."""
    values, embedder = search.distinct_values(read(spark, sf_dir, "part"), "part"), search.HashingEmbedder()
    half = search.embed_values(values.where("column_name = 'p_brand'"), embedder)
    return search.similar_to_message("which widgets are small", search.extend_index(half, values, embedder), embedder, 3)


def _judged(spark, sf_dir):
    """The first 10 predictions of each query, those of them that are targets (rows of the query's label), and how many targets there are; a label's rows are counted, never listed."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    wanted = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("_wanted"))
    sizes = labels.groupBy(F.col("label").alias("_wanted")).agg(F.count("*").alias("_n"))
    found = _knn(spark, sf_dir, 10).join(wanted, "query_id")
    place = F.array_sort(F.collect_list(F.struct("rank", "vec_id", (F.col("label") == F.col("_wanted")).alias("hit"))))
    lists = found.groupBy("query_id", "_wanted").agg(place.alias("_p")).join(sizes, "_wanted", "left")
    hits = F.transform(F.filter("_p", lambda x: x["hit"]), lambda x: x["vec_id"])
    return lists.select("query_id", F.transform("_p", lambda x: x["vec_id"]).alias("predictions"), hits.alias("targets"), (F.col("_n") - 1).alias("n_targets"))


_JUDGED = f"{_KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s), p AS (SELECT query_id, list(vec_id ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY 1), t AS (SELECT a.vec_id AS query_id, coalesce(list(b.vec_id) FILTER (b.vec_id IS NOT NULL), []) AS targets FROM e a LEFT JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1), h AS (SELECT query_id, targets, len(list_filter(top, lambda x: list_contains(targets, x))) AS hits FROM p JOIN t USING (query_id))"


@query(f"{_JUDGED} SELECT query_id, round(hits / 5.0::DOUBLE, 6) AS score FROM h")
def precision_at_k(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.round(metrics.precision_at_k(F.col("predictions"), F.col("targets"), 5), 6).alias("score"))


@query(f"{_JUDGED} SELECT query_id, CASE WHEN len(targets) = 0 THEN 1.0 ELSE round(hits::DOUBLE / len(targets), 6) END::DOUBLE AS score FROM h")
def recall_at_k(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.round(metrics.recall_at_k(F.col("predictions"), F.col("targets"), 5, total=F.col("n_targets")), 6).alias("score"))


@query(f"{_JUDGED} SELECT query_id, CASE WHEN len(targets) = 0 THEN 1.0 ELSE round(least(1.0, hits / 2.0::DOUBLE), 6) END::DOUBLE AS score FROM h")
def recall_required_n(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", F.round(metrics.recall_at_k(F.col("predictions"), F.col("targets"), 5, required=2, total=F.col("n_targets")), 6).alias("score"))


@query(
    "WITH c AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0)"
    " SELECT 'same' AS kind, count(*) AS left_rows, count(*) AS right_rows, 6::BIGINT AS matched, 6::BIGINT AS columns, true AS correct FROM orders"
    " UNION ALL SELECT 'changed', count(*), count(*), 6 - count(DISTINCT CASE WHEN o_totalprice <> o_totalprice + (o_orderkey = 7)::INT THEN 1 END), 6, (6 - count(DISTINCT CASE WHEN o_orderkey = 7 THEN 1 END)) / 6.0 > 0.8 FROM orders"
    " UNION ALL SELECT 'fewer', (SELECT count(*) FROM orders), (SELECT count(*) FROM c), 0, 6, false"
)
def execution_accuracy(spark, sf_dir):
    """Whole orders against themselves dealt anew, with one value changed, and with rows left out; a changed key alone leaves five of six columns."""
    orders = read(spark, sf_dir, "orders")
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") == 7, 1).otherwise(0))
    others = {"same": orders.select(*reversed(orders.columns)).repartition(7), "changed": changed, "fewer": orders.where("o_orderkey % 7 <> 0")}
    rows = [metrics.execution_match(orders, o, ["o_orderkey"], ["o_orderkey"]).select(F.lit(k).alias("kind"), "*") for k, o in others.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("matched", F.col("matched").cast("bigint"))


_PLACED = "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)"


@query(f"{_PLACED} SELECT max(n) AS n, round((SELECT count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE FROM events WHERE value IS NOT NULL), 6) AS success_rate, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS greatest, max(value) FILTER (k = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(value) FILTER (k = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM v")
def latency_stats(spark, sf_dir):
    out = metrics.latency_stats(read(spark, sf_dir, "events"), "value", F.col("event_type") != "error")
    return out.withColumns({"success_rate": F.round("success_rate", 6), "mean": F.round("mean", 4), "median": F.round("median", 4)})


@query("SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def error_histogram(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a type


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def sessions_sorted(spark, sf_dir):
    return chatlog.ordered(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("place").cast("bigint").alias("place"))


@query(
    "WITH a AS (SELECT *, lag(event_type) OVER w IS NOT DISTINCT FROM event_type AS same_role, lag(props) OVER w IS NOT DISTINCT FROM props AS same_text FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " b AS (SELECT *, sum(CASE WHEN same_role THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)"
    " SELECT user_id, run::BIGINT AS run, event_type, string_agg(props, chr(10) ORDER BY ts, event_id) AS props FROM b WHERE NOT (same_role AND same_text) GROUP BY user_id, run, event_type"
)
def role_runs_merged(spark, sf_dir):
    return chatlog.merged_runs(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "props")


@query("SELECT a.conv_id, a.turn, a.text AS current_message, coalesce((SELECT string_agg(b.role || ':' || b.text, chr(10) ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn), '') AS history FROM conversations a WHERE a.role = 'user'")
def user_turn_samples(spark, sf_dir):
    rows = chatlog.user_samples(read(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "current_message", F.array_join(F.transform("conversation_history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("history"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return chatlog.last_user_message(read(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(spark, sf_dir):
    return chatlog.last_turns(read(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Customer: ' ELSE 'Support Team: ' END || text, chr(10) ORDER BY turn) FILTER (role <> 'system') || chr(10) || 'Latest Customer Message: ' || arg_max(text, turn) FILTER (role = 'user') AS said FROM conversations GROUP BY conv_id")
def format_conversation(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    history = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return turns.select("conv_id", text.conversation_text(history).alias("said"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 57), ' [^ ]*$', '') || '...' END AS short FROM documents")
def truncate_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.col("text"), 60).alias("short"))


@query("SELECT page_id, md5(regexp_replace(translate(html, '*#[]', ''), '<[^>\\n]*?>', '', 'g')) AS plain FROM pages")
def strip_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markdown(F.col("html"))).alias("plain"))


@query("SELECT doc_id, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk FROM documents")
def cjk_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.has_cjk(F.col("text")).alias("cjk"))


@query("SELECT doc_id, contains(lower(text), 'idiot') OR contains(lower(text), 'trash') AS sensitive FROM documents")
def sensitive_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.is_sensitive(F.col("text"), ["idiot", "Trash"]).alias("sensitive"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^\\s/?#]+\\.[^\\s/?#]+([/?#]\\S*)?$') AS valid FROM pages")
def url_valid(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.is_url(F.col("url")).alias("valid"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n, regexp_extract(html, 'href=\"([^\"]*)\"', 1) AS first FROM pages")
def link_extract(spark, sf_dir):
    found = text.links(F.regexp_replace("html", r'<a href="([^"\s)]*)">([^<\]]*)</a>', "[$2]($1)"))
    return read(spark, sf_dir, "pages").select("page_id", found.alias("l")).select("page_id", F.size("l").cast("bigint").alias("n"), F.coalesce(F.get("l", F.lit(0))["address"], F.lit("")).alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN v IS NULL OR v = '' THEN 'NULL' WHEN lower(v) IN ('true', 'false') THEN 'BOOLEAN' WHEN regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'NUMBER'"
    " WHEN try_strptime(v, '%Y-%m-%d') IS NOT NULL OR try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 'DATETIME' ELSE 'STRING' END AS kind"
    " FROM (SELECT l_returnflag AS v FROM lineitem UNION ALL SELECT l_quantity::VARCHAR FROM lineitem UNION ALL SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)) GROUP BY kind"
)
def cell_types(spark, sf_dir):
    cells = F.explode(F.array("l_returnflag", F.col("l_quantity").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("v")
    return read(spark, sf_dir, "lineitem").select(cells).groupBy(text.cell_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


def _related_sql() -> str:
    near = "len(list_filter(range(1, length({x}) - 3), lambda i: contains({y}, {x}[i:i+4]))) > 0 OR contains({x}, {y}) OR contains({y}, {x})"
    return " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, bool_and({near.format(x=f'lower(trim({a}))', y=f'lower(trim({b}))')}) AS related FROM part" for a, b in (("p_name", "p_brand"), ("p_name", "p_type"), ("p_brand", "p_type")))


@query(_related_sql().replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def column_relatedness(spark, sf_dir):
    """Which text columns of part share five characters in a row in every row."""
    return columns.related_columns(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


_BLOCKS = lambda x: f"list_transform(list_zip(string_split({x}, ''), string_split({x}, '')[2:], string_split({x}, '')[3:], string_split({x}, '')[4:], string_split({x}, '')[5:]), lambda z: z[1] || z[2] || z[3] || z[4] || z[5])"


@query(f"""
WITH d AS (SELECT a.text AS whole, upper(substr(a.text, 200)) AS late, a.source AS source, substr(b.text, 1, 3000) AS other, substr(a.text, 1, 500) || '...' || substr(b.text, 1, 500) AS mixed
           FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
t AS (SELECT {", ".join(f"lower(trim({c})) AS {c}" for c in ("whole", "late", "source", "other", "mixed"))} FROM d),
g AS (SELECT *, {", ".join(f"{_BLOCKS(c)} AS {c}_b" for c in ("whole", "late", "source", "other", "mixed"))} FROM t)
{" UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, coalesce(bool_and(contains({a}, {b}) OR contains({b}, {a}) OR list_has_any({a}_b, {b}_b)) FILTER ({a} <> '' AND {b} <> ''), false) AS related FROM g" for a, b in (("whole", "late"), ("whole", "source"), ("whole", "other"), ("whole", "mixed"), ("late", "source"), ("late", "other"), ("late", "mixed"), ("source", "other"), ("source", "mixed"), ("other", "mixed")))}
""")
def related_documents(spark, sf_dir):
    """Columns of long texts: documents, what is in them from the 200th character on, and the documents after them."""
    docs = read(spark, sf_dir, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    rows = docs.join(after, "doc_id").select(
        F.col("text").alias("whole"), F.upper(F.substr("text", F.lit(200))).alias("late"), "source", F.substring("next", 1, 3000).alias("other"),
        F.concat(F.substring("text", 1, 500), F.lit("..."), F.substring("next", 1, 500)).alias("mixed"),
    )
    return columns.related_columns(rows, rows.columns)


@query("SELECT p_partkey AS rowid, floor((p_partkey - 1) / 3)::BIGINT AS batch FROM part")
def rerank_batches(spark, sf_dir):
    return search.rerank_batches(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rowid"))).select("rowid", F.col("batch").cast("bigint").alias("batch"))


@query("SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rowid FROM orders")
def rowid_dense(spark, sf_dir):
    return catalog.dense_rowid(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])


@query("SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rowid FROM lineitem")
def rowid_lineitem(spark, sf_dir):
    return catalog.dense_rowid(read(spark, sf_dir, "lineitem"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT * FROM (VALUES ('string', 'TEXT'), ('integer', 'INTEGER'), ('number', 'REAL'), ('boolean', 'INTEGER'), ('datetime', 'TEXT'), ('array', 'TEXT')) t(json_type, sql_type)")
def type_mapping(spark, sf_dir):
    return spark.createDataFrame([(t, text.sql_type(t)) for t in ("string", "integer", "number", "boolean", "datetime", "array")], "json_type string, sql_type string")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    return sessions.windowed_counts(read(spark, sf_dir, "events")).withColumn("mean", F.round("mean", 6))


@query("WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return sessions.sessions(read(spark, sf_dir, "events"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which brands of widgets cost less on average than all parts do, and what kinds do they have?"""
    return asked(
        spark,
        sf_dir,
        "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean, max(p_size) AS largest FROM part WHERE p_name LIKE '%WIDGET%' GROUP BY p_brand HAVING avg(p_retailprice) < (SELECT avg(p_retailprice) FROM part) ORDER BY mean, p_brand;",
    )


from askgrid import queries_assistant, queries_tables, queries_text  # noqa: E402,F401  they register their own


@query("""
WITH e AS (SELECT user_id::VARCHAR AS session, ts, event_id, event_type AS role, coalesce(props, '') AS text FROM events),
g AS (SELECT *, sum(fresh) OVER w AS n FROM (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
r AS (SELECT *, sum(turned) OVER w AS run FROM (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS turned, role = lag(role) OVER w AND text = lag(text) OVER w AS again FROM g WINDOW w AS (PARTITION BY session, n ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY session, n ORDER BY ts, event_id)),
t AS (SELECT session, n, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY ts, event_id) AS text FROM r WHERE again IS NOT TRUE GROUP BY ALL)
SELECT a.session, a.run::BIGINT AS place, a.text AS current_message, coalesce((SELECT string_agg(b.role || ':' || b.text, chr(10) ORDER BY b.run) FROM t b WHERE b.session = a.session AND b.n = a.n AND b.run < a.run), '') AS history
FROM t a WHERE a.role = 'click'
""")
def replayed_events(spark, sf_dir):
    """Clicks as a user's turns, with what came before them in their conversation."""
    found = replay.samples(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", "props", user="click", gap="12 hours")
    return found.select("session", "place", "current_message", F.array_join(F.transform("conversation_history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("history"))
