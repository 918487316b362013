"""The queries and DuckDB statements of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm.language import markup_language, page_host
from askgrid.llm.workspace import table


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.linededup import delete_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return delete_repeats(docs).select("doc_id", "n_lines", "n_deleted", F.char_length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


OP5_SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
every AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM cut),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM every
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (SELECT *, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w || chr(10) || lead(line, 3) OVER w AS run
         FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS line_again,
                  run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS run_again FROM runs),
marked AS (SELECT doc_id, i, (line_again AND length(line) >= 50)
                  OR max(run_again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS gone FROM ranked),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS text, count(*) AS n FROM every e
         LEFT JOIN marked m ON m.doc_id = e.doc_id AND m.i = e.i WHERE NOT coalesce(m.gone, false) GROUP BY e.doc_id)
SELECT c.doc_id, coalesce(len(c.lines), 0)::INT AS n_lines, (coalesce(len(c.lines), 0) - coalesce(k.n, 0))::INT AS n_deleted,
       CASE WHEN c.text IS NOT NULL THEN length(coalesce(k.text, '')) END::BIGINT AS kept_chars,
       CASE WHEN c.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM cut c LEFT JOIN kept k ON k.doc_id = c.doc_id
"""


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from askgrid.llm.sentencepiece import encode_digests, load

    return encode_digests(table(spark, sf_dir, "documents"), load(public_tokenizers.path("piece_bpe_32k.model")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


#: Base32 in SQL: five bits of the 160-bit digest at a time.
OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
b AS (SELECT page_id, n, hex, list_aggregate(list_transform(range(32), lambda i:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (((('0x' || hex[1 + 10 * (i // 8) : 10 + 10 * (i // 8)])::BIGINT) >> (35 - 5 * (i % 8))) & 31)]), 'string_agg', '') AS b32,
      max(page_id) OVER (PARTITION BY hex, n) AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), host=F.col("source"), declared=markup_language(F.col("text")), keep=["doc_id"])
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "kept")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: markup, address suffix and host take part."""
    from askgrid.llm.language import fit, identify

    pages = table(spark, sf_dir, "pages").withColumn("host", page_host(F.col("url")))
    found = identify(pages, fit(table(spark, sf_dir, "documents")), "html", F.col("host"), markup_language(F.col("html")), markup=True, keep=["page_id", "host"])
    return found.select("page_id", "host", "language", F.round("posterior", 6).alias("posterior"), "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.chat import digests, format_log, turns_as_events

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_log(turns_as_events(turns)))


def _op9_sql() -> str:
    from askgrid.llm.chat import CLOSE, ESCAPE_PATTERN, OPEN

    pattern = ESCAPE_PATTERN.replace("'", "''")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum({len(OPEN) + 1 + len(CLOSE)} + length(role) + length(regexp_replace(text, '{pattern}', '\\1\\2+\\3', 'g')))::BIGINT AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""


def chat_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations told as streams: half a text as a delta, a false start regenerated, an edit, then the rest."""
    from askgrid.llm.chat import digests, format_log

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    step = lambda n, kind, text: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), text.alias("said"))
    told = F.when(F.col("role") == "assistant", F.array(step(0, "delta", F.lit("false start")), step(1, "regenerate", F.lit("")), step(2, "delta", F.substring("text", 1, half)), step(3, "delta", F.substring(F.col("text"), half + 1, F.length("text"))))).otherwise(
        F.array(step(0, "message", F.lit("draft")), step(1, "edit", F.col("text")))
    )
    events = turns.select("conv_id", "turn", "role", F.explode(told).alias("e"))
    return digests(format_log(events.select("conv_id", (F.col("turn") * 8 + F.col("e.n")).alias("seq"), "e.kind", F.col("turn").cast("string").alias("message"), "role", F.col("e.said").alias("text"))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.quality import judge, log_ratios

    docs = table(spark, sf_dir, "documents")
    return judge(docs, log_ratios(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.hardneg import hard_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.urlfilter import judge_urls

    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


OP12_SQL = """
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT u.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
      FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


def replanted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum h of its id, repeats its words from the a-th on with a period p.

    With g = h div 10 and n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.when(chosen, F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    cut = hashed.select("doc_id", "text", words.alias("words"), F.floor(F.col("h") / 10).alias("g"))
    cut = cut.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    said = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    rest = F.col("n") - F.col("a")
    again = F.repeat(F.concat(said(F.col("a") + 1, F.col("p")), F.lit(" ")), F.floor(rest / F.col("p")).cast("int"))
    text = F.concat_ws(" ", said(F.lit(1), F.col("a")), again, said(F.col("a") + 1, (rest % F.col("p")).cast("int")))
    return cut.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from askgrid.llm.periodic import find_runs

    found = find_runs(replanted(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("b.length") / -F.col("b.period"))
    return out.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_warc, op3_language_id, op4_best_fit_packing, op5_line_dedup, op6_minhash_neardup, op7_exact_topk, op8_toxicity, op9_chat_format, op10_quality, op11_hard_negatives, op12_url_filter, op13_periodic_runs, pages_language, chat_streams)}


def oracle_sql() -> dict[str, str]:
    said = _op9_sql()
    own = "UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"
    return {"op2_warc": OP2_SQL, "op5_line_dedup": OP5_SQL, "op7_exact_topk": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_url_filter": OP12_SQL, "op9_chat_format": said, "chat_streams": said.replace(own, "")}
