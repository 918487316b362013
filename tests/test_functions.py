import pytest
from pyspark.sql import functions as F

from askgrid.functions import metrics, text


def one(spark, value, kind="string"):
    return lambda make: spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, make, wanted",
    [
        ("ĐÀ NẴNG", text.lower_any, "đà nẵng"),
        ("one two three four", lambda v: text.truncate_words(v, 12), "one two..."),
        ("onetwothreefour", lambda v: text.truncate_words(v, 8), "onetw..."),
        ("short", lambda v: text.truncate_words(v, 5), "short"),
        ("short", lambda v: text.truncate_words(v, 0), "short"),
        (' a/b:"c"  ', text.safe_filename, "a_b_c_"),
        (None, text.safe_filename, "unnamed"),
        ("Bảng 1/2 (x).v-1", text.sheet_filename, "Bảng 12 x.v-1"),
        (None, text.normalised, ""),
        ("x ```sql\nSELECT 1\n``` y ```sql SELECT 2```", text.sql_block, "SELECT 2"),
        ("no block", text.sql_block, None),
        ('```json\n{"choice": "SQL"}\n```', text.route_choice, "sql"),
        ("I choose none of them", text.route_choice, "none"),
        ("dunno", text.route_choice, "vector"),
        ("  SELECT\n 1 ; ", text.normal_sql, "select 1"),
        ("<think>a</think> b", text.without_reasoning, "b"),
        ("https://a.example/x?y=1", text.is_url, True),
        ("a.example", text.is_url, False),
        ("see [a b](http://x) now", text.link_titles, "see a b now"),
        ("# *a* <b>[c]</b>", text.strip_markdown, " a c"),
        ("你 hi", text.has_cjk, True),
        ("Some Bad thing", lambda v: text.is_sensitive(v, ["bad"]), True),
        ("Intro: a\nBody: b c\nEnd: d", lambda v: text.section(v, "Body"), "b c"),
        ("473,333 đ", text.number_in, 473333.0),
        ("6.0 km", text.unit_in, "km"),
        ("7", text.unit_in, None),
        ("  v ", lambda v: text.embedding_text("col", v), "col: v"),
        ("vvvvvvvv", lambda v: text.embedding_text("col", v, 9), "col: vvvv"),
        ("é", lambda v: text.sample_text(v, True), '"é"'),
        ('"q"', lambda v: text.sample_text(v, True), '"q"'),
        ("12.5", text.cell_type, "NUMBER"),
        ("TRUE", text.cell_type, "BOOLEAN"),
        ("28/10/2025", text.cell_type, "DATETIME"),
        ("nan", text.cell_type, "NULL"),
        ("x1", text.cell_type, "STRING"),
    ],
)
def test_scalars(spark, value, make, wanted):
    assert one(spark, value)(make) == wanted


def test_tokens_cover_the_text(spark):
    parts = one(spark, "well-known, he said: 42 é!")(text.tokens)
    assert "".join(parts) == "well-known, he said: 42 é!" and parts[0] == "well-known"


def test_links_and_calls(spark):
    assert [tuple(r) for r in one(spark, "[a](http://x) [b c](y)")(text.links)] == [("a", "http://x"), ("b c", "y")]
    assert tuple(one(spark, '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>')(text.tool_call)) == ("f", '{"x":1}')


@pytest.mark.parametrize("day, english", [("2024-03-01", "Friday, March 1st, 2024"), ("2024-03-12", "Tuesday, March 12th, 2024"), ("2024-03-22", "Friday, March 22nd, 2024"), ("2024-03-23", "Saturday, March 23rd, 2024")])
def test_dates(spark, day, english):
    assert one(spark, day)(lambda v: text.english_date(v.cast("date"))) == english
    assert one(spark, day)(lambda v: text.vietnamese_date(v.cast("date"))).endswith("tháng 3 năm 2024")


def test_headers_types_and_scores(spark):
    assert one(spark, ["Giá", None, " ", "thuê"], "array<string>")(text.flat_header) == "Giá_thuê"
    assert [text.sql_type(t) for t in ("String", "integer", "number", "boolean", "array", None)] == ["TEXT", "INTEGER", "REAL", "INTEGER", "TEXT", "TEXT"]
    row = spark.range(1).select(text.relatedness(F.lit(5), F.lit(1), F.lit(1)).alias("x")).first()
    assert row.x == 5.0


def test_conversations(spark):
    history = [("system", "s"), ("user", "hi"), ("assistant", "yes?"), ("user", "help")]
    said = one(spark, history, "array<struct<role string, content string>>")(lambda v: text.conversation_text(v, F.lit("ctx")))
    assert said == "Context: ctx\nCustomer: hi\nSupport Team: yes?\nCustomer: help\nLatest Customer Message: help"


def ratio(spark, make, predictions, targets):
    frame = spark.createDataFrame([(predictions, targets)], "p array<int>, t array<int>")
    return frame.select(make(F.col("p"), F.col("t"))).first()[0]


@pytest.mark.parametrize("p, t, k, wanted", [([1, 2, 3], [1, 3], 2, 0.5), ([1, 1, 2], [1], 3, 2 / 3), ([], [1], 3, 0.0), ([1], [1], 0, 0.0), ([1], [1], 4, 0.25)])
def test_precision(spark, p, t, k, wanted):
    assert ratio(spark, lambda a, b: metrics.precision_at_k(a, b, k), p, t) == pytest.approx(wanted)


@pytest.mark.parametrize("p, t, k, n, wanted", [([1, 2, 3], [1, 9], 3, None, 0.5), ([1, 2], [], 2, None, 1.0), ([], [1], 2, None, 0.0), ([1, 2, 3], [1, 2, 3, 4], 3, 2, 1.0), ([1, 9], [1, 2, 3], 2, 5, 0.5)])
def test_recall(spark, p, t, k, n, wanted):
    assert ratio(spark, lambda a, b: metrics.recall_at_k(a, b, k, n), p, t) == pytest.approx(wanted)


def test_execution_accuracy_is_strict_and_ordered(spark):
    left = spark.createDataFrame([(i, f"v{i}", i % 2, None, 1) for i in range(5)], "k int, a string, b int, c string, d int")
    same = left.select("k", "d", "c", "b", "a")
    wrong = left.withColumn("d", F.lit(2))
    assert metrics.execution_match(left, same, ["k"], ["k"]).first().correct
    assert not metrics.execution_match(left, wrong, ["k"], ["k"]).first().correct  # 4 of 5 is not over 0.8
    assert not metrics.execution_match(left, left.limit(4), ["k"], ["k"]).first().correct
    assert not metrics.execution_match(left.select("k", "a"), left.select("k", "a"), ["k"], ["a"]).limit(0).collect()
    assert not metrics.execution_match(left.select("a"), left.select("a").withColumn("a", F.reverse("a")), ["a"], ["a"]).first().correct


def test_percentiles_are_values_by_place(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    row = metrics.latency_stats(frame, "v", F.col("v") < 90).first()
    assert (row.n, row.p95, row.p99, row.median, row.least, row.greatest, row.success_rate) == (100, 95.0, 99.0, 49.5, 0.0, 99.0, 0.9)
    assert metrics.latency_stats(frame.limit(1), "v").first().p99 == 0.0
