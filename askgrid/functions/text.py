"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL types by JSON type, all others being TEXT.
SQL_TYPES = {"string": "TEXT", "integer": "INTEGER", "number": "REAL", "boolean": "INTEGER"}
SPARK_TYPES = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double"}


def sql_type(json_type: str | None) -> str:
    return SQL_TYPES.get((json_type or "").lower(), "TEXT")


def lower_any(value: Column) -> Column:
    return F.lower(value.cast("string"))


def truncate_words(text: Column, length: int, suffix: str = "...") -> Column:
    """At most ``length`` characters, cut at a space; a text without one is cut where it is."""
    if length <= 0:
        return text
    head = F.substring(text, 1, max(0, length - len(suffix)))
    return F.when(F.char_length(text) <= length, text).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit(suffix)))


def safe_filename(name: Column, default: str = "unnamed") -> Column:
    clean = F.trim(F.regexp_replace(name.cast("string"), r'[\x00-\x1f<>:"/\\|?*]+', "_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def sheet_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{Nd} ._-]", "")


def normalised(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def flat_header(rows: Column) -> Column:
    """One name from the header cells above a column."""
    return F.array_join(F.filter(rows, lambda x: x.isNotNull() & (F.trim(x) != "")), "_")


def stripped(text: Column) -> Column:
    """The text without white space around it, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last_fence(text: Column, language: str) -> Column:
    """The body of the last fenced block of a language; null without one."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\s*(.*?)```"), 1)
    return F.when(F.size(blocks) > 0, stripped(F.element_at(blocks, -1)))


def json_block(text: Column) -> Column:
    return last_fence(text, "json")


def sql_block(text: Column) -> Column:
    return last_fence(text, "sql")


def tool_call(text: Column) -> Column:
    """(name, arguments) of the first tool call in tags."""
    body = F.nullif(F.regexp_extract(text, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1), F.lit(""))
    return F.struct(F.get_json_object(body, "$.name").alias("name"), F.get_json_object(body, "$.arguments").alias("arguments"))


def tool_calls(text: Column) -> Column:
    """[(name, arguments)] of all tool calls in tags, in order."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), 1)
    return F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))


def route_choice(text: Column) -> Column:
    """sql, vector or none: the JSON answer's choice, else the first of the words in the text, else vector."""
    said = F.lower(F.get_json_object(F.coalesce(json_block(text), text), "$.choice"))
    seen = F.nullif(F.regexp_extract(F.lower(text), r"\b(sql|vector|none)\b", 1), F.lit(""))
    return F.coalesce(F.when(said.isin("sql", "vector", "none"), said), seen, F.lit("vector"))


def english_date(day: Column) -> Column:
    n = F.dayofmonth(day)
    suffix = F.when(n.isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(day, "EEEE, MMMM "), n.cast("string"), suffix, F.date_format(day, ", yyyy"))


def vietnamese_date(day: Column) -> Column:
    names = F.array(*map(F.lit, ["Chủ Nhật", "Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy"]))
    return F.concat(F.element_at(names, F.dayofweek(day)), F.lit(", ngày "), F.dayofmonth(day).cast("string"), F.lit(" tháng "), F.month(day).cast("string"), F.lit(" năm "), F.year(day).cast("string"))


def normal_sql(sql: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(sql, r"\s+", " ")), r"\s*;\s*$", ""))


def without_reasoning(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?s)^.*</think>", ""))


def tokens(text: Column) -> Column:
    """Words with their hyphens, punctuation, white space: all of the text, in pieces."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|\s+|[^\s])"), 1)


def is_url(text: Column) -> Column:
    return text.rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+([/?#]\S*)?$")


def links(text: Column) -> Column:
    """Markdown links as [(title, address)]."""
    pattern = r"\[([^\]]*)\]\(([^)\s]+)\)"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("title"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("address"))


def link_titles(text: Column) -> Column:
    """The text with each markdown link replaced by its title."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)\s]+\)", "$1")


def strip_markdown(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "*#[]", ""), r"<[^>\n]*?>", "")


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def is_sensitive(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w))


def section(text: Column, title: str) -> Column:
    """What stands between a title with a colon and the next such title."""
    return stripped(F.regexp_extract(text, rf"(?s)(?:^|\n){title}:\s*(.*?)(?=\n[\p{{L}} ]+:|$)", 1))


def sections(text: Column, titles: list[str]) -> Column:
    """A structured answer: what stands under each title, as one struct; null for a title that isn't there."""
    return F.struct(*[F.nullif(section(text, t), F.lit("")).alias(t) for t in titles])


def relatedness(related: Column, duplicate: Column, rewrite: Column) -> Column:
    """Share of five points that a rewritten question earns; 3.5 is enough."""
    return (related / 5 * 2 + duplicate + rewrite) / 4 * 5


def sample_text(value: Column, is_text: bool) -> Column:
    """A value as a schema description shows it: texts in double quotes unless they are already."""
    shown = value.cast("string")
    return F.when(shown.startswith('"') & shown.endswith('"'), shown).otherwise(F.concat(F.lit('"'), shown, F.lit('"'))) if is_text else shown


def embedding_text(column: str, value: Column, most: int = 512) -> Column:
    prefix = f"{column}: "
    return F.concat(F.lit(prefix), F.substring(F.trim(value.cast("string")), 1, max(0, most - len(prefix))))


def cell_type(value: Column) -> Column:
    """NULL, BOOLEAN, NUMBER, DATETIME or STRING."""
    v = F.trim(value)
    # A text that can't be a date is told by its pattern: each failing parse would throw.
    formats = {r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": "yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^\d{2}/\d{2}/\d{4}$": "dd/MM/yyyy"}
    day = F.coalesce(*[F.when(v.rlike(p), F.try_to_timestamp(v, F.lit(f))) for p, f in formats.items()])
    return (
        F.when(v.isNull() | (v == "") | (F.lower(v) == "nan"), "NULL")
        .when(F.lower(v).isin("true", "false"), "BOOLEAN")
        .when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "NUMBER")
        .when(day.isNotNull(), "DATETIME")
        .otherwise("STRING")
    )


def conversation_text(history: Column, context: Column | None = None) -> Column:
    """Turns (role, content) as a support dialogue with its latest customer message last."""
    line = lambda m: F.concat(F.when(m["role"] == "user", "Customer: ").otherwise("Support Team: "), m["content"])
    spoken = F.filter(history, lambda m: m["role"] != "system")
    latest = F.element_at(F.filter(history, lambda m: m["role"] == "user"), -1)["content"]
    parts = [F.array_join(F.transform(spoken, line), "\n"), F.concat(F.lit("Latest Customer Message: "), latest)]
    if context is not None:
        parts.insert(0, F.concat(F.lit("Context: "), context))
    return F.concat_ws("\n", *parts)


def number_in(text: Column) -> Column:
    """The number of a text such as '6.0 km' or '473,333 đ'."""
    return F.regexp_replace(F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")


def unit_in(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"-?\d[\d,]*(?:\.\d+)?", "")), F.lit(""))
