"""Repeated line runs found by prefix doubling over line-ID sequences, later copies deleted.

Every document is a sequence of line IDs (two 64-bit hashes a line; lines without a word are no
part of it). A suffix is named by its first line, then by its first 2, 4, 8 ... lines: the name
of 2n lines is made of the names of n lines at its start and n lines further on. Suffixes of one
name share so long a prefix, which is an interval of the suffix array whose longest common prefix
is at least that long. A name that occurs once can't be part of a longer repeat, so each round
goes on with the repeated ones alone, the tables shrink, and doubling ends when no name occurs
twice. ``min_lines`` is one of the lengths on the way. A suffix's longest interval is the longest
run, of the lengths named, that begins there and has been seen before; runs of neighbouring
suffixes overlap, and what they cover without a gap is a maximal repeated run.

A line is deleted if it is in a run of ``min_lines`` lines, or is itself a line of ``min_chars``
characters, that occurs earlier: in an earlier document by doc_id, or further up. Everything is
DataFrame operations. Names are grouped with partial aggregation and joined back through a
shuffled join, which adaptive execution splits where one line has a third of all rows.

Defined results: null text stays null, with no lines; lines without a word stay; rows repeated
whole are one document and get equal results; rows that share a doc_id but not the text are
ordered by a hash of it, and a null doc_id comes first. Added columns are n_lines and n_deleted,
with ``ag_`` in front where the input has a column of that name, which stays as it is; inner
columns begin with ``_ag_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.workspace import forget, free_name, written

MIN_LINES, MIN_CHARS = 4, 50
_WORD = r"[^\x20\x09-\x0D]"
_KEY = ["_ag_id", "_ag_hash"]
_NAME = ["n1", "n2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.withColumns({"_ag_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "_ag_hash": F.xxhash64(text)})


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col).cast("string"), "\n")


def _hashes(*parts: Column) -> list[Column]:
    """Two independent hashes, the new name of what ``parts`` name."""
    return [F.xxhash64(*parts).alias("n1"), F.xxhash64(F.lit(1), *parts).alias("n2")]


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose name occurs more than once, with ``later``: whether it has occurred before."""
    at = F.struct(*_KEY, "pos")
    seen = rows.groupBy(*_NAME).agg(F.count("*").alias("_ag_n"), F.min(at).alias("_ag_first")).where("_ag_n > 1")
    seen = written(seen.drop("_ag_n"), f"{name}-names")
    out = written(rows.join(seen, _NAME).withColumn("later", at > F.col("_ag_first")).drop("_ag_first"), name)
    forget(seen)
    return out


def _ahead(rows: DataFrame, by: int) -> DataFrame:
    """``rows`` that have a row ``by`` lines further on in their document, under the name of both."""
    further = rows.select(*_KEY, (F.col("pos") - by).alias("pos"), F.col("n1").alias("m1"), F.col("n2").alias("m2"))
    # Rows repeated whole have equal names here, so one of each is enough.
    both = rows.join(further.dropDuplicates([*_KEY, "pos"]), [*_KEY, "pos"])
    return both.select(*_KEY, "pos", *_hashes(F.col("n1"), F.col("m1"), F.col("n2"), F.col("m2")))


def _suffixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, pos, line, chars, name): every line with a word as the suffix that begins there."""
    word = lambda x: x["s"].rlike(_WORD)
    lines = F.filter(F.transform(_lines(text_col), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), word)
    named = F.transform(lines, lambda x: F.struct(x["i"].alias("line"), F.char_length(x["s"]).alias("chars"), F.xxhash64(x["s"]).alias("n1"), F.xxhash64(F.lit(1), x["s"]).alias("n2")))
    return _keyed(docs, id_col, text_col).select(*_KEY, F.posexplode(named).alias("pos", "x")).select(*_KEY, "pos", "x.*")


def _spans(min_lines: int) -> Iterator[tuple[int, int]]:
    """(length named so far, further lines): doubling, by way of ``min_lines``."""
    span = 1
    while True:
        step = min_lines - span if span < min_lines < 2 * span else span
        yield span, step
        span += step


def _marked(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_chars: int) -> DataFrame:
    """(key, pos, line, gone, begins): repeated lines in their documents, whether they are later copies, and whether such a one begins a maximal run."""
    level = _repeated(_suffixes(docs, id_col, text_col), "suffixes-1")
    lines, ends = level, []
    if min_lines <= 1:
        ends.append(level.where("later").select(*_KEY, "pos", (F.col("pos") + 1).alias("end")))
    for span, step in _spans(min_lines):
        level = _repeated(_ahead(level.select(*_KEY, "pos", *_NAME), step), f"suffixes-{span + step}")
        if level.isEmpty():
            break
        if span + step >= min_lines:
            ends.append(level.where("later").select(*_KEY, "pos", (F.col("pos") + span + step).alias("end")))
    own = F.col("later") & (F.col("chars") >= min_chars)
    marked = lines.select(*_KEY, "pos", "line", F.when(own, F.col("pos") + 1).alias("own")).distinct()
    if ends:
        longest = reduce(DataFrame.unionByName, ends).groupBy(*_KEY, "pos").agg(F.max("end").alias("end"))
        marked = marked.join(longest, [*_KEY, "pos"], "left")
    else:
        marked = marked.withColumn("end", F.lit(None).cast("int"))
    # Every line of a repeated run is a repeated line, so runs are covered row by row.
    before = Window.partitionBy(*_KEY).orderBy("pos")
    reach = F.coalesce(F.max(F.greatest("end", "own")).over(before), F.lit(-1))
    earlier = F.coalesce(F.max(F.greatest("end", "own")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return marked.select(*_KEY, "pos", "line", (reach > F.col("pos")).alias("gone"), (earlier <= F.col("pos")).alias("begins"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_ag_id, _ag_hash, line): line numbers, from 0, of all later copies."""
    return _marked(docs, id_col, text_col, min_lines, min_chars).where("gone").select(*_KEY, "line")


def maximal_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, first_line, last_line, lines): the maximal runs of later copies in each distinct document, lines without a word inside them not counted."""
    gone = _marked(docs, id_col, text_col, min_lines, min_chars).where("gone")
    run = F.count_if("begins").over(Window.partitionBy(*_KEY).orderBy("pos"))
    runs = gone.withColumn("_ag_run", run).groupBy(*_KEY, "_ag_run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines"))
    return runs.select(F.nullif("_ag_id", F.lit(-(2**63))).alias(id_col), "first_line", "last_line", "lines")


def delete_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines and n_deleted added."""
    gone = repeated_lines(docs, id_col, text_col, min_lines, min_chars)
    # At most the lines of one document.
    gone = written(gone.groupBy(*_KEY).agg(F.collect_set("line").alias("_ag_gone")), "repeats")
    # Split after the join, so that the shuffle carries each text once.
    rows = _keyed(docs, id_col, text_col).join(gone, _KEY, "left").withColumn("_ag_lines", _lines(text_col))
    n = F.coalesce(F.size("_ag_lines"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ag_lines") - 1), F.col("_ag_gone"))
    text = F.when(F.col("_ag_gone").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(F.transform(left, lambda i: F.col("_ag_lines")[i]), "\n"))
    made = {text_col: text, free_name(docs.columns, "n_lines"): F.when(F.col("_ag_lines").isNull(), 0).otherwise(n), free_name(docs.columns, "n_deleted"): F.coalesce(F.when(F.col("_ag_gone").isNull(), 0).otherwise(F.size("_ag_gone")), F.lit(0))}
    return rows.select(*[made.pop(c).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in made.items()])
