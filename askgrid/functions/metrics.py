"""Retrieval and execution metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.sources.catalog import dense_rowid


#: Ranges of values that are counted apart.
RANGES = 64


def precision_at_k(predictions: Column, targets: Column, k: int) -> Column:
    """Share of the first k predictions that are targets; repeated predictions count every time."""
    if k <= 0:
        return F.lit(0.0)
    hits = F.size(F.filter(F.slice(predictions, 1, k), lambda x: F.array_contains(targets, x)))
    return F.when(F.coalesce(F.size(predictions), F.lit(0)) == 0, 0.0).otherwise(hits / k)


def recall_at_k(predictions: Column, targets: Column, k: int, required: int | None = None, total: Column | None = None) -> Column:
    """Share of the targets that are among the first k predictions; of ``required`` targets, k at most, where given.

    With ``total``, the number of targets, those that were never predicted needn't be listed.
    """
    found = F.size(F.filter(F.array_distinct(targets), lambda x: F.array_contains(F.slice(predictions, 1, max(1, k)), x)))
    every = F.size(targets) if total is None else total
    need = every if required is None else F.lit(max(1, min(required, k)))
    share = F.least(F.lit(1.0), found / F.nullif(need, F.lit(0)))
    return F.when(every == 0, 1.0).when((F.size(predictions) == 0) | F.lit(k <= 0), 0.0).otherwise(share)


def column_signatures(result: DataFrame, order: list[str]) -> DataFrame:
    """(n, signature) of each column: one number for its values in row order, nulls as empty text."""
    rows = dense_rowid(result, order)
    sums = [F.sum(F.xxhash64("rowid", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k, c in enumerate(result.columns)]
    wide = rows.agg(F.count("*").alias("n"), *sums)
    return wide.select("n", F.explode(F.array(*[f"s{k}" for k in range(len(result.columns))])).alias("signature"))


def execution_match(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], threshold: float = 0.8) -> DataFrame:
    """(left_rows, right_rows, matched, columns, correct): columns matched one to one by their values in row order; correct if strictly more than the threshold, or both empty.

    Signatures are of whole columns, so what is joined has one row for each column.
    """
    sides = [column_signatures(d, o).groupBy("n", "signature").agg(F.count("*").alias("c")) for d, o in ((left, left_order), (right, right_order))]
    joined = sides[0].join(sides[1].select("signature", F.col("c").alias("d")), "signature")
    totals = [s.agg(F.max("n").alias(f"{p}_rows"), F.sum("c").alias(f"{p}_columns")) for s, p in zip(sides, ("left", "right"))]
    matched = joined.agg(F.coalesce(F.sum(F.least("c", "d")), F.lit(0)).alias("matched"))
    one = totals[0].join(F.broadcast(totals[1]), F.lit(True)).join(F.broadcast(matched), F.lit(True))  # three single rows
    columns = F.greatest("left_columns", "right_columns")
    same = F.col("left_rows") == F.col("right_rows")
    right_answer = same & ((F.col("left_rows") == 0) | (F.col("matched") / columns > threshold))
    return one.select("left_rows", "right_rows", "matched", columns.alias("columns"), right_answer.alias("correct"))


def request_totals(rows: DataFrame, value: str, ok: Column) -> DataFrame:
    """(succeeded, failed, total, mean): how many requests went well and how many did not, and the time that all took; one pass."""
    good = F.coalesce(ok, F.lit(False))
    return rows.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def latency_stats(rows: DataFrame, value: str, ok: Column | None = None) -> DataFrame:
    """n, success_rate, mean, median, least, greatest, p95 and p99; a percentile is the value at place floor(n * q), from 0.

    Places come from counts by value, which are summed in each task first, not from one sort of all rows.
    """
    v = F.col(value)
    counts = rows.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("c"), F.count_if(F.coalesce(ok, F.lit(True)) if ok is not None else F.lit(True)).alias("k"))
    places = [F.expr(f"max_by(v, v) FILTER (WHERE below <= least(floor(n * {q}D), n - 1))").alias(f"p{name}") for q, name in (("0.95", 95), ("0.99", 99))]
    whole = counts.agg(F.sum("c").alias("n"), F.sum("k").alias("k"), F.sum(F.col("v") * F.col("c")).alias("total"))
    # Running counts over distinct values, range by range: bounds are quantiles, so that ranges are alike in size
    # however the values lie; offsets of ranges first, then inside each range.
    cuts = counts.agg(F.coalesce(F.approx_percentile("v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES), F.array().cast("array<double>")).alias("cuts"))
    part = F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part")
    ranged = counts.join(F.broadcast(cuts), F.lit(True)).select("v", "c", part)  # one row of RANGES numbers
    offsets = ranged.groupBy("part").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets.select("part", "before")), "part").withColumn("below", F.col("before") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    out = placed.join(F.broadcast(whole), F.lit(True))
    middle = F.expr("(max_by(v, v) FILTER (WHERE below <= floor((n - 1) / 2D)) + max_by(v, v) FILTER (WHERE below <= floor(n / 2D))) / 2").alias("median")
    return out.agg(F.max("n").alias("n"), (F.max("k") / F.max("n")).alias("success_rate"), (F.max("total") / F.max("n")).alias("mean"), middle, F.min("v").alias("least"), F.max("v").alias("greatest"), *places)
