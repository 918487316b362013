"""Sessions, turns and histories from conversation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = "array<struct<role string, content string>>"


def ordered(events: DataFrame, session: str, *order: str) -> DataFrame:
    """Events with their place in the session, from 1."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def merged_runs(turns: DataFrame, session: str, order: list[str], role: str, text: str, separator: str = "\n") -> DataFrame:
    """Neighbours of one role become one turn: equal neighbours once, others put together in order.

    Each step is a window within a session or an aggregation by (session, run).
    """
    place = Window.partitionBy(session).orderBy(*order)
    changed = F.when(F.lag(role).over(place).eqNullSafe(F.col(role)), 0).otherwise(1)
    runs = turns.withColumn("_again", (changed == 0) & F.lag(text).over(place).eqNullSafe(F.col(text))).withColumn("_new", changed).withColumn("run", F.sum("_new").over(place))
    own = F.struct(*order, F.col(text).alias("_t"))
    grouped = runs.where("not _again").groupBy(session, "run").agg(F.first(role).alias(role), F.array_sort(F.collect_list(own)).alias("_all"))
    return grouped.select(session, "run", role, F.array_join(F.transform("_all", lambda x: x["_t"]), separator).alias(text))


def user_samples(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each user turn: (session, order, current_message, conversation_history before it)."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    history = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before)
    return turns.withColumn("conversation_history", history).where("role = 'user'").select(session, order, F.col("text").alias("current_message"), "conversation_history")


def last_user_message(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    return turns.where("role = 'user'").groupBy(session).agg(F.max_by("text", order).alias("text"))


def last_turns(turns: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each session; the limit applies before the shuffle too."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("back") <= n)


def normalised_messages(history: Column) -> Column:
    """Leading system messages become one, neighbouring assistant messages are joined, tool answers are said by the user."""
    as_user = F.transform(history, lambda m: F.when(m["role"] == "tool", F.struct(F.lit("user").alias("role"), F.concat(F.lit("<tool_response>\n"), m["content"], F.lit("\n</tool_response>")).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    empty = F.array().cast(HISTORY)

    def add(done: Column, m: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (last["role"] == m["role"]) & ((m["role"] == "assistant") | ((m["role"] == "system") & (F.size(done) == 1)))
        both = F.struct(m["role"].alias("role"), F.concat(last["content"], F.lit("\n"), m["content"]).alias("content"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(as_user, empty, add)


def sampled(rows: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows by hash order: the same ones every time."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)
