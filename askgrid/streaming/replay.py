"""Test samples out of conversation logs: the same ones from a table and from a stream of events.

Events of a session, in order of time, are turns; neighbours of one role become one turn (equal
neighbours once, others put together), and each turn of a user is a sample with the turns before it.
A session that is idle for ``gap`` is over, and what comes later begins another conversation.

On a table this is windows and aggregations. On a stream each session keeps its turns in state:
events wait until the watermark has passed them, so that those which come late, twice or in any order
are taken in order and once; a timer at each event's time takes it up, and one after the gap closes
the session and forgets it. A sample goes out as soon as the turn after it begins. Restarts go on
from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from askgrid.operators.chatlog import HISTORY, merged_runs

SAMPLES = f"session string, began timestamp, place long, current_message string, conversation_history {HISTORY}"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(rows: DataFrame, session: str, at: str, event: str, role: str, text: str) -> DataFrame:
    """(session, at, event, role, text) of the rows that have a session and a time; a null text is empty."""
    own = rows.select(F.col(session).cast("string").alias("session"), F.col(at).cast("timestamp").alias("at"), F.col(event).cast("string").alias("event"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.where("session is not null and at is not null and event is not null and role is not null")


class _Conversation(StatefulProcessor):
    """State of a session: events that wait, turns that are done, and the turn under way."""

    def __init__(self, gap_ms: int, user: str, separator: str):
        self.gap, self.user, self.separator = gap_ms * 1000, user, separator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event string", "role string, text string")
        self.turns = handle.getListState("turns", "role string, content string")
        self.open = handle.getValueState("open", "role string, text string, last string, at long, began long, place long")

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            if not self.waiting.containsKey((r["micros"], r["event"])):
                self.waiting.updateValue((r["micros"], r["event"]), (r["role"], r["text"]))
                self._timer(r["micros"])
        return iter([])

    def _ended(self, session: str, turn: tuple) -> Iterator[Row]:
        """The turn under way is done: a sample if it is a user's, and a part of the history."""
        role, text, _, _, began, place = turn
        if role == self.user:
            history = [Row(role=t[0], content=t[1]) for t in self.turns.get()]
            yield Row(session=session, micros=began, place=place, current_message=text, conversation_history=history)
        self.turns.appendValue((role, text))

    def _closed(self, session: str, turn: tuple) -> Iterator[Row]:
        yield from self._ended(session, turn)
        self.turns.clear()
        self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        session, until = key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= until)
        turn = tuple(self.open.get()) if self.open.exists() else None
        for (at, event), (role, text) in due:
            self.waiting.removeKey((at, event))
            if turn and at - turn[3] >= self.gap:
                yield from self._closed(session, turn)
                turn = None
            if turn and turn[0] == role:
                said = turn[1] if turn[2] == text else turn[1] + self.separator + text
                turn = (role, said, text, at, turn[4], turn[5])
            else:
                began, place = (turn[4], turn[5] + 1) if turn else (at, 1)
                if turn:
                    yield from self._ended(session, turn)
                turn = (role, text, text, at, began, place)
        if turn and turn[3] + self.gap <= until:
            yield from self._closed(session, turn)
        elif turn and due:
            self.open.update(turn)
            self._timer(turn[3] + self.gap)

    def close(self) -> None:
        pass


def samples(events: DataFrame, session: str = "session", at: str = "at", event: str = "event", role: str = "role", text: str = "text", user: str = "user", gap: str = "30 minutes", late: str = "10 minutes", separator: str = "\n") -> DataFrame:
    """(session, began, place, current_message, conversation_history): a sample for each user turn of a table or a stream.

    ``event`` tells events of one time apart, and repeated ones. On a stream rows that come more than
    ``late`` after later ones are dropped; a conversation's last turns go out once it has been idle.
    """
    spark = events.sparkSession
    rows = _events(events, session, at, event, role, text)
    start = "timestamp'1970-01-02 00:00:00'"
    gap_ms = spark.range(1).select(F.expr(f"unix_millis({start} + interval {gap}) - unix_millis({start})")).first()[0]
    if rows.isStreaming:
        spark.conf.set(_STORE, _ROCKS)
        rows = rows.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
        inner = SAMPLES.replace("began timestamp", "micros long")
        found = rows.groupBy("session").transformWithState(statefulProcessor=_Conversation(gap_ms, user, separator), outputStructType=inner, outputMode="Append", timeMode="EventTime")
        return found.select("session", F.timestamp_micros("micros").alias("began"), "place", "current_message", "conversation_history")
    place = Window.partitionBy("session").orderBy("at", "event")
    rows = rows.dropDuplicates(["session", "at", "event"])
    rows = rows.withColumn("_new", F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(place)) >= gap_ms * 1000).cast("int"), F.lit(1)))
    rows = rows.withColumn("_n", F.sum("_new").over(place)).withColumn("conversation", F.struct("session", F.col("_n").alias("n")))
    began = rows.where("_new = 1").select("conversation", F.col("at").alias("began"))
    turns = merged_runs(rows, "conversation", ["at", "event"], "role", "text", separator)
    before = Window.partitionBy("conversation").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("conversation_history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before)).where(F.col("role") == user)
    return turns.join(began, "conversation").select(F.col("conversation.session").alias("session"), "began", F.col("run").cast("long").alias("place"), F.col("text").alias("current_message"), "conversation_history")
