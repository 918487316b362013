"""From a conversation to rows: rewrite, choose tables, link columns, write SQL, refine, guard, run, relax.

Language-model steps go through ``LanguageModel``; ``OfflineModel`` answers them by rules, the same
way every time. Every answer of a model is validated before it is used.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators import search
from askgrid.plans.guard import NotAQuery, checked
from askgrid.plans.predicates import predicate_values, unsupported
from askgrid.plans.relax import Relaxed, TooManySubsets, relax
from askgrid.plans.rewrite import Schema, refined
from askgrid.sources.catalog import TableCatalog, pivoted

RETURNED, PROBED, CELL = 5, 6, 200
AT_ONCE = 10


class LanguageModel(Protocol):
    def ask(self, step: str, **given) -> str: ...


class OfflineModel:
    """Rule-based answers, or scripted ones by step."""

    def __init__(self, scripted: dict[str, Callable[..., str] | str] | None = None):
        self.scripted = scripted or {}

    def ask(self, step: str, **given) -> str:
        if step in self.scripted:
            own = self.scripted[step]
            return own(**given) if callable(own) else own
        return getattr(self, f"_{step}", lambda **_: "")(**given)

    def _follow_up(self, question: str, tables: list[str]) -> str:
        return f"Which of these is it about: {', '.join(tables)}?" if tables else "No table seems to be about this. What are you looking for?"

    def _rewrite(self, messages: list[tuple[str, str]]) -> str:
        return " ".join(t for r, t in messages if r == "user")

    def _choose(self, question: str, tables: list[str]) -> str:
        words = set(re.findall(r"\w+", question.lower()))
        scored = sorted(tables, key=lambda t: (-len(words & set(re.findall(r"\w+", t.lower().replace("_", " ")))), t))
        return ", ".join(scored[:3])

    def _link(self, question: str, table: str, columns: list[str], hits: list[str]) -> str:
        words = set(re.findall(r"\w+", question.lower()))
        named = [c for c in columns if c in hits or words & set(re.findall(r"[^\W_]+", c.lower()))]
        return ", ".join(named or columns)

    def _sql(self, question: str, ddl: str, schema: Schema, samples: list[tuple[str, str, str]]) -> str:
        table = next(iter(schema))
        low = question.lower()
        where = [f"`{c}` = '{v.replace(chr(39), chr(39) * 2)}'" for t, c, v in samples if t == table and v.lower() in low]
        return f"```sql\nSELECT * FROM `{table}`{' WHERE ' + ' AND '.join(where) if where else ''}\n```"

    def _answer(self, question: str, sql: str, rows: list[dict]) -> str:
        return f"{len(rows)} rows: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.items()) for r in rows) if rows else "No rows."

    def _route(self, question: str, sources: dict[str, tuple[str, str]]) -> str:
        words = set(re.findall(r"\w+", question.lower()))
        best = max(sources.items(), key=lambda s: (len(words & set(re.findall(r"\w+", f"{s[0]} {s[1][0]}".lower()))), s[0]), default=None)
        return f'```json\n{{"choice": "{best[1][1] if best else "vector"}"}}\n```'


@dataclass(frozen=True)
class State:
    conversation: list[tuple[str, str]]
    question: str = ""
    tables: list[str] = field(default_factory=list)
    samples: list[tuple[str, str, str]] = field(default_factory=list)
    linked: Schema = field(default_factory=dict)
    queries: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    error: str | None = None
    relaxed: Relaxed | None = None
    message: str | None = None


def last_block(text: str, language: str) -> str | None:
    found = re.findall(rf"```{language}\s*(.*?)```", text, re.S)
    return found[-1].strip() if found else None


def choice(text: str) -> str:
    """sql, vector or none, out of a model's answer."""
    found = re.search(r'"choice"\s*:\s*"(\w+)"', text) or re.search(r"\b(sql|vector|none)\b", text.lower())
    return found[1].lower() if found and found[1].lower() in ("sql", "vector", "none") else "vector"


class Assistant:
    """The served pipeline, with optional predicate retry, reranking and answers."""

    def __init__(self, spark: SparkSession, catalog: TableCatalog, model: LanguageModel, embedder: search.Embedder | None = None, index: DataFrame | None = None, retry: bool = False, judge=None, answers: bool = False, follow_up: bool = False):
        self.spark, self.catalog, self.model, self.index = spark, catalog, model, index
        self.embedder = embedder or search.HashingEmbedder()
        self.retry, self.judge, self.answers, self.follow_up = retry, judge, answers, follow_up

    def understand(self, s: State) -> State:
        """A standalone question, and the tables it is about: all of them while they are few and narrow."""
        asked = [t for r, t in s.conversation if r == "user"]
        if not asked:
            raise ValueError("no question")
        question = asked[-1] if len(s.conversation) < 2 else self.model.ask("rewrite", messages=s.conversation)
        schema = self.catalog.schema()
        tables = list(schema)
        if len(tables) >= 2 and sum(map(len, schema.values())) >= 15:
            said = [t.strip() for t in self.model.ask("choose", question=question, tables=tables).split(",")]
            tables = [t for t in said if t in schema]
        return replace(s, question=question, tables=tables)

    def sample(self, s: State) -> State:
        if self.index is None:
            return s
        found = search.similar_to_message(s.question, self.index.where(F.col("table_name").isin(s.tables)), self.embedder)
        return replace(s, samples=[(r["table_name"], r["column_name"], r["value"]) for r in found.orderBy("table_name", "column_name", "rank").collect()])

    def link(self, s: State) -> State:
        """Columns by table, asked table by table at once; unknown columns are dropped, small tables stay whole."""
        schema = self.catalog.schema()

        def one(table: str) -> tuple[str, dict[str, str]]:
            columns = schema[table]
            if len(columns) <= 5:
                return table, columns
            hits = [c for t, c, _ in s.samples if t == table]
            said = [c.strip() for c in self.model.ask("link", question=s.question, table=table, columns=list(columns), hits=hits).split(",")]
            return table, {c: columns[c] for c in columns if c in said or c == "rowid"}

        with ThreadPoolExecutor(AT_ONCE) as pool:
            return replace(s, linked={t: cs for t, cs in pool.map(one, s.tables) if cs})

    def write(self, s: State) -> State:
        """SQL of the linked schema, refined; the refined text is a second query only where it differs."""
        if not s.linked:
            return replace(s, message="No table answers this question.")
        shown = {t: {} for t in s.linked}
        for t, c, v in s.samples:
            if t in shown:
                shown[t].setdefault(c, []).append(v)
        ddl = "\n\n".join(self.catalog.ddl(t, list(cs), shown[t]) for t, cs in s.linked.items())
        said = self.model.ask("sql", question=s.question, ddl=ddl, schema=s.linked, samples=s.samples)
        sql = last_block(said, "sql") or said.strip()
        try:
            own, _ = checked(self.spark, sql)
            better = refined(self.spark, own, self.catalog.schema(), s.linked, self.catalog.folded)
        except (NotAQuery, PySparkException) as e:
            return replace(s, queries=[*s.queries, sql], error=str(e).splitlines()[0])
        return replace(s, queries=[*s.queries, sql] + ([better] if better != own else []), error=None)

    def absent_values(self, s: State) -> list[tuple[str, str, str]]:
        """Predicate values of the query that are not among their columns' closest values."""
        if self.index is None or s.error or not s.queries:
            return []
        said = predicate_values(self.spark, s.queries[-1], self.catalog.schema()).where("operator in ('eq', 'in')")
        near = search.similar_values(said, self.index, self.embedder)
        return [(r["table_name"], r["column_name"], r["value"]) for r in unsupported(said, near).collect()]

    def run(self, s: State) -> State:
        if s.error or s.message or not s.queries:
            return s
        got = execute(self.spark, s.queries[-1])
        return replace(s, rows=got["result"], error=got["error"])

    def relax(self, s: State) -> State:
        if s.rows or s.error or s.message or not s.queries:
            return s
        try:
            found = relax(self.spark, s.queries[-1], usable=set(self.catalog.names()))
        except (TooManySubsets, PySparkException) as e:
            return replace(s, message=f"No rows, and not relaxed: {str(e).splitlines()[0]}")
        return replace(s, relaxed=found, message=f"No rows; {found.count} without: {', '.join(found.dropped)}" if found else s.message)

    def search(self, conversation: list[tuple[str, str]]) -> State:
        s = self.understand(State(conversation))
        if self.follow_up and needs_follow_up(s.tables):
            return replace(s, message=self.model.ask("follow_up", question=s.question, tables=s.tables))
        s = self.write(self.link(self.sample(s)))
        if self.retry and self.absent_values(s):
            s = self.write(s)
        s = self.relax(self.run(s))
        if self.judge and s.rows and len(s.tables) == 1 and "rowid" in self.catalog.tables[s.tables[0]].columns:
            kept = search.rerank(self.catalog.tables[s.tables[0]], self.judge)
            s = replace(s, rows=[r.asDict() for r in kept.limit(PROBED).collect()])
        if len(s.rows) > RETURNED:
            s = replace(s, rows=s.rows[:RETURNED], message="More rows than shown; please narrow the question.")
        if self.answers:
            s = replace(s, message=self.model.ask("answer", question=s.question, sql=s.queries[-1] if s.queries else "", rows=s.rows))
        return s

    def respond(self, conversation: list[tuple[str, str]]) -> dict:
        """What the search endpoint returns."""
        s = self.search(conversation)
        return {"sql_query": s.queries[0] if s.queries else None, "executed_query": s.queries[-1] if s.queries else None, "db_output": s.rows, "ddl_schema": "\n\n".join(self.catalog.ddl(t, list(c)) for t, c in s.linked.items()), "error": s.error, "message": s.message}

    def route(self, question: str, metadata: DataFrame) -> str:
        """The kind of source that a question goes to, by the sources' summaries."""
        rows = pivoted(metadata, ["summary", "data_source"]).collect()  # a row a table
        return choice(self.model.ask("route", question=question, sources={r["entity"]: (r["summary"] or "", r["data_source"] or "vector") for r in rows}))


def needs_follow_up(tables: list[str]) -> bool:
    return not tables or len(tables) > 3


def _shown(value):
    """A cell as it is returned: long texts are cut at a space."""
    return value if not isinstance(value, str) or len(value) <= CELL else re.sub(r" [^ ]*$", "", value[: CELL - 3]) + "..."


def execute(spark: SparkSession, sql: str, limit: int = PROBED, args: dict | None = None, fetch: str = "all") -> dict:
    """{result, error}: at most ``limit`` rows, or one with fetch "one"; errors are told and never raised.

    ``args`` are the values of named parameters (``:name``).
    """
    try:
        own, _ = checked(spark, sql)
        rows = spark.sql(own, args=args).limit(1 if fetch == "one" else limit).collect()
    except (NotAQuery, PySparkException) as e:
        return {"result": [], "error": str(e).splitlines()[0]}
    return {"result": [{k: _shown(v) for k, v in r.asDict().items()} for r in rows], "error": None}


class Requests:
    """Queries of many callers on one session: ``at_once`` under way, the others wait in their order.

    Each has a tag, which ``cancel`` stops it by, a scheduler pool (fair where the cluster schedules
    so), and ``seconds`` from its beginning until it is stopped; whoever is stopped is told so as an
    error, and the others go on.
    """

    def __init__(self, spark: SparkSession, at_once: int = AT_ONCE, seconds: float = 60.0, pool: str = "requests"):
        self.spark, self.seconds, self.pool = spark, seconds, pool
        self._workers = ThreadPoolExecutor(at_once)
        self._stopped: dict[str, str] = {}

    def __enter__(self) -> Requests:
        return self

    def __exit__(self, *_) -> None:
        self._workers.shutdown(wait=True, cancel_futures=True)

    def submit(self, sql: str, tag: str | None = None, **given) -> Future:
        """What ``execute`` returns, once it is there; ``given`` are its arguments."""
        tag = tag or f"askgrid-{uuid.uuid4().hex}"
        out = self._workers.submit(self._run, sql, tag, given)
        out.tag = tag
        return out

    def cancel(self, tag: str, why: str = "cancelled") -> None:
        """Stop the request with a tag, whether it is under way or waits."""
        self._stopped.setdefault(tag, why)

    def _watch(self, tag: str, done: threading.Event) -> None:
        """Cancel a request's jobs, those that begin later too, once it is to be stopped."""
        until = time.monotonic() + self.seconds
        while not done.wait(0.1):
            if time.monotonic() > until:
                self._stopped.setdefault(tag, f"stopped after {self.seconds:g} seconds")
            if tag in self._stopped:
                self.spark.sparkContext.cancelJobsWithTag(tag)

    def _run(self, sql: str, tag: str, given: dict) -> dict:
        if tag in self._stopped:
            return {"result": [], "error": self._stopped.pop(tag)}
        done, context = threading.Event(), self.spark.sparkContext
        threading.Thread(target=self._watch, args=(tag, done), daemon=True).start()
        context.setLocalProperty("spark.scheduler.pool", self.pool)
        context.addJobTag(tag)
        try:
            out = execute(self.spark, sql, **given)
        except Exception as e:  # a job that is stopped ends in an error of the scheduler's
            out = {"result": [], "error": str(e).splitlines()[0]}
        finally:
            done.set()
            context.removeJobTag(tag)
        why = self._stopped.pop(tag, None)
        return {"result": [], "error": why} if why and out["error"] else out


def cursor(spark: SparkSession, sql: str, args: dict | None = None) -> Iterator[dict]:
    """All rows of a query, partition by partition."""
    own, _ = checked(spark, sql)
    return (r.asDict() for r in spark.sql(own, args=args).toLocalIterator())


def replay(assistant: Assistant, samples: list[dict], at_once: int = AT_ONCE) -> list[dict]:
    """Answers to test samples, in their order, asked ``at_once`` at a time, with response times."""

    def one(item: tuple[int, dict]) -> dict:
        index, sample = item
        began = time.monotonic()
        history = [(m["role"], m["content"]) for m in sample.get("conversation_history") or []]
        try:
            output, error = assistant.respond([*history, ("user", sample["current_message"])]), None
        except ValueError as e:
            output, error = None, str(e)
        return {"index": index, "output": output, "error": error, "response_time_seconds": time.monotonic() - began}

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, enumerate(samples)))
