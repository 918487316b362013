"""Value indexes and exact nearest-neighbour search over column values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions.text import embedding_text

QUERY_BLOCK, ASKED_BLOCK, ROW_BLOCK, MOST_QUERIES = 512, 4096, 20_000, 8192
#: Components, or scores, that are in memory at once: 8 MB of them.
CELLS = 1 << 20
MARGIN = 1.1e-4  # scores that may round alike
INDEX = "table_name string, column_name string, value string, embedding array<float>"


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Character trigrams hashed (MD5) to a fixed number of signed dimensions: no network, same result everywhere."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions
        self.known: dict[str, tuple[int, int]] = {}

    def _place(self, gram: str) -> tuple[int, int]:
        """Dimension and sign of a trigram; each is hashed once while fewer than a million are known."""
        found = self.known.get(gram)
        if found is None:
            code = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big")
            found = code % self.dimensions, 1 if code >> 31 else -1
            if len(self.known) < 1_000_000:
                self.known[gram] = found
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        padded = [f"  {text.lower()} " for text in texts]
        places = [self._place(p[i : i + 3]) for p in padded for i in range(len(p) - 2)]
        at = np.array(places, np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(texts)), [len(p) - 2 for p in padded])
        return np.bincount(row * self.dimensions + at[:, 0], at[:, 1], len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(np.float32)


def unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def sound(vector: Column) -> Column:
    """Whether a vector has components, all of them there and finite."""
    value = lambda x: x.cast("double")  # noqa: E731  NaN compares above every number
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (value(x) > float("-inf")) & (value(x) < float("inf"))), F.lit(False))


def distinct_values(table: DataFrame, name: str, columns: list[str] | None = None, most: int = 512) -> DataFrame:
    """(table_name, column_name, value, text): the distinct values of the text columns, trimmed before they are compared, from one scan."""
    columns = columns or [c for c, t in table.dtypes if t == "string" and c != "rowid"]
    cells = [F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"`{c}`")).alias("value"), embedding_text(c, F.col(f"`{c}`"), most).alias("text")) for c in columns]
    rows = table.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(name).alias("table_name"), "c.*")
    return rows.where("value is not null and value <> ''").distinct()


def embed_values(values: DataFrame, embedder: Embedder, batch: int = 128) -> DataFrame:
    """A value index: each value with its vector, embedded batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part[["table_name", "column_name", "value"]].assign(embedding=list(embedder.embed(part["text"].tolist())))

    return values.mapInPandas(run, INDEX).withColumn("embedding", F.transform(unit(F.col("embedding")), lambda x: x.cast("float")))


def extend_index(index: DataFrame, values: DataFrame, embedder: Embedder) -> DataFrame:
    """The index with the values that it lacks."""
    fresh = values.join(index.select("table_name", "column_name", "value"), ["table_name", "column_name", "value"], "left_anti")
    return index.unionByName(embed_values(fresh, embedder))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)


def _best_of_batches(asked: pa.Table, query: str, shared: list[str], keys: list[str], value: str, k: int | None, least: float | None, leave_self: bool):
    """Scores of each batch of rows with all queries of as many components, by one matrix product a block; what can't be among the best of the batch stays there.

    At most CELLS components of rows and CELLS scores are held at once, whatever the batch and the queries.
    """
    vectors, own = asked["_q"].combine_chunks(), asked[query].combine_chunks()
    ids, lengths = own.to_pylist(), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    named = list(zip(*[asked[c].to_pylist() for c in shared])) if shared else [()] * asked.num_rows
    matrices = {}
    for width in np.unique(lengths).tolist():
        some = np.nonzero(lengths == width)[0]
        places: dict[tuple, tuple[list[int], dict]] = {}  # of the queries of a key: their rows of the matrix, and where among these an id is
        for n, i in enumerate(some.tolist()):
            asks, of = places.setdefault(named[i], ([], {}))
            of.setdefault(ids[i], []).append(len(asks))
            asks.append(n)
        matrices[width] = some, _matrix(vectors.take(pa.array(some)), width), places

    def met(batch: pa.RecordBatch, asks_of: np.ndarray, wanted: np.ndarray, places: dict[tuple, tuple[list[int], dict]]) -> Iterator[pa.RecordBatch]:
        rows = _matrix(batch["embedding"], wanted.shape[1])
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*[batch[c].to_pylist() for c in keys]) if keys else [()] * batch.num_rows):
            groups.setdefault(key, []).append(i)
        rest = batch.drop_columns("embedding")
        names = batch[value].to_pylist() if leave_self else []
        for key, inside in groups.items():
            asks, of = places.get(tuple(key[keys.index(c)] for c in shared), ([], {}))
            itself = np.array([(q, r) for r, i in enumerate(inside) for q in of.get(names[i], ())] if leave_self else [], np.int64).reshape(-1, 2)
            among, inside, step = rows[inside].T, np.array(inside), max(1, min(QUERY_BLOCK, CELLS // len(inside)))
            for at in range(0, len(asks), step):
                some = np.array(asks[at : at + step])
                scores = wanted[some] @ among
                q, r = itself[(itself[:, 0] >= at) & (itself[:, 0] < at + step)].T
                scores[q - at, r] = -np.inf
                good = np.isfinite(scores)
                if least is not None:
                    good &= scores >= least - MARGIN
                if k is not None and len(inside) > k:
                    good &= scores >= np.partition(scores, len(inside) - k, axis=1)[:, len(inside) - k, None] - MARGIN
                q, r = np.nonzero(good)
                if len(r):
                    out = rest.take(pa.array(inside[r]))
                    yield pa.RecordBatch.from_arrays([*out.columns, own.take(pa.array(asks_of[some[q]])), pa.array(scores[q, r])], [*out.schema.names, query, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch["embedding"])
            for width, given in matrices.items():
                fits, most = batch.filter(pc.equal(widths, width)), max(1, CELLS // width)
                for at in range(0, fits.num_rows, most):
                    yield from met(fits.slice(at, most), *given)

    return run


def _packed(vector: str, most: int):
    """A task's rows in blocks of about ``most`` rows or CELLS components at most, a block one binary value."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema) as out:
            out.write_table(pa.Table.from_batches(parts).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            step = max(1, min(most, CELLS // (pc.max(pc.list_value_length(batch[vector])).as_py() or 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and n + part.num_rows > step:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield block(held)

    return run


def _best_of_blocks(*how):
    """As _best_of_batches, of rows that each hold a block of queries and one of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, rows in zip(batch["_asked"], batch["_rows"]):
                asked, rows = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (asked, rows))
                yield from _best_of_batches(asked, *how)(rows.to_batches())

    return run


def nearest(queries: DataFrame, index: DataFrame, k: int | None, keys: list[str], value: str, query: str = "query_id", least: float | None = None, leave_self: bool = False) -> DataFrame:
    """The k best rows of ``index`` for each row of ``queries`` (query, embedding), or all that score ``least``: score, rank; ties to the smaller value.

    Up to MOST_QUERIES queries of CELLS components in all go to every task, which multiplies its
    rows' matrix with theirs and keeps what may be among the best, to within the rounding of scores.
    Beyond, queries and rows are packed in blocks, every block of queries is joined with every block
    of rows, and a pair of blocks is multiplied likewise, so that no task holds more than some of each.
    Queries and rows whose vector is null or empty, or has a null, NaN or infinite component, take no
    part, and vectors of unequal length don't meet, whatever the number of queries.
    """
    shared = [c for c in keys if c in queries.columns]
    asked = queries.where(sound(F.col("embedding"))).select(query, *shared, unit(F.col("embedding")).alias("_q"))
    index = index.where(sound(F.col("embedding")))
    how = query, shared, keys, value, k, least, leave_self
    rest = T.StructType([*[f for f in index.schema if f.name != "embedding"], asked.schema[query], T.StructField("score", T.DoubleType())])
    n, components = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("_q")), F.lit(0))).first()
    if n <= MOST_QUERIES and components <= CELLS:
        found = index.mapInArrow(_best_of_batches(asked.toArrow(), *how), rest)
    else:
        blocks, parts = max(1, -(-n // ASKED_BLOCK), -(-components // CELLS)), max(1, -(-index.count() // ROW_BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        asks = asked.repartition(blocks).mapInArrow(_packed("_q", ASKED_BLOCK), "block binary").select(F.col("block").alias("_asked"), own("block", blocks).alias("_b"), every(parts).alias("_c"))
        rows = index.mapInArrow(_packed("embedding", ROW_BLOCK), "block binary").select(F.col("block").alias("_rows"), own("block", parts).alias("_c"), every(blocks).alias("_b"))
        found = rows.join(asks, ["_b", "_c"]).select("_asked", "_rows").mapInArrow(_best_of_blocks(*how), rest)
    scored = found.withColumn("score", F.round("score", 4))
    scored = scored.where(F.col("score") >= least) if least is not None else scored
    if k is None:
        return scored
    order = Window.partitionBy(query, *keys).orderBy(F.desc("score"), value)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_values(predicates: DataFrame, index: DataFrame, embedder: Embedder, k: int = 5) -> DataFrame:
    """(table_name, column_name, asked, value, score, rank): for each predicate value the k closest values of its column."""
    texts = predicates.select("table_name", "column_name", F.col("value").alias("query_id")).distinct()
    texts = texts.withColumn("value", F.col("query_id")).withColumn("text", F.concat("column_name", F.lit(": "), F.trim("value")))
    asked = embed_values(texts, embedder).withColumnRenamed("value", "query_id")
    found = nearest(asked, index, k, ["table_name", "column_name"], "value")
    return found.select("table_name", "column_name", F.col("query_id").alias("asked"), "value", "score", "rank")


def similar_to_message(message: str, index: DataFrame, embedder: Embedder, k: int = 5) -> DataFrame:
    """The k closest values of every column to one message."""
    vector = [float(x) for x in embedder.embed([message])[0]]
    asked = index.sparkSession.createDataFrame([(message, vector)], "query_id string, embedding array<double>")
    return nearest(asked, index, k, ["table_name", "column_name"], "value").select("table_name", "column_name", "value", "score", "rank")


def rerank_batches(rows: DataFrame, size: int = 3, order: str = "rowid") -> DataFrame:
    """``rows`` with the number of the batch that a reranker sees them in; rowid is dense from 1."""
    return rows.withColumn("batch", F.floor((F.col(order) - 1) / size))


def rerank(rows: DataFrame, judge, size: int = 3) -> DataFrame:
    """Rows that ``judge(list of row dicts) -> list of rowids`` finds relevant, asked batch by batch in the order of rowid; ids outside of a batch are ignored."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = frame.drop(columns="batch").sort_values("rowid")
        return pd.DataFrame({"rowid": pd.Series(sorted(set(judge(part.to_dict("records"))) & set(part["rowid"])), dtype="int64")})

    return rows.join(rerank_batches(rows, size).groupBy("batch").applyInPandas(run, "rowid long"), "rowid", "left_semi")
