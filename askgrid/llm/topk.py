"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are split vertically into ``PARTS`` groups of dimensions; each group is a node that knows
partial scores only. For blocks of queries against blocks of candidates:

1. every node gathers its ``k`` best partial scores of each query (a local score list), and the
   candidates on any list are scored in full: the k-th best full score is a safe cutoff;
2. the cutoff goes with each query block to every node, which sends the candidates whose partial
   score reaches its uniform share (if all partial scores fell short of cutoff / PARTS, so would
   the sum of the full score short of the cutoff), unless even the other nodes' best partial
   scores could not lift them to the cutoff;
3. what was sent is scored in full and ranked, ties to the smaller id.

Integer arithmetic throughout: float64 products where they are exact, 64-bit integers beyond;
scores that could pass 64 bits are an error, never wrong.
Of equal candidate vectors only the k + 1 smallest distinct ids can be among a query's best k (one
of them may be its own), and k rows of each, so a vector that a third of all rows share is scored
k (k + 1) times at most.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
missing trailing components count as 0; a query with fewer than k candidates returns all;
rows repeated whole are separate candidates of the same id; a query never meets its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.workspace import forget, written

PARTS = 2
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256, **also: Column) -> DataFrame:
    """(id, v): floor(scale * x) of each component of the vectors that take part; ``also`` are further columns."""
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    # NaN compares above every number, and so fails the upper bound.
    sound = F.forall(value, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("x"), *(c.alias(n) for n, c in also.items())).where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select("id", *also, F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _blob(groups: int, width: int):
    """Rows of one block number, packed: ids and, for each dimension group, a matrix of its components."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("id", kind="stable")
        grid = np.zeros((len(frame), width), np.int64)
        for i, v in enumerate(frame["v"]):
            grid[i, : len(v)] = v
        rows = [(int(frame["block"].iloc[0]), g, frame["id"].to_numpy(np.int64).tobytes(), np.ascontiguousarray(grid[:, part]).tobytes(), grid[:, part].shape[1]) for g, part in enumerate(_parts(groups, width))]
        return pd.DataFrame(rows, columns=["block", "part", "ids", "values", "width"])

    return run


_BLOB = "block int, part int, ids binary, values binary, width int"


def _parts(groups: int, width: int) -> list[slice]:
    edges = [round(width * g / groups) for g in range(groups + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T in int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else a @ b.T


def _matrices(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and partial scores of a pair of blocks."""
    q, c = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    a, b = np.frombuffer(row["q_values"], np.int64).reshape(len(q), row["width"]), np.frombuffer(row["values"], np.int64).reshape(len(c), row["width"])
    return q, c, _product(a, b)


def _lists(k: int):
    """Phase 1: the k best partial scores of each query in a block, with the node's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c, partial = _matrices(row)
                partial[q[:, None] == c[None, :]] = np.iinfo(np.int64).min
                most = min(k, len(c))
                at = np.argpartition(-partial, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(len(c)), (len(q), 1))
                best = np.take_along_axis(partial, at, 1)
                keep = best > np.iinfo(np.int64).min
                ids = np.broadcast_to(q[:, None], at.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(c[at][keep]), pa.array(best[keep]), pa.array(np.full(int(keep.sum()), row["part"], np.int32))], ["query_id", "vec_id", "partial", "part"])

    return run


def _sufficient(groups: int):
    """Phase 2: candidates whose partial score reaches the cutoff's uniform share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c, partial = _matrices(row)
                said = {i: (cutoff, rest) for i, cutoff, rest in zip(row["cut_ids"], row["cutoffs"], row["others"])}
                # A query without a cutoff has fewer than k candidates: all of them are sent.
                cutoff = np.array([said.get(i, (None, 0))[0] or 0 for i in q.tolist()], np.int64)[:, None]
                rest = np.array([said.get(i, (None, 0))[1] for i in q.tolist()], np.int64)[:, None]
                every = np.array([said.get(i, (None, 0))[0] is None for i in q.tolist()])[:, None]
                sent = every | ((partial >= -(-cutoff // groups)) & (partial + rest >= cutoff))
                sent &= q[:, None] != c[None, :]
                i, j = np.nonzero(sent)
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(c[j])], ["query_id", "vec_id"])

    return run


def _scored(pairs: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) with full inner products."""
    both = pairs.join(candidates.select(F.col("id").alias("vec_id"), F.col("v").alias("cv")), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    product = F.zip_with("qv", "cv", lambda a, b: F.coalesce(a, F.lit(0).cast("long")) * F.coalesce(b, F.lit(0).cast("long")))
    return both.select("query_id", "vec_id", F.aggregate(product, F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors`` of another id."""
    asked = written(quantised(queries, id_col, vector_col).dropDuplicates(["id", "v"]), "queries")
    # The same vector: the k + 1 smallest ids suffice, k rows of each; the limit applies in each task before the shuffle too.
    same = Window.partitionBy("h", "v").orderBy("id")
    rows = quantised(vectors, id_col, vector_col).withColumn("h", F.xxhash64("v")).groupBy("h", "v", "id").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    rows = rows.select("id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k))))).select("id", "v")
    known = written(rows, "candidates")
    width = max(known.agg(F.max(F.size("v"))).first()[0] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    groups = max(1, min(PARTS, width))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    q_blocks, c_blocks = blocks(asked, QUERY_BLOCK), blocks(known, CANDIDATE_BLOCK)
    block = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    q = written(block(asked, q_blocks).groupBy("block").applyInPandas(_blob(groups, width), _BLOB), "query-blocks")
    c = written(block(known, c_blocks).groupBy("block").applyInPandas(_blob(groups, width), _BLOB), "candidate-blocks")
    # Every query block meets every candidate block: the stated query set against all rows, in blocks.
    met = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    sides = q.select(F.col("block").alias("q_block"), "part", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    pairs = met.join(sides, ["q_block", "part"]).repartition(F.col("block"), F.col("q_block"), F.col("part"))

    lists = pairs.select("part", "ids", "values", "width", "q_ids", "q_values").mapInArrow(_lists(k), "query_id long, vec_id long, partial long, part int")
    order = Window.partitionBy("query_id", "part").orderBy(F.desc("partial"), "vec_id")
    lists = written(lists.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k), "lists")
    tops = lists.groupBy("query_id", "part").agg(F.max("partial").alias("top"))
    first = written(_scored(lists.select("query_id", "vec_id").distinct(), asked, known), "first")
    cut = _best(first.dropDuplicates(["query_id", "vec_id"]), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))

    every = tops.groupBy("query_id").agg(F.sum("top").alias("all_tops"))
    said = block(tops.join(every, "query_id").join(cut, "query_id", "left").withColumnRenamed("query_id", "id"), q_blocks)
    # QUERY_BLOCK queries a row on average.
    said = said.groupBy(F.col("block").alias("q_block"), "part").agg(F.collect_list(F.struct("id", "cutoff", (F.col("all_tops") - F.col("top")).alias("other"))).alias("s"))
    said = written(said.select("q_block", "part", F.col("s.id").alias("cut_ids"), F.col("s.cutoff").alias("cutoffs"), F.col("s.other").alias("others")), "cutoffs")
    sent = pairs.join(said, ["q_block", "part"]).select("part", "ids", "values", "width", "q_ids", "q_values", "cut_ids", "cutoffs", "others")
    sent = written(sent.mapInArrow(_sufficient(groups), "query_id long, vec_id long").distinct(), "sent")
    out = _best(_scored(sent, asked, known), k).select("query_id", "rank", "vec_id", "score")
    for gone in (lists, first, c):
        forget(gone)
    return out
