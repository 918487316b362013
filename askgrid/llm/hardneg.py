"""Hard negatives: rows of another label that score close below an anchor's positives, by bit-sliced products.

Components are whole numbers. A block of rows keeps them as bit planes, the most significant one
first, packed eight to a byte; anchors meet the blocks as whole numbers. After each plane a pair's
score lies in an interval: what the planes so far give, and at least (most) what the negative
(positive) components of the anchor give if all bits still to come are set. Pairs are dropped as
soon as their interval can't qualify; whole matrices are multiplied while most pairs are left, and
single pairs after that. What comes to the last plane has an exact score.

1. *Positives*: of the rows of an anchor's label, a pair goes when ``positives`` others of its block
   have a lower end above its upper end; the best of each block are ranked over all blocks.
2. *Negatives*: each positive score p opens a window from low p / 100 to high p / 100. A pair of
   different labels goes when its interval misses all windows of its anchor, or when in each of them
   ``negatives`` pairs that are surely inside have a lower end above its upper end; again the best of
   each block are ranked over all blocks.

Every anchor block meets every block of rows, in tasks that hold one pair of blocks each. Of equal
vectors of one label only the ``positives`` + 1 smallest ids can be chosen (one may be the anchor's),
and ``positives`` rows of each, so a vector that a third of all rows share is scored that often at most.

Defined results: rows whose id, label or vector is null, or whose vector holds a null or non-finite
component, take no part; missing trailing components count as 0; a row never meets its own id; rows
repeated whole are separate candidates and one anchor, rows that share an id alone are separate
anchors; an anchor without positives, or without rows in a window, gives no rows there. Labels that
are not whole numbers are compared by a 64-bit hash. Scores that could pass 62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.topk import quantised
from askgrid.llm.workspace import forget, lean_batches, written

#: Rows of a block of anchors and of a block of rows at 64 components; wider vectors make smaller blocks.
ANCHORS, ROWS = 512, 4096
#: Blocks that a stage is dealt over at most.
MOST_TASKS = 10_000
#: Pairs are counted singly once fewer than one in so many is left; so many of them are multiplied at once.
_FEW, _AT_ONCE = 8, 1 << 15
_LEAST = np.iinfo(np.int64).min


def _kind(bits: int) -> type:
    """The smallest whole number that holds a component."""
    return np.int16 if bits <= 16 else np.int32 if bits <= 32 else np.int64


def _packed(bits: int, width: int, planes: bool):
    """Rows of one block number: ids, labels, and components as whole numbers or as bit planes of value + 2 ** (bits - 1)."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values(["label", "id"], kind="stable")
        grid = np.zeros((len(frame), width), np.int64)
        for i, v in enumerate(frame["v"]):
            grid[i, : len(v)] = v
        if planes:
            grid += 1 << (bits - 1)
            body = b"".join(np.packbits((grid >> b & 1).astype(np.uint8), axis=1).tobytes() for b in range(bits - 1, -1, -1))
        else:
            body = grid.astype(_kind(bits)).tobytes()
        return pd.DataFrame([(int(frame["block"].iloc[0]), frame["id"].to_numpy(np.int64).tobytes(), frame["label"].to_numpy(np.int64).tobytes(), body)], columns=["block", "ids", "labels", "body"])

    return run


def _kth(group: np.ndarray, values: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th greatest value of each of n groups; the least number where a group has fewer."""
    by = np.lexsort((-values, group))
    first = np.searchsorted(group[by], np.arange(n + 1))
    at = first[:-1] + k - 1
    out = np.full(n, _LEAST)
    has = at < first[1:]
    out[has] = values[by][at[has]]
    return out


def _leading(group: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k greatest values, ties to the smaller id."""
    by = np.lexsort((ids, -values, group))
    own = group[by]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return by[rank < k]


class _Rows:
    """A block of rows, its planes unpacked one at a time."""

    def __init__(self, row: dict, bits: int, width: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.bits, self.width = bits, width
        self.planes = np.frombuffer(row["body"], np.uint8).reshape(bits, len(self.ids), -(-width // 8))

    def plane(self, b: int, at: np.ndarray | slice) -> np.ndarray:
        """The bits of weight 2 ** b."""
        return np.unpackbits(self.planes[self.bits - 1 - b][at], axis=1, count=self.width)


def narrowed(anchors: np.ndarray, rows: _Rows, at: np.ndarray | slice, whole: Callable, single: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that stay to the last plane; rows are those of the block that ``at`` names.

    ``whole(low, high)`` says which pairs of a matrix stay, ``single(i, j, low, high)`` which of a list.
    """
    weight = int(np.abs(anchors).sum(1).max(initial=0))
    if weight << rows.bits >= 1 << 62:
        raise OverflowError("scores beyond 62 bits")
    kind = np.float32 if weight < 1 << 24 else np.float64 if weight < 1 << 53 else np.int64
    factor, below, above = anchors.astype(kind), np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
    score = np.repeat(-(anchors.sum(1) << (rows.bits - 1))[:, None], len(rows.ids[at]), 1)
    alive = np.ones(score.shape, bool)
    i = j = None
    for b in range(rows.bits - 1, -1, -1):
        plane, rest = rows.plane(b, at), (1 << b) - 1
        if i is None:
            score += (factor @ plane.T.astype(kind)).astype(np.int64) << b
            alive &= whole(score + rest * below[:, None], score + rest * above[:, None])
            if not b or np.count_nonzero(alive) * _FEW < alive.size:
                i, j = np.nonzero(alive)
                score = score[i, j]
        else:
            for k in range(0, len(i), _AT_ONCE):
                part = slice(k, k + _AT_ONCE)
                score[part] += np.einsum("pw,pw->p", anchors[i[part]], plane[j[part]].astype(np.int64)) << b
        if i is not None:
            stays = single(i, j, score + rest * below[i], score + rest * above[i])
            i, j, score = i[stays], j[stays], score[stays]
    return i, j, score


def _met(row: dict, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Rows]:
    """Ids, labels and components of a block of anchors, and the rows that it meets."""
    ids = np.frombuffer(row["q_ids"], np.int64)
    return ids, np.frombuffer(row["q_labels"], np.int64), np.frombuffer(row["q_body"], _kind(bits)).reshape(len(ids), width).astype(np.int64), _Rows(row, bits, width)


def _positives(bits: int, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, components, rows = _met(row, bits, width)
                for label in np.intersect1d(labels, rows.labels):
                    own, at = np.flatnonzero(labels == label), np.flatnonzero(rows.labels == label)
                    other = ids[own][:, None] != rows.ids[at][None, :]

                    def whole(low, high, other=other):
                        if low.shape[1] <= k:
                            return other
                        cut = np.partition(np.where(other, low, _LEAST), -k, axis=1)[:, -k]
                        return other & (high >= cut[:, None])

                    def single(i, j, low, high, n=len(own)):
                        return high >= _kth(i, low, k, n)[i]

                    i, j, score = narrowed(components[own], rows, at, whole, single)
                    best = _leading(i, score, rows.ids[at][j], k)
                    i, j, score = i[best], j[best], score[best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["q_block"], np.int32)), pa.array(own[i].astype(np.int32)), pa.array(ids[own[i]]), pa.array(rows.ids[at][j]), pa.array(score)], ["q_block", "anchor", "anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(bits: int, width: int, k: int, low_percent: int, high_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, components, rows = _met(row, bits, width)
                slots = max(s["slot"] for s in row["windows"]) + 1
                # A window without a score is empty; 100 n must lie between the percents of the positive's score.
                first, last = np.full((len(ids), slots), np.iinfo(np.int64).max), np.full((len(ids), slots), _LEAST)
                for s in row["windows"]:
                    first[s["anchor"], s["slot"]] = -(-low_percent * s["positive_score"] // 100)
                    last[s["anchor"], s["slot"]] = high_percent * s["positive_score"] // 100
                some = np.flatnonzero((first <= last).any(1))
                if not len(some):
                    continue
                first, last = first[some], last[some]
                differs = (labels[some][:, None] != rows.labels[None, :]) & (ids[some][:, None] != rows.ids[None, :])
                least, most = np.where(first <= last, first, np.iinfo(np.int64).max).min(1)[:, None], np.where(first <= last, last, _LEAST).max(1)[:, None]

                def whole(low, high, differs=differs, least=least, most=most):
                    return differs & (high >= least) & (low <= most)

                def single(i, j, low, high, first=first, last=last):
                    stays = np.zeros(len(i), bool)
                    for s in range(first.shape[1]):
                        surely = (low >= first[i, s]) & (high <= last[i, s])
                        cut = _kth(i[surely], low[surely], k, len(first))
                        stays |= (high >= np.maximum(first[i, s], cut[i])) & (low <= last[i, s])
                    return stays

                i, j, score = narrowed(components[some], rows, slice(None), whole, single)
                for s in range(slots):
                    inside = np.flatnonzero((score >= first[i, s]) & (score <= last[i, s]))
                    best = inside[_leading(i[inside], score[inside], rows.ids[j[inside]], k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), row["q_block"], np.int32)), pa.array(some[i[best]].astype(np.int32)), pa.array(np.full(len(best), s, np.int32)), pa.array(rows.ids[j[best]]), pa.array(score[best])], ["q_block", "anchor", "slot", "negative_id", "negative_score"])

    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row of ``anchors`` and each of its ``positives`` best other rows of its label, the
    ``negatives`` best rows of another label whose score is between ``low`` and ``high`` percent of
    the positive's, ties to smaller ids. Scores are inner products of floor(256 x).
    """
    lean_batches(rows.sparkSession)

    def sound(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[label_col]
        label = F.col(f"`{label_col}`").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(f"`{label_col}`")
        return quantised(df.where(F.col(f"`{label_col}`").isNotNull()), id_col, vector_col, label=label)

    asked = written(sound(anchors).dropDuplicates(["id", "label", "v"]), "anchors")
    # The limit on equal vectors applies in each task before the shuffle too.
    same = Window.partitionBy("label", "h", "v").orderBy("id")
    every = sound(rows).withColumn("h", F.xxhash64("v")).groupBy("label", "h", "v", "id").agg(F.count("*").alias("copies"))
    every = every.withColumn("n", F.row_number().over(same)).where(F.col("n") <= positives + 1)
    known = written(every.select("id", "label", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(positives))))).select("id", "label", "v"), "rows")
    shape = known.unionByName(asked).agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    width, bits = max(1, shape["width"] or 0), (shape["most"] or 0).bit_length() + 1
    blocks = lambda df, size: max(1, -(-df.count() // max(64, size * 64 // max(64, width))))
    q_blocks, c_blocks = blocks(asked, ANCHORS), blocks(known, ROWS)
    tasks = lambda n: max(1, min(MOST_TASKS, n))
    block = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).repartition(tasks(n), "block").groupBy("block")
    blob = "block int, ids binary, labels binary, body binary"
    q = written(block(asked, q_blocks).applyInPandas(_packed(bits, width, False), blob), "anchor-blocks")
    c = written(block(known, c_blocks).applyInPandas(_packed(bits, width, True), blob), "row-blocks")
    forget(known)

    def pairs(sides: DataFrame) -> DataFrame:
        """Every block of anchors with every block of rows: the anchors, the lighter side, are what is repeated."""
        sides = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).repartition(tasks(c_blocks), "block")
        return sides.join(c.repartition(tasks(c_blocks), "block"), "block").drop("block")

    sides = q.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("body").alias("q_body"))
    found = pairs(sides).mapInArrow(_positives(bits, width, positives), "q_block int, anchor int, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("q_block", "anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives)
    chosen = written(chosen, "positives")
    # ANCHORS times ``positives`` windows a row.
    windows = chosen.groupBy("q_block").agg(F.collect_list(F.struct("anchor", "slot", "positive_score")).alias("windows"))
    found = pairs(sides.join(windows, "q_block")).mapInArrow(_negatives(bits, width, negatives, low, high), "q_block int, anchor int, slot int, negative_id long, negative_score long")
    order = Window.partitionBy("q_block", "anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    mined = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = mined.join(chosen, ["q_block", "anchor", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
