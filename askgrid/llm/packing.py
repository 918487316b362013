"""Best-fit packing of tokenised documents into fixed-length sequences.

Pieces are dealt at random into groups of about ``GROUP`` pieces; each group runs best-fit
decreasing and certifies its bin count against dual-feasible-function lower bounds. Then
groups exchange: each releases its emptiest bins (enough free room for its gap to the bound
and one bin more, since even certified groups leave one bin part filled), the released pieces
of all groups are dealt anew into fewer groups, and best-fit decreasing runs again. The
released rows shrink by orders of magnitude each round, and every round is a written table.

Defined results: null text is empty (one piece, the closing id 0); a text longer than the
capacity is cut so that every piece but the first is full; equal and repeated rows are packed
once each; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm import textcore
from askgrid.llm.workspace import forget, lean_batches, written

CAPACITY = 2048
GROUP = 20_000
#: Texts of these characters alone split alike in both tokenizer libraries; all others take the slower one.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def _whole(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    whole.encode_special_tokens = True
    return whole


@functools.cache
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, name: str = "byte_bpe_50k") -> list[int]:
    """Ids of a whole text; special tokens' strings are ordinary text."""
    return _whole(name).encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else _fast(name).encode_ordinary(text)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(name: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = array("I", token_ids(text.as_py() or "", name))
                ids.append(end)
                view = memoryview(ids)
                rows += [(doc.as_py(), k, at, n, zlib.crc32(view[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        _whole.cache_clear()
        _fast.cache_clear()
        textcore.release()

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, for lengths in falling order, and the number of bins.

    Open bins are stacked by free room; a bit set of the occupied rooms finds the tightest fit.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, made = 0, 0
    for i, n in enumerate(lengths.tolist()):
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            room, at = capacity, made
            made += 1
        bins[i], offsets[i] = at, capacity - room
        room -= n
        if room:
            stacks[room].append(at)
            open_rooms |= 1 << room
    return bins, offsets, made


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of several dual-feasible-function bounds on the bins that ``lengths`` need."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    below, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    # Items over capacity - e count as one bin, items under e as nothing, the others as their share.
    e = np.arange(0, capacity // 2 + 1)
    large = below[-1] - below[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    best = int((large - (-middle // capacity)).max())
    # Staircase functions with k steps; multiples of capacity / (k + 1) keep their own share.
    for k in range(1, 33):
        steps = (k + 1) * size
        whole = steps % capacity == 0
        share = np.where(whole, size * k, steps // capacity * capacity)
        best = max(best, int(-(-int((share * count).sum()) // (k * capacity))))
    return best


def _pack(step: int, capacity: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        bins, offsets, made = best_fit_decreasing(lengths, capacity)
        free = capacity - np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
        released = np.zeros(made, bool)
        if not last:
            gap = made - lower_bound(lengths, capacity)
            order = np.argsort(-free, kind="stable")
            before = np.cumsum(free[order]) - free[order]
            released[order[(before < (gap + 1) * capacity) & (free[order] > 0)]] = True
        group = int(frame["pack_group"].iloc[0]) if len(frame) else 0
        frame["sequence_id"] = (step << 48) + (group << 24) + bins
        frame["offset"] = offsets
        frame["released"] = released[bins]
        return frame.drop(columns="pack_group")

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the closing id, cut at the capacity."""
    lean_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(tokenizer, capacity, end), _PIECES)


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``items`` (see ``pieces``) with sequence_id and offset, in as few sequences as the rounds find."""
    left, step, kept = written(items, "pieces"), 0, []
    schema = f"{_PIECES}, sequence_id long, offset long, released boolean"
    columns = [f.split()[0] for f in _PIECES.split(", ")]
    groups = None
    while True:
        n = left.count()
        wanted = -(-n // group)
        groups = max(1, wanted if groups is None else min(wanted, groups // 2))
        # Dealt by place too, so that one row repeated many times goes to all groups.
        dealt = left.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(step)), F.lit(groups)))
        packed = written(dealt.groupBy("pack_group").applyInPandas(_pack(step, capacity, groups == 1), schema), f"packed-{step}")
        forget(left)
        kept.append(packed.where("not released").select(*columns, "sequence_id", "offset"))
        if groups == 1:
            break
        left, step = written(packed.where("released").select(*columns), f"released-{step}"), step + 1
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(pieces(docs, id_col, text_col, tokenizer, capacity), capacity)
