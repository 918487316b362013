"""Stretches of words that repeat with a period: every maximal run, by the runs theorem.

A run is a stretch of consecutive words whose smallest period p it repeats, which no neighbouring
word continues. Each run holds a Lyndon word of length p (a root) that is the longest one starting
at its place, under one of the two orders of the words. So, in each task and for some documents at
a time:

1. words become numbers and their suffixes are ranked by prefix doubling (the inverse suffix array);
   every document ends in a mark of its own, smaller than all words;
2. the longest Lyndon word at a place ends before the next smaller value of the inverse suffix
   array; under the opposite order, which reverses the ranks, before the next greater one;
3. a root is extended to the right by the longest common prefix of its place and the place after
   it, to the left likewise on the reversed words: least values of an LCP array over a range, which
   a sparse table over blocks answers for all roots at once;
4. equal stretches of several roots are one run.

With ``exponent`` times the period as the shortest run, the first root of a run goes on for more than
``exponent - 2`` periods after its first copy begins, so roots that don't need no extension, and documents
without any that does no LCP array.

Documents stay where they are read: nothing is shuffled, and memory follows ``WORDS`` words or the
longest text. Texts are read whole. Defined results: a null, empty or blank text has no runs and an
empty collapsed text; words are compared by their bytes; rows repeated whole are judged alike;
columns of the input keep their names, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askgrid.llm.textcore import as_bytes, release
from askgrid.llm.workspace import free_name, lean_batches

#: Words of documents that are worked on together; a longer text is worked on alone.
WORDS = 1 << 15
_BLOCK = 16

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _turns(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it, the first place included."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _alone(first: np.ndarray) -> np.ndarray:
    """Groups of one, by where groups begin."""
    out = first.copy()
    out[:-1] &= first[1:]
    return out


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The inverse suffix array, by prefix doubling among those suffixes that are still tied.

    Every suffix must come to a symbol that occurs once.
    """
    n = len(symbols)
    tied = np.argsort(symbols)
    first = _turns(symbols[tied])
    rank = np.empty(n, np.int64)
    rank[tied] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied, step = tied[~_alone(first)], 1
    while len(tied):
        key = rank[tied] * n + rank[tied + step]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        old, place = rank[tied], np.arange(len(tied))
        first = _turns(key)
        rank[tied] = old + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(_turns(old), place, 0))
        tied, step = tied[~_alone(first)], 2 * step
    return rank


class _Least:
    """Least values of ranges: within blocks from their ends, and a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // _BLOCK)
        grid = np.full((blocks, _BLOCK), np.iinfo(np.int64).max)
        self.values = grid.ravel()
        self.values[: len(values)] = values
        self.table = [grid.min(1)]
        while len(self.table[-1]) > (step := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The least value of a place's block up to it, and from it on."""
        grid = self.values.reshape(-1, _BLOCK)
        return np.minimum.accumulate(grid, 1).ravel(), np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low .. high], both included."""
        left, right = low // _BLOCK, high // _BLOCK
        to, of = self.ends
        out = np.minimum(of[low], to[high])
        between = right - left - 1
        level = np.where(between > 0, np.frexp(between.astype(np.float64))[1] - 1, -1)
        for k, least in enumerate(self.table):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(out[at], np.minimum(least[left[at] + 1], least[right[at] - (1 << k)]))
        at = np.flatnonzero(left == right)
        out[at] = self.values[low[at]]
        for step in range(1, _BLOCK):
            out[at] = np.minimum(out[at], self.values[np.minimum(low[at] + step, high[at])])
        return out

    def next_smaller(self, n: int) -> np.ndarray:
        """The first later place of a smaller value, for each of the first ``n``; ``n`` where there is none."""
        out = np.full(n, n)
        open_, x = np.arange(n), self.values[:n]
        for step in range(1, _BLOCK + 1):
            open_ = open_[open_ + step < n]
            found = self.values[open_ + step] < x[open_]
            out[open_[found]] = open_[found] + step
            open_ = open_[~found]
        # What is left begins in a later block: skip as many whole blocks without a smaller value as there are.
        x, block = x[open_], (open_ + _BLOCK) // _BLOCK
        for k in range(len(self.table) - 1, -1, -1):
            least = self.table[k]
            fits = block < len(least)
            fits[fits] = least[block[fits]] >= x[fits]
            block[fits] += 1 << k
        some = block < len(self.table[0])
        open_, x, block = open_[some], x[some], block[some]
        out[open_] = block * _BLOCK + (self.values.reshape(-1, _BLOCK)[block] < x[:, None]).argmax(1)
        return out


class _Common:
    """Lengths of the longest common prefixes of suffixes of one document."""

    def __init__(self, symbols: np.ndarray, rank: np.ndarray):
        self.rank = rank
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        words, ranks, before = symbols.tolist(), rank.tolist(), order.tolist()
        lcp, h = [0] * len(words), 0
        for i, r in enumerate(ranks):
            if words[i] < 0:  # a document's end
                h = 0
                continue
            j = before[r - 1]
            while words[i + h] == words[j + h]:
                h += 1
            lcp[r] = h
            h -= h > 0
        self.least = _Least(np.array(lcp, np.int64))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def _symbols(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document, start of each document): the words of all documents, each with its own end, -1 - document."""
    starts = np.cumsum(sizes + 1) - sizes - 1
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    symbols = np.empty(len(doc), np.int64)
    ends = np.zeros(len(doc), bool)
    ends[starts + sizes] = True
    symbols[ends], symbols[~ends] = -1 - np.arange(len(sizes)), words
    return symbols, doc, starts


def _ranked(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ranks of suffixes, documents in order: those of a document are its places."""
    return suffix_ranks(doc * (symbols.max() + 2) + np.maximum(symbols, -1) + 1)


def maximal_runs(words: np.ndarray, sizes: np.ndarray, shortest: int = 6, exponent: int = 4) -> np.ndarray:
    """(document, start, length, period) of every run of ``shortest`` words and ``exponent`` periods or more, in order.

    ``words`` are the numbers (0 and up) of all documents' words, ``sizes`` how many each has.
    ``exponent`` is 2 at least: what repeats less often is no run.
    """
    symbols, doc, starts = _symbols(words, sizes)
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return none
    rank = _ranked(symbols, doc)
    end = np.repeat(starts + sizes, sizes + 1)
    roots = []
    for after in (_Least(rank).next_smaller(len(rank)), _Least(-rank).next_smaller(len(rank))):
        # The first root of a run goes on for exponent - 2 periods and a word; compare a few words before all are.
        last = after + (exponent - 2) * (after - np.arange(len(after)))
        i = np.flatnonzero((last < end) & (symbols == symbols[np.minimum(after, len(after) - 1)]))
        roots.append((i, after[i], last[i] - after[i]))
    i, j, ahead = (np.concatenate(x) for x in zip(*roots))
    for part in (0.5, 1.0):
        step = (part * ahead).astype(np.int64)
        near = symbols[i + step] == symbols[j + step]
        i, j, ahead = i[near], j[near], ahead[near]
    if not len(i):
        return none
    # Only documents with such roots go on.
    some = np.zeros(len(sizes), bool)
    some[doc[i]] = True
    number, new = np.flatnonzero(some), np.cumsum(some) - 1
    inside = some[doc]
    own_symbols, own_doc, own_starts = _symbols(symbols[inside & (symbols >= 0)], sizes[some])
    shift = (own_starts[new] - starts)[doc]
    i, j, doc_of = i + shift[i], j + shift[i], new[doc[i]]
    right = _Common(own_symbols, rank[inside] + shift[inside])(i, j)
    near = right > ahead
    i, j, right, doc_of = i[near], j[near], right[near], doc_of[near]
    if not len(i):
        return none
    # The words of each document from its last to its first: a place's image is its own image's.
    image = np.where(own_symbols < 0, np.arange(len(own_symbols)), (2 * own_starts + sizes[some] - 1)[own_doc] - np.arange(len(own_symbols)))
    back = own_symbols[image]
    left = np.zeros(len(i), np.int64)
    has = i > own_starts[doc_of]
    left[has] = _Common(back, _ranked(back, own_doc))(image[i[has] - 1], image[j[has] - 1])
    start, length, period = i - left - own_starts[doc_of], j + right - i + left, j - i
    long = length >= np.maximum(shortest, exponent * period)
    return np.unique(np.stack([number[doc_of], start, length, period], 1)[long], axis=0)


def _rows(batch: pa.RecordBatch, at: int, shortest: int, exponent: int) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """(first row, number of rows, runs, collapsed texts) of documents that are worked on together."""
    texts: list[list[bytes]] = []
    begin = n = 0

    def done() -> tuple[int, int, pa.Array, pa.Array]:
        codes: dict[bytes, int] = defaultdict(count().__next__)
        sizes = np.array([len(t) for t in texts], np.int64)
        words = np.fromiter(map(codes.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        found = maximal_runs(words, sizes, shortest, exponent)
        # A run's first period stays, and what follows it goes.
        starts = np.cumsum(sizes) - sizes
        change = np.zeros(len(words) + 1, np.int64)
        first = starts[found[:, 0]] + found[:, 1]
        np.add.at(change, first + found[:, 3], 1)
        np.add.at(change, first + found[:, 2], -1)
        keep = np.cumsum(change[:-1]) == 0
        has = np.bincount(found[:, 0], minlength=len(sizes))
        kept = [b" ".join(t if not has[k] else [w for w, stays in zip(t, keep[starts[k] : starts[k] + len(t)].tolist()) if stays]) for k, t in enumerate(texts)]
        offsets = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(RUN))
        return begin, len(texts), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(kept, pa.binary()).cast(pa.string())

    for k, body in enumerate(as_bytes(batch.column(at))):
        words = [] if body is None else body.tobytes().split()
        if texts and n + len(words) > WORDS:
            yield done()
            texts, begin, n = [], k, 0
        texts.append(words)
        n += len(words)
    if texts:
        yield done()


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shortest: int = 6, exponent: int = 4) -> DataFrame:
    """The columns ``keep`` (all of them without it) with each text's runs and the text without what repeats.

    ``runs`` is a list of (start, length, period) in words, by start and then period; ``collapsed``
    holds the words outside of the runs and each run's first period, joined by single spaces. Where
    the input has columns of these names, ``ag_`` is put in front.
    """
    lean_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    runs, collapsed = free_name(keep, "runs"), free_name(keep, "collapsed")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    inside = docs.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` AS `_ag_text`")
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{runs}` array<struct<start: bigint, length: bigint, period: bigint>>", f"`{collapsed}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n, found, kept in _rows(batch, len(keep), shortest, exponent):
                yield pa.RecordBatch.from_arrays([*(c.slice(begin, n) for c in batch.columns[:-1]), found, kept], [*keep, runs, collapsed])
        release()

    return inside.mapInArrow(run, out)
