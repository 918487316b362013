"""SentencePiece encoding and decoding by a relational lattice.

A text is normalised (spaces become the meta symbol, one is put in front) and cut into words where
no piece can reach across: before a meta symbol, and between two characters that no piece holds
side by side. Only distinct words are encoded: their bounded-length substrings are exploded, equi-joined
to the piece table and grouped by word, and a higher-order aggregate folds each word's edges.

Two folds exist. A unigram model takes Viterbi's: the best score at each place in the word. A
byte-pair model (which the public vocabulary is) has merge ranks for scores, whose sum means
nothing, so Viterbi would not give the ids that the library gives; its fold keeps the word's
boundaries as a bit set and removes, until none is left, the boundary whose edge has the best
score. Words over ``LATTICE_CHARS`` characters, of which a bit set can't hold the boundaries, are
merged with a heap in Python.

A text is read twice: a bounded sample of rows to find ``FREQUENT`` frequent words, which are
encoded and broadcast (what they are changes no result), and then all texts once. Each task puts
units of ``UNIT_BYTES`` of text down in a table bucketed by groups of ``GROUP`` units: every word as
a code, the broadcast words by their place there, the unit's other words by their place in a list
of its own. Those lists alone are shuffled: their distinct words are encoded, joined back and
cogrouped with the units, which stay where they are, so that whole id sequences are put together
in place. A group's sequences are in memory at once, and a group is a file at most, so the two
constants should grow with executors.
Words are dealt in partitions of ``WORDS``, so one partition's edges are gathered in memory.

Defined results: null and empty texts have no pieces; characters that no piece holds are encoded
as bytes; a meta symbol in a text is decoded as a space; rows repeated whole, and rows of one
doc_id, each have their own result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import textcore
from askgrid.llm.workspace import bucketed, forget, lean_batches, written

META = "▁"
LATTICE_CHARS, FREQUENT, WORDS = 62, 400_000, 10_000
SAMPLE_BYTES, UNIT_BYTES, GROUP = 32 << 20, 4 << 20, 2
_FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: Kinds of pieces, and models, in the file format.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        part = data[at : at + size]
        at += size
        yield key >> 3, struct.unpack("<f", part)[0] if kind == 5 else part


class Cutter:
    """Cuts runs, meta symbols and what follows them, into words: where no piece holds the two characters that meet."""

    def __init__(self, joined: frozenset[str]):
        letters = sorted({c for pair in joined for c in pair})
        self.place = np.zeros(0x110000, np.int32)  # of each character that some pair has, from 1
        for k, c in enumerate(letters, 1):
            self.place[ord(c)] = k
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for pair in joined:
            self.joined[self.place[ord(pair[0])], self.place[ord(pair[1])]] = True

    def __call__(self, runs: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all runs, and the number of each run's words; runs are cut together."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs), "")[0].as_py() or ""
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = self.place[points]
        ends = np.cumsum(pc.utf8_length(runs).to_numpy(zero_copy_only=False), dtype=np.int64)
        cut = np.zeros(len(points) + 1, bool)
        cut[1:-1] = ~self.joined[at[:-1], at[1:]]
        cut[0] = True
        cut[ends] = True
        edges = np.flatnonzero(cut)
        size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])[edges]
        words = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole.encode()))
        return words.cast(pa.string()), np.diff(np.searchsorted(edges, ends), prepend=0)


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]  # text, score, kind; the place is the id
    kind: int
    dummy_prefix: bool

    @property
    def longest(self) -> int:
        return max((len(t) for t, _, k in self.pieces if k in (NORMAL, USER)), default=1)

    @property
    def byte_ids(self) -> dict[int, int]:
        return {int(t[3:5], 16): i for i, (t, _, k) in enumerate(self.pieces) if k == BYTE}

    @property
    def unknown(self) -> int:
        return next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)

    def cutter(self) -> Cutter:
        return Cutter(frozenset(t[i : i + 2] for t, _, k in self.pieces if k in (NORMAL, USER) for i in range(len(t) - 1)))


def load(path: str) -> Model:
    pieces, kind, prefix = [], UNIGRAM, True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), float(own.get(2, 0.0)), int(own.get(3, NORMAL))))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models without a character map and with all their spaces are supported")
    if any(META in t.lstrip(META) for t, _, k in pieces if k in (NORMAL, USER)):
        raise ValueError("pieces that reach across words are not supported")
    return Model(tuple(pieces), kind, prefix)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, piece_id, score) of the pieces that a text can hold: a fixed few ten thousand rows."""
    rows = [(t, i, s) for i, (t, s, k) in enumerate(model.pieces) if k in (NORMAL, USER)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "piece_id", "score"]), "piece string, piece_id int, score double")


def _bytes_of(text: Column, model: Model) -> Column:
    """Ids of the bytes of one character, or the unknown id where the model has none."""
    if not model.byte_ids:
        return F.array(F.lit(model.unknown))
    first = model.byte_ids[0]
    code = F.hex(F.encode(text, "utf-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + first)


def lattice(words: DataFrame, pieces: DataFrame, longest: int, bits: bool = False) -> DataFrame:
    """``words`` with edges: every piece in a word, and characters without one, as (rank, first, last, piece_id); with
    ``bits``, for words short enough, as (rank, ends, inner, piece_id), ends and inner being boundaries as bits.

    ``words`` come dealt by word; explode and broadcast join keep that partitioning, so grouping
    the edges by word moves nothing. What an edge is made of is computed before the join, in
    generated code: inside the aggregate it would be interpreted, row by row.
    """
    keys = words.columns
    starts = words.select(*keys, F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("first"))
    # Pieces are cut from the longest one that can begin at their place: cutting each from the whole word takes five times as long.
    starts = starts.select(*keys, "first", F.substring(F.col("word"), F.col("first") + 1, F.lit(longest)).alias("tail"))
    spans = starts.select(*keys, "first", "tail", F.explode(F.sequence(F.lit(1), F.char_length("tail"))).alias("size"))
    spans = spans.select(*keys, "first", (F.col("first") + F.col("size")).alias("last"), F.left("tail", F.col("size")).alias("piece"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    place = [bit(F.col("first")).bitwiseOR(bit(F.col("last"))).alias("ends"), (bit(F.col("last")) - bit(F.col("first") + 1)).alias("inner")] if bits else []
    pieces = pieces.select("piece", "piece_id", (-F.col("score")).alias("rank"))
    met = spans.select("*", *place).join(F.broadcast(pieces), "piece", "left").where("piece_id is not null or last - first = 1")
    # Best score first, then leftmost, when sorted.
    edge = F.struct("rank", "ends", "inner", "piece_id") if bits else F.struct("rank", "first", "last", "piece_id")
    return met.groupBy(*keys).agg(F.collect_list(edge).alias("edges"))


def _merge_fold() -> Column:
    """The boundaries that are left of a word after all merges, from its edges.

    A step removes the boundary inside the best edge that has both ends and just one between. The
    sign bit says that there was none, and spares the remaining steps. The ranked edges are bound
    to a name by a lambda of their own: named by a column, they would be ranked again in each step.
    """
    long = lambda x: F.lit(x).cast("long")
    n, none = F.char_length("word"), long(-(2**63))
    start = F.call_function("shiftleft", long(1), n + 1) - 1
    ranked = F.filter(F.sort_array("edges"), lambda e: e["inner"] != 0)

    def folded(ranked: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            ready = lambda e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1)
            bit = F.aggregate(ranked, none, lambda found, e: F.when((found < 0) & ready(e), state.bitwiseAND(e["inner"])).otherwise(found))
            return F.when(state < 0, state).otherwise(state.bitwiseXOR(bit))

        return F.aggregate(F.sequence(F.lit(1), n), start, step)

    return F.get(F.transform(F.array(ranked), folded), F.lit(0))


def _kept_ids(model: Model) -> Column:
    """Ids of the edges whose ends are boundaries and that hold none."""
    state = F.col("state")
    kept = F.filter("edges", lambda e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (state.bitwiseAND(e["inner"]) == 0))
    ordered = F.sort_array(F.transform(kept, lambda e: F.struct(e["ends"].alias("ends"), e["piece_id"].alias("id"))))
    plain = F.transform(ordered, lambda e: e["id"])
    first = lambda e: F.bit_count(e["ends"].bitwiseAND(-e["ends"]) - 1)  # noqa: E731  the lowest bit's place
    spelt = F.flatten(F.transform(ordered, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(_bytes_of(F.substring(F.col("word"), first(e) + 1, F.lit(1)), model))))
    return F.when(F.exists(plain, lambda x: x.isNull()), spelt).otherwise(plain)


def _viterbi_fold(model: Model) -> Column:
    """Ids of a word on its best path, as the unigram model scores it; a character without a piece costs more than any piece."""
    worst = min((s for _, s, k in model.pieces if k == NORMAL), default=0.0) - 10.0
    place = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<int>").alias("ids"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))), F.array_repeat(place, F.char_length("word")))
    edges = F.array_sort(F.transform("edges", lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last"), F.coalesce(-e["rank"], F.lit(worst)).alias("score"), e["piece_id"].alias("id"))))

    def step(state: Column, e: Column) -> Column:
        ids = F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(_bytes_of(F.substring(F.col("word"), e["first"] + 1, F.lit(1)), model))
        reached = F.get(state, e["first"])
        total = reached["score"] + e["score"]
        better = lambda x: x["score"].isNull() | (total > x["score"])
        return F.transform(state, lambda x, i: F.when((i == e["last"]) & better(x), F.struct(total.alias("score"), F.concat(reached["ids"], ids).alias("ids"))).otherwise(x))

    return F.element_at(F.aggregate(edges, start, step), -1)["ids"]


def merge_word(word: str, ranks: dict[str, tuple[int, float]], byte_ids: dict[int, int], unknown: int) -> list[int]:
    """Byte-pair merges of one long word, with a heap of candidate merges."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if i >= 0 and j < n and (found := ranks.get(word[i : end[j]])):
            heapq.heappush(heap, (-found[1], i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, last = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != last:
            continue
        alive[j], end[i], after[i] = False, last, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    ids: list[int] = []
    for i in range(n):
        if alive[i]:
            piece = word[i : end[i]]
            ids += [ranks[piece][0]] if piece in ranks else [byte_ids.get(b, unknown) for b in piece.encode()] if byte_ids else [unknown]
    return ids


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """``words``, distinct normalised ones dealt by the column word, with ids."""
    spark, keys = words.sparkSession, words.columns
    if model.kind != BPE:
        return lattice(words, piece_table(spark, model), model.longest).select(*keys, _viterbi_fold(model).alias("ids"))
    ranks = {t: (i, s) for i, (t, s, k) in enumerate(model.pieces) if k in (NORMAL, USER)}
    bytes_, unknown = model.byte_ids, model.unknown

    @F.arrow_udf("array<int>")
    def merged(found: pa.Array) -> pa.Array:
        return pa.array([merge_word(w.as_py(), ranks, bytes_, unknown) for w in found], pa.list_(pa.int32()))

    short = lattice(words.where(F.char_length("word") <= LATTICE_CHARS), piece_table(spark, model), model.longest, bits=True)
    short = short.withColumn("state", _merge_fold())
    short = short.select(*keys, _kept_ids(model).alias("ids"))
    long = words.where(F.char_length("word") > LATTICE_CHARS).select(*keys, merged("word").alias("ids"))
    return short.unionByName(long)


def _spelling(model: Model):
    """UTF-8 bytes of whole id sequences, piece after piece; null for null."""
    codes = pa.array([bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() if k in (NORMAL, USER) else b"" for t, _, k in model.pieces], pa.binary())

    def spelt(found: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), codes.take(found.flatten()))
        return pc.if_else(found.is_valid(), pc.binary_join(parts, b""), pa.scalar(None, pa.binary()))

    return spelt


def _text_of(spelt: Column, model: Model) -> Column:
    """The text that bytes spell; the meta symbol becomes a space again, the one put in front is dropped."""
    plain = F.replace(F.make_valid_utf8(spelt.cast("string")), F.lit(META), F.lit(" "))
    return F.substring(plain, 2, 2**31 - 1) if model.dummy_prefix else plain


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans: from each start so many as its size says. They number below 2^31 in a unit."""
    out = np.repeat(starts.astype(np.int32) - (np.cumsum(sizes, dtype=np.int32) - sizes.astype(np.int32)), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class _Splitter:
    """Texts as words: which distinct words a batch of texts has, and each text's words in order."""

    def __init__(self, model: Model):
        self.cut, self.prefix = model.cutter(), model.dummy_prefix

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words, number of words of each text, place among the distinct of each word)."""
        spaced = pc.replace_substring(pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts), META, " ")
        lists = pc.split_pattern(spaced, " ")
        each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        del spaced
        tokens = lists.flatten().dictionary_encode()
        code, known = tokens.indices.to_numpy(), tokens.dictionary.cast(pa.string())
        if not len(code):
            return pa.array([], pa.string()), each * 0, np.zeros(0, np.int64)
        # Each token has a meta symbol in front; empty ones leave theirs to the run that follows.
        empty = code == pc.index(known, "").as_py()
        head = np.zeros(len(code), bool)
        head[(np.cumsum(each) - each)[each > 0]] = True
        begins = head.copy()
        begins[1:] |= ~empty[:-1]
        first = np.flatnonzero(begins).astype(np.int32)
        size = np.diff(np.append(first, np.int32(len(code))))
        run = code[first + size - 1]
        metas = size if self.prefix else size - head[first]
        odd = metas != 1
        pairs, place = np.unique(metas[odd].astype(np.int64) << 32 | run[odd], return_inverse=True)
        run[odd] = len(known) + place
        strange = [META * (p >> 32) + known[p & 0xFFFFFFFF].as_py() for p in pairs.tolist()]
        words, parts = self.cut(pa.concat_arrays([pc.binary_join_element_wise(META, known, ""), pa.array(strange, pa.string())]))
        words = words.dictionary_encode()
        of_text = np.repeat(np.arange(len(each), dtype=np.int32), each)[first]
        del tokens, lists, code, empty, head, begins, first, size, metas, odd
        parts = parts.astype(np.int32)
        inside, start, n = words.indices.to_numpy(), np.cumsum(parts, dtype=np.int32) - parts, parts[run]
        each = np.bincount(of_text, n, len(each)).astype(np.int64)
        return words.dictionary, each, inside[_spread(start[run], n)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows put together up to UNIT_BYTES, the text in the last column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= UNIT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _count_words(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _Splitter(model)
        for unit in _units(batches):
            words, _, found = split(unit.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(found, minlength=len(words)), pa.int64())], ["word", "n"])
        textcore.release()

    return run


def _grouped_in_memory(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with its lists gathered by hash: partitions of WORDS words fit, and need no sort of all edges on disk."""
    conf = df.sparkSession.conf
    before = conf.get(_FALLBACK)
    conf.set(_FALLBACK, str(10 * WORDS))
    try:
        return written(df, name)
    finally:
        conf.set(_FALLBACK, before)


def vocabulary(words: DataFrame, model: Model) -> DataFrame:
    """``words``, distinct ones in the column word, with ids, encoded by the lattice."""
    words = written(words, "words")
    parts = max(1, -(-words.count() // WORDS))
    out = _grouped_in_memory(encode_words(words.repartition(parts, "word"), model), "vocabulary")
    forget(words)
    return out


def frequent_words(docs: DataFrame, model: Model, most: int, total: int, text_col: str = "text") -> DataFrame:
    """(word): the ``most`` most frequent words of a sample of about SAMPLE_BYTES of text, in order of frequency."""
    some = docs.select(text_col).where(F.col(text_col) != "")
    if total > SAMPLE_BYTES:
        some = some.sample(SAMPLE_BYTES / total, 7)
    counted = some.mapInArrow(_count_words(model), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(most).select("word")


_UNIT = "grp long, unit int, doc_id array<long>, original array<binary>, there array<boolean>, n array<int>, codes binary, others array<string>"


def _packed(codes: np.ndarray) -> bytes:
    """Numbers below 2^32 by their bytes, the lowest of all first, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _put_down(model: Model, frequent):
    """Each unit of texts in one row, its words as codes; words that aren't frequent are listed."""
    schema = pa.schema([("grp", pa.int64()), ("unit", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("original", pa.list_(pa.binary())), ("there", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("codes", pa.binary()), ("others", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known, task = _Splitter(model), frequent.value, TaskContext.get().partitionId()
        for k, unit in enumerate(_units(batches)):
            words, each, found = split(unit.column(2))
            place = pc.index_in(words, value_set=known)
            other = place.is_null().to_numpy(zero_copy_only=False)
            code = np.where(other, np.int32(len(known) - 1) + np.cumsum(other, dtype=np.int32), pc.fill_null(place, 0).to_numpy(zero_copy_only=False))
            row = [task << 32 | k // GROUP, k, unit.column(0), unit.column(1), unit.column(2).is_valid(), pa.array(each, pa.int32()), _packed(code[found]), words.filter(pa.array(other))]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) if not isinstance(x, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x, f in zip(row, schema)], schema=schema)
            del unit, words, each, found, place, other, code, row  # before the next unit is read
            textcore.release()

    return run


def _put_together(frequent, spelt):
    """A group of units and the ids of their other words as whole id sequences, and with ``spelt`` what those spell."""

    def run(units: pa.Table, others: pa.Table) -> pa.Table:
        often, lengths = frequent.value
        others = others.sort_by([("part", "ascending"), ("code", "ascending")])
        of, lists = others["part"].to_numpy(), others["ids"].combine_chunks() if others.num_rows else pa.array([], pa.list_(pa.int32()))
        out = []
        for r in units.select(["unit", "doc_id", "original", "there", "n", "codes"]).to_batches(1):
            begin, end = np.searchsorted(of, r["unit"][0].as_py() + np.arange(2)).tolist()
            own = lists.slice(begin, end - begin)
            flat = np.concatenate([often, own.flatten().to_numpy()])
            sizes = np.concatenate([lengths, pc.list_value_length(own).to_numpy()])
            first = np.cumsum(sizes) - sizes
            codes, each = _unpacked(r["codes"][0].as_py()), r["n"][0].values.to_numpy()
            n = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[_spread(first[codes], n)]
            borders = ends[np.concatenate([[0], np.cumsum(each)])]
            sequences = pa.LargeListArray.from_arrays(pa.array(borders, pa.int64()), pa.array(ids, pa.int32()), mask=pc.invert(r["there"][0].values)).cast(pa.list_(pa.int32()))
            row = {"doc_id": r["doc_id"][0].values, "original": r["original"][0].values, "ids": sequences}
            out.append(pa.RecordBatch.from_pydict(row | ({"spelt": spelt(sequences)} if spelt else {})))
        textcore.release()
        return pa.Table.from_batches(out)

    return run


def _sequences(docs: DataFrame, model: Model, id_col: str, text_col: str, frequent: int, spelt: bool = False) -> DataFrame:
    """(doc_id, original, ids) of each row: the MD5 of its text and all its ids in order; with ``spelt``, the bytes that these decode to."""
    spark = docs.sparkSession
    lean_batches(spark)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("original"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = lambda x: spark.sparkContext.broadcast(x)
    often = frequent_words(docs, model, frequent, total).toArrow()["word"].combine_chunks()  # at most ``frequent``
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 26))
    units = bucketed(docs.mapInArrow(_put_down(model, share(often)), _UNIT), "units", "grp", buckets)
    listed = units.select(F.col("grp").alias("of"), F.col("unit").alias("part"), F.posexplode("others").alias("code", "word"))
    known = spark.createDataFrame(pa.table({"word": often, "place": pa.array(np.arange(len(often)), pa.int64())}))
    words = vocabulary(listed.select("word").distinct().withColumn("place", F.lit(None).cast("long")).unionByName(known), model)
    found = words.where("place is not null").orderBy("place").select("ids").toArrow()["ids"].combine_chunks()
    ids = share((found.flatten().to_numpy().astype(np.int32), pc.list_value_length(found).to_numpy().astype(np.int32)))
    others = listed.join(words.where("place is null").select("word", "ids"), "word").select("of", "part", "code", "ids")
    whole = units.drop("others").groupBy("grp").cogroup(others.groupBy("of"))
    return whole.applyInArrow(_put_together(ids, _spelling(model) if spelt else None), "doc_id long, original binary, ids array<int>" + ", spelt binary" * spelt)


def encode_digests(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_pieces, ids_digest, round_trip): piece count and xxhash64 of the row's id sequence, and whether decoding that gives the text back (by MD5; true for null)."""
    rows = _sequences(docs, model, id_col, text_col, frequent, spelt=True)
    back = F.unhex(F.md5(_text_of(F.col("spelt"), model).cast("binary")))
    pieces = F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("long")
    return rows.select("doc_id", pieces.alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"), back.eqNullSafe(F.col("original")).alias("round_trip"))


def encode_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, ids): the ids of each row's text, in order; null for null text."""
    return _sequences(docs, model, id_col, text_col, frequent).select("doc_id", "ids")


def decode_documents(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", _text_of(F.arrow_udf(_spelling(model), "binary")("ids"), model).alias("text"))
