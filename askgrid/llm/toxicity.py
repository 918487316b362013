"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its hashed character n-grams (3 to 6 bytes, word
ends included) and of the word itself, so a misspelling shares most of its vector with what it
imitates. A segment of ``SEGMENT`` words is the average of its words, goes through a linear
softmax, and a document is as toxic as its most toxic segment: one insult in a long text isn't
averaged away. Embeddings and softmax are trained jointly in numpy (Adam) in one task, on a
bounded sample of labelled rows: ``MAX_TOXIC`` and ``MAX_CLEAN`` rows and ``MAX_TRAIN_BYTES``
of text at most, chosen by hash; the driver sees the trained numbers only. Rows with crc32(doc_id as text) mod 5 = 0 are never learnt from.

As the layers are linear, a trained model collapses into one number a bucket: scoring is a
vectorised pass over the bytes of every whole text.

Defined results: null or blank text has no segment and gets the score of the bias alone;
a null doc_id is scored and not held out; without labels every score is the smoothed prior;
an id whose label rows differ is toxic, and of several texts under one id the first in order is
learnt from; rows repeated whole are each scored; equal scores are equally judged; columns that
are added have names of their own output, the input's others being left out or untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm import textcore
from askgrid.llm.workspace import lean_batches

BUCKETS, DIMENSIONS, SEGMENT = 1 << 17, 16, 8
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 3000, 6000, 48_000_000
_GRAMS = (3, 4, 5, 6)
RATE = (0.5, 0.05, 0.2)
#: ASCII but letters and digits separates words; bytes of other characters belong to them.
_BREAK = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_BYTE, _STEP = textcore.stream(21, 256), textcore.stream(22, 8) | np.uint64(1)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all n-grams and words of a text, the word each belongs to, and the number of words."""
    body = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    gap = _BREAK[body]
    body = np.where(gap, np.uint8(32), body)
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), 0
    word_of = np.cumsum(gap[:-1] & ~gap[1:]) - 1  # of the byte that follows
    gaps = np.concatenate([[0], np.cumsum(gap)])
    value = _BYTE[body]
    buckets, owners = [(textcore.hash_spans(body, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)], [np.arange(len(starts))]
    for n in _GRAMS:
        m = len(body) - n + 1
        if m < 1:
            break
        at = np.flatnonzero(gaps[n - 1 : n - 1 + m] == gaps[1 : 1 + m])
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total += value[at + j] * _STEP[j]
        buckets.append((textcore.mix(total + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(word_of[at])
    return np.concatenate(buckets), np.concatenate(owners), len(starts)


class Model:
    """Embeddings (BUCKETS x DIMENSIONS), softmax weights and bias; ``weights`` is their collapsed form."""

    def __init__(self, embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
        self.embeddings, self.softmax, self.bias = embeddings, softmax, bias
        self.weights = embeddings @ (softmax[:, 1] - softmax[:, 0])
        self.offset = float(bias[1] - bias[0])


def _score(weights: np.ndarray, offset: float, text: str) -> float:
    buckets, owners, n = subwords(text)
    best = 0.0
    if n:
        words = np.bincount(owners, weights[buckets], n) / np.bincount(owners, minlength=n)
        first = np.arange(0, n, SEGMENT)
        best = float((np.add.reduceat(words, first) / np.minimum(SEGMENT, n - first)).max())
    return float(1 / (1 + np.exp(-np.clip(best + offset, -700, 700))))


def score(model: Model, text: str | None) -> float:
    return _score(model.weights, model.offset, text or "")


def train(texts: list[str], toxic: list[int], steps: int = 140, seed: int = 5) -> Model:
    """Joint full-batch training; the first steps average all segments, the others follow each text's most toxic one."""
    y = np.asarray(toxic, np.float64)
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.001, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 3))
    bias = np.array([-prior / 2, prior / 2], np.float32)
    if not y.any() or y.all():
        return Model(embeddings * 0, softmax, bias)

    # Distinct words once: their n-grams in CSR form, and the texts as runs of word numbers.
    known: dict[str, int] = {}
    runs, lengths = [], []
    for text in texts:
        body = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        words = np.where(_BREAK[body], np.uint8(32), body).tobytes().decode("utf-8", "replace").split(" ")
        runs.append(np.array([known.setdefault(w, len(known)) for w in words if w], np.int32))
        lengths.append(len(runs[-1]))
    n_words, every, held = len(known), list(known), []
    del known
    for at in range(0, n_words, 20_000):
        own, owners, n = subwords(" ".join(every[at : at + 20_000]))
        held.append((own[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=n)))
    buckets, grams = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int32) for k in (0, 1))
    del every, held
    first_gram = np.cumsum(grams) - grams
    some = np.array(lengths) > 0
    y, lengths = y[some], np.array(lengths)[some]
    if not len(y):
        return Model(embeddings * 0, softmax, bias)
    tokens = np.concatenate(runs)
    text_at = np.cumsum(lengths) - lengths
    segments = -(-lengths // SEGMENT)
    first_segment = np.cumsum(segments) - segments
    owner = np.repeat(np.arange(len(y)), segments)
    start = text_at[owner] + SEGMENT * (np.arange(segments.sum()) - first_segment[owner])
    size = np.minimum(SEGMENT, np.append(start[1:], len(tokens)) - start).astype(np.float64)

    parts = [embeddings, softmax, bias]
    # One step size for a whole layer: what many texts agree on moves first, and rare words, which could be learnt by heart, hardly move.
    moments, scale = [np.zeros_like(p) for p in parts], [0.0, 0.0, 0.0]
    for step in range(1, steps + 1):
        weights = embeddings @ (softmax[:, 1] - softmax[:, 0])
        words = np.add.reduceat(weights[buckets], first_gram) / grams
        value = np.add.reduceat(words[tokens], start) / size
        if step <= steps // 4:
            mean = np.add.reduceat(value, first_segment) / segments
            slope = (1 / (1 + np.exp(-(mean + bias[1] - bias[0]))) - y) / len(y)
            on_segment = (slope / segments)[owner]
        else:
            top = np.maximum.reduceat(value, first_segment)
            slope = (1 / (1 + np.exp(-(top + bias[1] - bias[0]))) - y) / len(y)
            hit = np.flatnonzero(value == top[owner])
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
            on_segment = np.zeros(len(value))
            on_segment[hit] = slope[owner[hit]]
        live = np.flatnonzero(on_segment)
        n = size[live].astype(np.int64)
        inside = np.repeat(start[live] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        on_word = np.bincount(tokens[inside], np.repeat(on_segment[live] / size[live], n), n_words)
        used = np.flatnonzero(on_word)
        on_bucket = np.zeros(BUCKETS)
        for at in range(0, len(used), 20_000):
            some = used[at : at + 20_000]
            n = grams[some]
            inside = np.repeat(first_gram[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            on_bucket += np.bincount(buckets[inside], np.repeat(on_word[some] / n, n), BUCKETS)
        on_bucket = on_bucket.astype(np.float32)
        push = (softmax[:, 1] - softmax[:, 0])[None, :] * on_bucket[:, None]
        pull = embeddings.T @ on_bucket
        tilt = np.float32(slope.sum())
        for k, g in enumerate((push, np.stack([-pull, pull], 1), np.array([-tilt, tilt], np.float32))):
            m = moments[k]
            m += 0.1 * (g - m)
            scale[k] += 0.05 * (float((g * g).max()) - scale[k])
            parts[k] -= RATE[k] * (m / (1 - 0.9**step)) / ((scale[k] / (1 - 0.95**step)) ** 0.5 + 1e-12)
    return Model(embeddings, softmax, bias)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(id, toxic, text) of the bounded sample: labelled rows outside the held-out fold, in hash order, within the row and byte bounds."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        own = known.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    # Bounded by MAX_TOXIC + MAX_CLEAN rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "id").where("text is not null")
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sizes = sorted(rows.select(F.xxhash64("id").alias("h"), "id", F.octet_length("text").alias("size")).collect())
    total, chosen = 0, []
    for r in sizes:
        if total + r["size"] <= MAX_TRAIN_BYTES:
            total += r["size"]
            chosen.append(r["id"])
    if not chosen:
        return None
    some = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
    return rows.join(F.broadcast(some), "id").select("id", "toxic", "text")


def _train_task(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id")
    model = train(frame["text"].tolist(), frame["toxic"].tolist())
    textcore.release()
    return pd.DataFrame({"embeddings": [model.embeddings.tobytes()], "softmax": [model.softmax.tobytes()], "bias": [model.bias.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained where the sample is gathered: the rows of one bounded group."""
    rows = training_rows(docs, labels)
    if rows is None:
        return train([], [])
    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_train_task, "embeddings binary, softmax binary, bias binary").first()
    grid = lambda k, *shape: np.frombuffer(bytes(got[k]), np.float32).reshape(shape)
    return Model(grid("embeddings", BUCKETS, DIMENSIONS), grid("softmax", DIMENSIONS, 2), grid("bias", 2))


def _scores(weights: np.ndarray, offset: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_score(weights, offset, t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])
        textcore.release()

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    weights, offset = model.weights.astype(np.float32), model.offset
    lean_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(_scores(weights, offset), f"`{id_col}` long, score double")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    weights, offset = model.weights.astype(np.float32), model.offset

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        found = [_score(weights, offset, t.as_py() or "") for t in texts]
        textcore.release()
        return pa.array(found, pa.float64())

    lean_batches(docs.sparkSession)
    return docs.where(scores(F.col(text_col).cast("string")) < 0.5)
