"""Quality rules and a hashed n-gram importance score.

Two multinomials over ``BUCKETS`` hashed word unigrams and bigrams are estimated: the raw corpus
over all documents, the trusted target over all labelled rows of quality 1, whose ids reach the
texts by a broadcast while there are at most ``BROADCAST_IDS`` of them, and by a shuffled join
beyond. A document's score is its mean log likelihood ratio per n-gram, and
every document is decided by the same fixed threshold.

Defined results: null or blank text has no words, fails the base rules and is not kept; without
trusted rows the ratio is 0 for every document and the base rules decide alone; repeated rows
count and are scored once each; an id whose labels differ is trusted if one of them is 1. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm import textcore
from askgrid.llm.workspace import lean_batches

BUCKETS = 1 << 14
BROADCAST_IDS = 2_000_000
#: Mean log likelihood ratio per n-gram below which a document is dropped.
THRESHOLD = -0.05
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ngram_buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams."""
    pairs = textcore.windows(words, 2) if len(words) > 1 else words[:0]
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def base_figures(body: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int, int, int]]:
    """Word hashes and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text's bytes."""
    starts, ends = textcore.word_spans(body)
    words = textcore.hash_spans(body, starts, ends)
    points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    seen: set[bytes] = set()
    repeated = 0
    for line in body.tobytes().split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    covered = np.zeros(len(words), bool)
    if len(words) > 3:
        _, which, often = np.unique(textcore.windows(words, 3), return_inverse=True, return_counts=True)
        again = np.flatnonzero(often[which] > 1)
        for j in range(3):
            covered[again + j] = True
    return words, (len(words), int((points[ends] - points[starts]).sum()), int(_SYMBOL[body].sum()), repeated, int(covered.sum()))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for body, trusted in zip(textcore.as_bytes(batch.column(0)), batch.column(1).to_pylist()):
            if body is not None and len(body):
                own = np.bincount(ngram_buckets(textcore.word_hashes(body)), minlength=BUCKETS)
                raw += own
                if trusted:
                    target += own
    there = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(target[there])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket, add-one smoothed; raw counts cover every document."""
    lean_batches(docs.sparkSession)
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    trusted = trusted.withColumn("trusted", F.lit(True))
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    marked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = marked.join(trusted, "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = marked.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    # Half of the target's mass is the raw corpus itself: n-grams that a small trusted set happens to lack cost little.
    raw = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target / target.sum() / raw + 1) / 2)


def _judged(ratios: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, scores = [], []
            for body in textcore.as_bytes(batch.column(1)):
                words, figures = base_figures(body if body is not None else np.zeros(0, np.uint8))
                rows.append(figures)
                scores.append(float(ratios[ngram_buckets(words)].mean()) if len(words) else 0.0)
            table = np.array(rows, np.int64).reshape(-1, len(_BASE))
            failed = (table[:, 0] < 50) | (100 * table[:, 4] > 50 * table[:, 0])
            kept = ~failed & (np.array(scores) >= threshold)
            columns = [batch.column(0), *[pa.array(table[:, k]) for k in range(len(_BASE))], pa.array(failed), pa.array(scores, pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_BASE, "base_failed", "log_ratio", "kept"])

    return run


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures, log_ratio and the verdict ``kept`` for every row."""
    lean_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", base_failed boolean, log_ratio double, kept boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_judged(ratios, threshold), schema)
