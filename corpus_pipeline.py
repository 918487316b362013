"""The corpus pipeline: language, toxicity, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller may write and
read again; all but the last return exactly the columns of their input, extra ones with any names
included. An empty table passes through; rows whose text is null or has no letters are rejected by
the first stage; ties of languages go to the first by name, and a score of just 0.5 is toxic. Rows
repeated whole are judged alike by the first three stages, and one of them stays after the fourth;
rows that share a doc_id but not the text count as one document there, near to whatever one of
them is near to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import language, linededup, neardup, packing, toxicity
from askgrid.llm.workspace import forget, table, written

#: Percent of shared five-word shingles from which documents count as near duplicates.
NEAR = 80


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language that the evidence supports."""
    return language.keep_known(docs, language.fit(docs), host=F.col("source"), declared=language.markup_language(F.col("text")))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are likelier toxic than not."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated lines and line runs; the length follows the text."""
    length = F.char_length("text").cast("long").alias("n_chars")
    return linededup.delete_repeats(docs).select(*[length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates."""
    verdicts = written(neardup.near_duplicates(docs, percent=NEAR), "verdicts")
    few = lambda ids: F.broadcast(ids) if ids.count() <= neardup.BROADCAST_IDS else ids
    left = docs.join(few(verdicts.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    again = verdicts.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    # Rows of one doc_id are rare: only they are compared whole.
    once = left.join(few(again), "doc_id", "left_semi").select(*docs.columns).distinct()
    return left.join(few(again), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("packing", pack),
]

#: Trained models, minwise trees and tokenisation are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it; what a stage has read goes then.

    What the last stage reads stays until ``workspace.sweep``, which a caller may call once the
    result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
