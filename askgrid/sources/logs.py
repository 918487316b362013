"""Request and trace logs: JSON lines in two shapes, batch or streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.operators.chatlog import HISTORY, sampled
from askgrid.sources import xlsx

TRACE = "sessionId string, timestamp string, tags array<string>, input string, output string, metadata struct<history string>"
SAMPLE = f"current_message string, conversation_history {HISTORY}"


def traces(spark: SparkSession, path: str, tag: str | None = None, streaming: bool = False) -> DataFrame:
    """(session, at, question, output, conversation_history); broken lines are left out, a history is JSON inside JSON."""
    reader = (spark.readStream if streaming else spark.read).schema(f"{TRACE}, _corrupt string")
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null")
    rows = rows.where(F.array_contains("tags", tag)) if tag else rows
    history = F.from_json("metadata.history", HISTORY)
    return rows.select(F.col("sessionId").alias("session"), F.try_to_timestamp("timestamp").alias("at"), F.col("input").alias("question"), "output", F.coalesce(history, F.array().cast(HISTORY)).alias("conversation_history"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Test samples as the replay takes them."""
    return spark.read.schema(SAMPLE).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Each file one JSON array of objects, as ``read_json`` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = [f"{lead if i == 0 else ','}{x}" for i, x in enumerate(batch.column(0).to_pylist())]
            lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"], pa.string())], ["value"])

    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def export(rows: DataFrame, path: str, file_format: str = "csv", header: bool = True, footer: list[list] | None = None) -> None:
    """A table as csv, json or parquet, or as one xlsx file, which alone takes footer rows; tasks write its rows, in the order of the table."""
    if file_format == "xlsx":
        rows.sparkSession.dataSource.register(xlsx.XlsxSource)
        return rows.write.format("xlsx").mode("overwrite").option("header", header).option("footer", json.dumps(footer or [], default=str)).save(path)
    if file_format not in ("csv", "json", "parquet") or footer:
        raise ValueError(f"cannot export as {file_format}" + " with a footer" * bool(footer))
    writer = rows.write.mode("overwrite").format(file_format)
    (writer.option("header", header) if file_format == "csv" else writer).save(path)


def replay_samples(spark: SparkSession, path: str, tag: str | None = None, n: int = 200, seed: int = 42) -> DataFrame:
    """(current_message, conversation_history): test samples from trace logs, by session and time, ``n`` of them in hash order."""
    said = traces(spark, path, tag).where("question is not null")
    samples = said.select("session", "at", F.col("question").alias("current_message"), "conversation_history")
    return sampled(samples, n, "session", "at", seed=seed).select("current_message", "conversation_history")
