"""Intermediate tables of the operators, and bounds of what goes to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askgrid.sources.staging import bucketed, delete, forget, new_path, own_dir, shared_dir, sweep, written

__all__ = ["bucketed", "delete", "forget", "free_name", "lean_batches", "new_path", "own_dir", "shared_dir", "sweep", "table", "written"]

_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at once by bytes, so batches of very long texts fit; a lower bound of the session stays."""
    set_to = spark._jsparkSession.sessionState().conf().getConfString(_BATCH, "67108864b")
    size = int("".join(c for c in set_to if c.isdigit())) << {"k": 10, "m": 20, "g": 30}.get(set_to.strip("b")[-1:].lower(), 0)
    if size > _BATCH_BYTES or size <= 0:
        spark.conf.set(_BATCH, f"{_BATCH_BYTES}b")


def free_name(columns: list[str], name: str) -> str:
    """What an added column is called: its name, or with ``ag_`` in front where the input has a column of that name, which stays as it is."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"ag_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
