"""SparkSession factory with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def settings(path: str) -> dict[str, str]:
    """NAME=value lines of a file; comments, blank lines and quotes around values are left out."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                out[name.strip().removeprefix("export ")] = value.strip().strip("'\"")
    return out


def get_spark(app: str = "askgrid", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own session.

    Shuffle partitions follow the cores here. At 100 TB they follow the bytes shuffled
    (about 128 MB each) and adaptive execution coalesces or splits them.
    """
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ASKGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
