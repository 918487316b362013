"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor costs a
re-run of its tasks, never a re-run of the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
#: Catalog tables that stand for folders, by application and path.
_named: dict[str, dict[str, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, a temporary one if driver and tasks are one machine (tests), else an error."""
    found = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_KEY} must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="askgrid-")
    return _own[app]


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/askgrid-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has staged, once no result is read any more."""
    for name in _named.pop(spark.sparkContext.applicationId, {}).values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again under the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._askgrid_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table whose files are dealt by ``key``, so that joining or grouping by it moves nothing; each task writes its own rows, without a shuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "ag_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    _named.setdefault(spark.sparkContext.applicationId, {})[path] = table
    out = spark.table(table)
    out._askgrid_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` or ``bucketed`` that nothing lazy reads any more."""
    path = getattr(df, "_askgrid_path", None)
    if path:
        if name := _named.get(df.sparkSession.sparkContext.applicationId, {}).pop(path, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
