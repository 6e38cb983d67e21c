"""Intermediate tables in the folder that every executor and the driver share.

Lineage is cut by writing Parquet, never by a local checkpoint: a lost executor then costs a re-read, not a failed job.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and the master is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="terrane-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return _OWN["root"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the scratch root and return it reread, with a fresh, short plan."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the path, for callers that :func:`drop` a table once the next one is written."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/terrane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API, so that any shared store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
