"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that have none set, by application.
_OWN: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, of the context or the session; on one machine that has none set, a temporary
    one.  On a cluster without it this is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="facetry-")
    return _OWN[context.applicationId]


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder."""
    path = f"{shared(df.sparkSession)}/store/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
