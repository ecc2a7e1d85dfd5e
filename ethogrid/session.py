"""A session with the settings that the operators expect, and tables kept in the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "ethogrid", **conf: str) -> SparkSession:
    """UTC, AQE with skew handling on, ANSI as it is; conf overrides, with dots written as __."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is named and driver and
    executors are one local process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_ethogrid_shared", None) or tempfile.mkdtemp(prefix="spark-")
        spark._ethogrid_shared = path
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for what several passes use."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for work that costs far more than its rows weigh, so that they are not put together by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def unbroadcast(df: DataFrame) -> DataFrame:
    """df, whose join is a merge of sorted shuffles whatever its size is taken for. For what is far larger than Spark thinks:
    explosions count as small as what is exploded, and stored tables of few values as small as their files."""
    return df.hint("merge")


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A stored (or short) df with the hint of a broadcast if it has at most max_rows rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
