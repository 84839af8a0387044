"""Cutting a plan at a stage boundary.

Iterative jobs must not let their lineage grow, and a lost executor must not
send them back to the start.  ``cut`` writes the frame once, as Parquet, into
the shared folder the cluster names in ``spark.checkpoint.dir`` and reads it
back: the copy outlives executors, and its file statistics give later joins a
true size to plan with.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
# Folders made for sessions without the setting (tests), by application id.
_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.

    One process (a ``local`` master) without the setting gets a temporary
    folder; executors of a cluster could not see such a folder, so there the
    setting is required.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {_SETTING} to a folder that all executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = tempfile.mkdtemp(prefix="replyforge-")
        folder = _made[app]
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
