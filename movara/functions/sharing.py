"""Keeping a frame that several branches of one plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of its own that driver and executors share.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, in the warehouse,
    which every Spark session has and shares. Never in a machine-local temporary folder.
    """
    root = checkpoint_dir(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/movara-scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4()}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder, so that later steps read it there and know its size."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared(df: DataFrame) -> DataFrame:
    """The frame computed once for all branches that read it.

    A reliable checkpoint in the cluster's shared folder; without such a folder the frame is persisted on the
    executors, which compute lost parts again. No machine-local folder is ever chosen here.
    """
    folder = checkpoint_dir(df.sparkSession)
    if not folder:
        return df.persist()
    df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
