"""Where lineage is cut: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Make ``spark.checkpoint.dir`` the session's checkpoint folder.

    Where it is unset, a session of one machine gets a temporary folder; a cluster has none
    that all its machines see, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(path)


def checkpointed(df: DataFrame) -> DataFrame:
    ready(df.sparkSession)
    return df.checkpoint()
