"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its rows are fixed, and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where none is set, as on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and sc.master != "local" and not sc.master.startswith("local["):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="pathquill-shared-"))
    return sc.getCheckpointDir()
