"""Cutting lineage in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import QueryError


def folder(spark: SparkSession) -> str:
    """The checkpoint folder. Only where the session names none and runs on one machine, as in tests, one is set here."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise QueryError("execution", "a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
