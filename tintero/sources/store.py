"""Where intermediate results go: the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where driver and executors are one process may it be unset; then a temporary folder serves.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tintero-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through files in the shared folder; a lost executor's work is read again from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
