"""Cutting off lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """`frame` from checkpoint files under ``spark.checkpoint.dir``, so that lost executors cost no more than reading them.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="rowguard-"))
    return frame.checkpoint(eager=True)
