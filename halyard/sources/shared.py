"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the folder of spark.checkpoint.dir and read again: computed once, its lineage cut.

    Only where the setting is missing and Spark runs in this process, as in tests, a folder of this machine serves.
    """
    conf = df.sparkSession.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
