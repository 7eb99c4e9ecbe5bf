"""Tables written to the cluster's shared folder, to cut lineage between rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir; in one of our own where that is unset and there is no cluster."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"{tempfile.gettempdir()}/gridloom-checkpoint"
    path = f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
