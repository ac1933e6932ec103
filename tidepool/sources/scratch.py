"""Results that are used several times, cut from their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if Spark runs on this machine alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """`df`, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
