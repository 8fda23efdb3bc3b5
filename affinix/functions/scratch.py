"""Where steps of a plan are written to be read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str = "frames") -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, as in tests, below /tmp/checkpoints if executors run in the driver's process (masters local and
    local[...]); on a cluster they don't share it, so it is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage ends here, and lost executors take nothing with them."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
