"""Structured Streaming over the incremental store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affinix.operators.store import latest

#: Buckets of a store's keys; fixed when a store is begun.
BUCKETS = 64


def upsert_stream(source: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges each micro-batch into a store below target and returns the running query.

    The store is dealt into buckets by a hash of the keys.  A batch reads and writes only the buckets that it touches, as
    data/batch=N/bucket=B, and then the list of them, as touched/batch=N; a bucket's newest
    batch is its state.  A batch that is run again reads what batches before it wrote and writes the same
    again, so a restart repeats nothing; what a batch wrote before it failed isn't
    listed and isn't read.  Progress is the checkpoint's, which takes the place of hand-kept cursors.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # buckets at most
        old = _state(spark, target, rows.schema, number, touched)
        latest(old, rows, [*keys, "bucket"], order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/batch={number}")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{target}/touched/batch={number}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, target: str, before: int | None) -> dict[int, int]:
    """Of each bucket the newest batch (below before) that touched it; one small row a bucket and batch."""
    try:
        rows = spark.read.schema("bucket int, batch int").parquet(f"{target}/touched")
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.max("batch").alias("n")).collect()}


def _state(spark: SparkSession, target: str, schema, before: int | None, wanted: list[int] | None = None) -> DataFrame:
    newest = {b: n for b, n in _newest(spark, target, before).items() if wanted is None or b in wanted}
    if not newest:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", f"{target}/data") if schema is None else spark.read.option("basePath", f"{target}/data").schema(schema)
    return reader.parquet(*[f"{target}/data/batch={n}/bucket={b}" for b, n in sorted(newest.items())]).drop("batch")


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The rows of a store as they are, or were before a batch."""
    first = _newest(spark, target, before)
    if not first:
        raise ValueError(f"nothing is stored below {target}")
    schema = spark.read.option("basePath", f"{target}/data").parquet(f"{target}/data/batch={max(first.values())}").drop("batch").schema
    return _state(spark, target, schema, before).drop("bucket")


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per user and window; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "user_id", "n", "value")
