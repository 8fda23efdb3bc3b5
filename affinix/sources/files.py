"""Files as rows: fingerprints, summaries, scans, and run folders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What some texts begin with.
BOM = b"\xef\xbb\xbf"


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


#: Files of so many bytes are hashed as a stream of lines; smaller ones are held whole.  A binaryFile can't be 2 GiB.
WHOLE = 2**28


def fingerprints(spark: SparkSession, path: str, pattern: str | None = None, whole: int = WHOLE) -> DataFrame:
    """(name, sha256 of 16 digits, size) of every file but empty ones, which Spark's readers skip.

    A digest is sequential, so one task hashes a file; of one of whole bytes or more it holds a batch of lines at a time, which are
    shuffled to it and sorted by their place.  A line, up to the byte 10, must be shorter than 2 GiB.
    """
    files = contents(spark, path, pattern)
    least = max(1, whole)
    out = files.where(F.col("length") < least).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    for r in files.where(F.col("length") >= least).select("path", "length").collect():
        out = out.union(_streamed(spark, r.path, r.length))
    return out.withColumn("sha256", F.substring("sha256", 1, 16))


def _streamed(spark: SparkSession, path: str, size: int) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    name = path.rsplit("/", 1)[-1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The reader drops a byte order mark, which only the length betrays at the end.
        digests, done = (hashlib.sha256(), hashlib.sha256(BOM)), 0
        for batch in batches:
            for line in batch.column(0):
                part = line.as_py()
                done += len(part) + 1
                for h, short in zip(digests, (0, len(BOM)), strict=True):
                    h.update(part + b"\n" if done + short <= size else part)
        if done:
            left = size - done
            if left not in (-1, 0, len(BOM) - 1, len(BOM)):
                raise ValueError(f"{name}: {done} bytes of lines, {size} of the file")
            yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [digests[left > 0].hexdigest()], "size": [size]})

    return lines.repartition(1).sortWithinPartitions("at", "n").select("line").mapInArrow(hashed, "name string, sha256 string, size long")


def expected(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, there, sha256 of 16 digits, size) of the files that a folder should hold; those that it lacks have neither digest nor size."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    found = fingerprints(spark, path).join(F.broadcast(wanted), "name", "left_semi")
    return wanted.join(found, "name", "left").select("name", F.col("size").isNotNull().alias("there"), "sha256", "size")


def file_info(spark: SparkSession, path: str) -> DataFrame:
    return contents(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


def summary(info: DataFrame) -> DataFrame:
    """(extension, n, size)."""
    return info.groupBy(F.lower(F.regexp_extract("name", r"(\.[^.]*)?$", 1)).alias("extension")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


#: Fixed value: how an account number looks.
ACCOUNT = r"7656119\d{10}"


def account_numbers(texts: DataFrame, text: str, benign: list[str], pattern: str = ACCOUNT) -> DataFrame:
    """Rows whose text holds account numbers that aren't known to be harmless, with those numbers."""
    found = F.array_distinct(F.array_except(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(*[F.lit(b) for b in benign]).cast("array<string>")))
    return texts.withColumn("numbers", found).where("size(numbers) > 0")


def append_log(entry: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines run log."""
    entry.write.mode("append").json(path)


def new_run(df: DataFrame, path: str) -> None:
    """Writes a run's folder; refuses one that exists."""
    df.write.mode("error").parquet(path)


def versioned(df: DataFrame, path: str, version: str) -> str:
    out = f"{path}/version={version}"
    df.write.mode("error").parquet(out)
    return out
