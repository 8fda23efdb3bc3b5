"""Reading tables, and the engagement model of this library over an order-and-item schema.

users are customers, items are parts; a customer's lines of a part are what the
user did with the item: quantity is playing time (returned lines count as none),
lines with flag A are unlocked achievements (their line number names them),
tax is unlocking progress.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from affinix.functions.windows import spread


#: Lines of a task in which many lines meet their orders; up to so many tasks, the join is left to Spark.
JOINED, FEW_TASKS = 1_200_000, 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line: user_id, item_id, ach_id, playtime, flag, progress, unlock_time, price.

    Many lines (counted from the files' footers) meet orders in tasks of bounded size; fewer are left to Spark, which may broadcast orders.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    items = table(spark, folder, "lineitem")
    rows = items.count()
    if rows > FEW_TASKS * JOINED:
        items, orders = spread(items, "l_orderkey", rows, JOINED), spread(orders, "o_orderkey", rows, JOINED)
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        "user_id",
        F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").cast("int").alias("ach_id"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("playtime"),
        F.col("l_returnflag").alias("flag"),
        F.round(F.col("l_tax") * 100).cast("int").alias("progress"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))").alias("unlock_time"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, name, type, price, ach_total."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), ((F.col("p_size") % 4) * 5).cast("long").alias("ach_total"))


def csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A CSV file with a header, in the schema's order of columns; rows with a value that doesn't fit its type are skipped, empty ones are null."""
    types = StructType.fromDDL(schema)
    raw = spark.read.options(header="true", encoding="UTF-8", **options).schema(StructType([StructField(f.name, StringType()) for f in types])).csv(path)
    fits = [F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull() for f in types]
    return raw.where(reduce(lambda x, y: x & y, fits)).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in types])


def json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object of numbers as rows (key string, value long)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias(key, value))


def json_list(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """A JSON array of strings as rows (position, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", value))


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV parts with a header, beside each other in a new folder."""
    df.write.mode("error").option("header", True).csv(path)


def write_stats(df: DataFrame, path: str) -> None:
    """A table of statistics as JSON lines in a new folder."""
    df.write.mode("error").json(path)


def write_scores(df: DataFrame, path: str) -> None:
    """A table of scores as Parquet parts in a new folder."""
    df.write.mode("error").parquet(path)


def read_scores(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a folder of Parquet parts, or of CSV parts with a header (numbers and texts by what all rows allow); a column that it lacks is refused."""
    reader = spark.read
    df = reader.option("header", True).option("inferSchema", True).csv(path) if path.rstrip("/").endswith(".csv") else reader.parquet(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)
