"""Seeded samples whose draws every engine and partitioning repeats.

A sample is the rows of lowest hashed priority, so samples of parts can be merged: the lowest of both are those of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinix.functions.maths import hashed_order
from affinix.functions.windows import top_k
from affinix.operators.statistics import drawn

#: A prime that spreads priorities; ties go by key.
MODULUS = 1_000_003


def bottom_k(rows: DataFrame, key: str, k: int, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """(by, key, priority, rank): of each group's distinct non-null whole-number keys the k of lowest hashed priority."""
    groups = by or []
    keys = rows.where(F.col(key).isNotNull()).select(*groups, key).distinct()
    return top_k(keys.withColumn("priority", hashed_order(F.col(key), seed, MODULUS)), k, groups, [F.asc("priority"), F.asc(key)])


def example_library(users: DataFrame, owned: DataFrame, pool: DataFrame, least: int = 8, tries: int = 200, seed: int = 0) -> DataFrame:
    """(user_id, item_id, playtime): the played items in the pool of the first user drawn that has at least so many.

    users(user_id, public, complete): those with both flags 1 are drawn, in a hashed order, tries of them at
    most.  No rows where none of these has enough.  Only the tried users' rows are counted.
    """
    drawn_users = bottom_k(users.where("public = 1 and complete = 1"), "user_id", tries, seed=seed).select("user_id", F.col("rank").alias("try"))
    libraries = owned.where("playtime > 0").join(drawn_users, "user_id").join(pool.select("item_id").distinct(), "item_id", "left_semi")
    first = libraries.groupBy("user_id", "try").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") >= least).orderBy("try").limit(1).select("user_id")
    return libraries.join(F.broadcast(first), "user_id").select("user_id", "item_id", "playtime")


def unscreened(spark: SparkSession, known: DataFrame, n: int, base: int, top: int, seed: int = 42, tries: int = 5) -> DataFrame:
    """(try, user_id): n ids drawn from base + 1 .. base + top that known(user_id) lacks, in the order of their draws; tries * n draws are made at most.

    An id may be drawn again, as by any draw with replacement.
    """
    draws = spark.range(1, tries * n + 1).select(F.col("id").alias("try"), (F.lit(base + 1) + drawn(F.col("id"), F.lit(0), seed) % top).alias("user_id"))
    return draws.join(known.select("user_id"), "user_id", "left_anti").orderBy("try").limit(n).select("try", "user_id")


def first_seen(rows: DataFrame, key: str, seq: str, limit: int, seed: int = 42) -> DataFrame:
    """(key, place from 1): the first limit distinct keys in the order of seq, put in a hashed order; null and repeated keys are passed over."""
    seen = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("_first")).orderBy("_first", key).limit(limit)
    return top_k(seen, limit, [], [F.asc(hashed_order(F.col(key), seed, MODULUS)), F.asc(key)], "place").select(key, "place")
