"""Ranks and percentiles as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def average_rank(value: Column | str, by: list[Column | str]) -> Column:
    """Rank from 1 by ascending value; ties share the mean of their ranks."""
    keys = [col(b) for b in by]
    v = col(value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2


def hazen(value: Column | str, by: Column | str, rank_zero: bool = False) -> Column:
    """Mid-rank percentile (rank - 0.5) / n within by, of the values above 0 (of all non-null ones with rank_zero).

    Others get null; a value alone in its group gets 0.5.
    """
    v = col(value)
    counts = v.isNotNull() if rank_zero else F.coalesce(v > 0, F.lit(False))
    keys = [col(by), counts]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when(counts, (average_rank(v, keys) - 0.5) / n)


def average_percent_rank(value: Column | str, by: Column | str) -> Column:
    """(average rank - 1) / (n - 1); 1 in a group of one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(col(by)))
    return F.when(n > 1, (average_rank(value, [by]) - 1) / (n - 1)).otherwise(1.0)


def _in_ranges(df: DataFrame, value: str, tie: str, parts: int) -> DataFrame:
    """df with its range (_a, _b) in the order of value and tie, nulls first.

    Ranges lie between approximate quantiles.  A value that is a quantile itself has a range of its
    own, which is cut again by the ties' quantiles; so a common value is many ranges too.
    """
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, shares, 10_000))).alias("_vs"), F.percentile_approx(tie, shares, 10_000).alias("_ts"))
    below = lambda cut, x: F.size(F.filter(cut, lambda c: c < F.col(x)))
    own = F.array_contains("_vs", F.col(value))
    return df.join(F.broadcast(cuts)).withColumn("_a", F.when(F.col(value).isNull(), -1).otherwise(2 * below("_vs", value) + own.cast("int"))).withColumn("_b", F.when(own, below("_ts", tie)).otherwise(0)).drop("_vs", "_ts")


def placed(df: DataFrame, value: str, tie: str, name: str = "place", total: str = "n_rows", parts: int = 64) -> DataFrame:
    """df with each row's place from 0 by (value, tie), both numbers, nulls first, and the number of rows.

    Rows are numbered within ranges, and the sizes of the ranges before are added.
    """
    ranged = _in_ranges(df, value, tie, parts)
    sizes = ranged.groupBy("_a", "_b").agg(F.count("*").alias("_n"))  # parts * (parts + 1) rows at most
    order = Window.orderBy("_a", "_b")
    before = sizes.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).withColumn(total, F.sum("_n").over(Window.partitionBy(F.lit(0)))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(value, tie)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), ["_a", "_b"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_a", "_b", "_place", "_before")


def scanned(df: DataFrame, value: str, tie: str, sums: dict[str, str] | None = None, lows: dict[str, str] | None = None, parts: int = 64) -> DataFrame:
    """df with columns that run along the order of value and tie, both numbers, nulls first.

    sums: new column by column that is summed up to and with a row; lows: new column by column whose lowest
    value from a row on is taken.  Two passes: within ranges, and over one row a range, whose results are carried into the ranges behind (lows: before).
    """
    sums, lows = sums or {}, lows or {}
    ranged = _in_ranges(df, value, tie, parts)
    own = Window.partitionBy("_a", "_b").orderBy(value, tie)
    ahead, behind = Window.unboundedPreceding, Window.unboundedFollowing
    inner = {f"_s_{k}": F.sum(c).over(own.rowsBetween(ahead, 0)) for k, c in sums.items()} | {f"_l_{k}": F.min(c).over(own.rowsBetween(0, behind)) for k, c in lows.items()}
    over = Window.orderBy("_a", "_b")
    parts_of = ranged.groupBy("_a", "_b").agg(*[F.sum(c).alias(f"_cs_{k}") for k, c in sums.items()], *[F.min(c).alias(f"_cl_{k}") for k, c in lows.items()])
    carried = parts_of.select("_a", "_b", *[F.sum(f"_cs_{k}").over(over.rowsBetween(ahead, -1)).alias(f"_cs_{k}") for k in sums], *[F.min(f"_cl_{k}").over(over.rowsBetween(1, behind)).alias(f"_cl_{k}") for k in lows])
    joined = ranged.withColumns(inner).join(F.broadcast(carried), ["_a", "_b"])
    made = {k: F.col(f"_s_{k}") + F.coalesce(f"_cs_{k}", F.lit(0)) for k in sums} | {k: F.least(f"_l_{k}", f"_cl_{k}") for k in lows}
    return joined.withColumns(made).select(*df.columns, *sums, *lows)


def ordinal_percent(df: DataFrame, value: str, tie: str, name: str = "pct") -> DataFrame:
    """df with the place from 0 by (value, tie) over n - 1, 0 for a single row."""
    return placed(df, value, tie, "_at", "_total").withColumn(name, F.col("_at") / F.greatest(F.col("_total") - 1, F.lit(1))).drop("_at", "_total")


def top_k(df, k: int, by: list[str], order: list[Column], rank: str = "rank"):
    """The first k rows of each group, with their rank from 1; map sides keep k rows of each group at most."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(rank, F.row_number().over(w.orderBy(*order))).where(F.col(rank) <= k)


def numbered(ids: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): distinct ids numbered from 0 in order, by ranges whose sizes are added up."""
    parts = 64
    cuts = ids.select(key).distinct().withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    sizes = cuts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return cuts.withColumn("_place", place).join(F.broadcast(sizes), "_part").select(key, (F.col("_before") + F.col("_place")).cast("int").alias(name))


#: Rows of a task of a spread frame.
SPREAD = 150_000


def spread(df: DataFrame, key: str, rows: int, each: int | None = None) -> DataFrame:
    """df dealt by key into tasks of some SPREAD (or each) rows each, of rows in all: windows and groups by key, and more, sort no more at a time whatever the size of df."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // (each or SPREAD))), key)
