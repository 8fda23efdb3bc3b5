"""Bootstrap intervals, paired comparison, signed ranks and false discovery rates."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinix.functions.maths import normal_cdf
from affinix.functions.windows import placed, scanned


def finite(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    return df


#: Fixed value: a prime below 2^31, so that products of two residues fit 63 bits.
PRIME = 2_147_483_647


def drawn(key: Column, resample: Column, seed: int) -> Column:
    """A pseudo-random residue of PRIME for a whole-number key and a resample, by integer arithmetic that every engine shares."""
    x = (F.pmod(key.cast("long"), F.lit(PRIME)) * 48_271 + resample * 69_621 + seed) % PRIME
    for add in (40_692, 16_807, 950_706):  # squares part what lines leave together
        x = (x * x + x * add + add) % PRIME
    return x


#: The distribution function of a Poisson variable of mean 1, below which its values 0, 1, ... lie.
POISSON = tuple(sum(exp(-1) / factorial(j) for j in range(i + 1)) for i in range(12))


def bootstrap_means(values: DataFrame, value: str, key: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(b, mean): means of resamples, each value weighted by a Poisson(1) count drawn from its key, a whole number, the resample and the seed.

    The Poisson form of the bootstrap needs no row numbers, and only sums are shuffled.
    """
    u = drawn(F.col(key), F.col("b"), seed).alias("u")
    count = sum((F.when(F.col("u") >= int(s * PRIME), 1).otherwise(0) for s in POISSON), F.lit(0))
    many = finite(values, value).select(key, F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).select("b", "v", u).withColumn("n", count)
    return many.groupBy("b").agg((F.sum(F.col("v") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean")).where("mean is not null")


def bootstrap_ci(values: DataFrame, value: str, key: str, resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row: n, mean, low, high."""
    interval = bootstrap_means(values, value, key, resamples, seed).agg(F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return finite(values, value).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).crossJoin(interval).select("n", "mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row: the mean of b - a over keys with finite values in both, its interval, and whether that leaves 0 out."""
    d = finite(a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key), "x", "y").select(key, (F.col("y") - F.col("x")).alias("d"))
    return bootstrap_ci(d, "d", key, resamples, seed, alpha).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def wilcoxon(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n (without zero differences), w (the smaller rank sum) and p, two-sided by the normal approximation with ties; null p if all are equal.

    Equal absolute differences are counted first; running counts are made in ranges of them.
    """
    d = finite(a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key), "x", "y").select(F.round(F.col("y") - F.col("x"), 12).alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    placed = scanned(sizes, "size", "size", {"_upto": "c"}).withColumn("r", F.col("_upto") - (F.col("c") - 1) / 2)
    s = placed.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("up") * F.col("r")).alias("plus"), F.sum(F.col("r") * F.col("c")).alias("all"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    w = F.least("plus", F.col("all") - F.col("plus"))
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", w.alias("w"), F.when(F.col("n") > 0, F.least(2 * normal_cdf(z), F.lit(1.0))).alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """tests with q: the lowest p * m / rank over the ranks from its own on, 1 at most; ties of p go by a hash of the key.

    Ranks and the lowest values behind them are made in ranges of p.
    """
    ranked = placed(tests.withColumn("_tie", F.xxhash64(key)), p, "_tie", "_at", "_m")
    d = ranked.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_at") + 1))
    return scanned(d, p, "_tie", lows={"_low": "_raw"}).withColumn("q", F.least("_low", F.lit(1.0))).select(*tests.columns, "q")
