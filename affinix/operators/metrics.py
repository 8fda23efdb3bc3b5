"""Ranking metrics over (user_id, item_id, rank from 1) lists, for many users in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinix.functions.maths import cosine
from affinix.functions.windows import ordinal_percent, scanned


def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per user of truth(user_id, item_id): n_true, hits, recall, precision (over k), and ndcg with binary gain.

    The ideal gain is that of min(n_true, k) hits in front.
    """
    hit = recs.where(F.col("rank") <= k).join(truth.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_true", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    n = truth.groupBy("user_id").agg(F.count("*").alias("n_true"))
    return n.join(hit, "user_id", "left").select("user_id", "n_true", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("n_true")).alias("recall"), (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def graded_ndcg(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user_id, ndcg) with truth(user_id, item_id, gain) of any gain."""
    got = recs.where(F.col("rank") <= k).join(truth, ["user_id", "item_id"]).groupBy("user_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = truth.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("gain"), "item_id"))).where(F.col("_r") <= k).groupBy("user_id").agg(F.sum(F.col("gain") / F.log2(F.col("_r") + 1)).alias("ideal"))
    return best.join(got, "user_id", "left").select("user_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def intra_list_diversity(recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, ild): mean of 1 - cosine over pairs of a list; a zero vector is at distance 1, a list of one has 0.  Lists are short: k items."""
    v = recs.join(vectors, "item_id").select("user_id", "rank", "v")
    a, b = v.select("user_id", F.col("rank").alias("r1"), F.col("v").alias("v1")), v.select("user_id", F.col("rank").alias("r2"), F.col("v").alias("v2"))
    pairs = a.join(b, "user_id").where("r1 < r2").groupBy("user_id").agg(F.avg(1 - cosine(F.col("v1"), F.col("v2"))).alias("ild"))
    return recs.select("user_id").distinct().join(pairs, "user_id", "left").select("user_id", F.coalesce("ild", F.lit(0.0)).alias("ild"))


def novelty(recs: DataFrame, popularity: DataFrame) -> DataFrame:
    """(user_id, novelty): mean of -log2 of an item's share of all popularity, held above 1e-12."""
    total = popularity.agg(F.sum("popularity").alias("total"))
    p = popularity.crossJoin(F.broadcast(total)).select("item_id", (-F.log2(F.greatest(F.col("popularity") / F.col("total"), F.lit(1e-12)))).alias("info"))
    return recs.join(p, "item_id").groupBy("user_id").agg(F.avg("info").alias("novelty"))


def serendipity(recs: DataFrame, truth: DataFrame, popular: DataFrame) -> DataFrame:
    """(user_id, serendipity): share of a list that is relevant and not among the popular(item_id)."""
    rel = truth.select("user_id", "item_id").withColumn("_rel", F.lit(1))
    pop = popular.select("item_id").withColumn("_pop", F.lit(1))
    return recs.join(rel, ["user_id", "item_id"], "left").join(pop, "item_id", "left").groupBy("user_id").agg(F.avg((F.col("_rel").isNotNull() & F.col("_pop").isNull()).cast("double")).alias("serendipity"))


def evaluate(recs: DataFrame, truth: DataFrame, vectors: DataFrame, popularity: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """All six metrics per user that has a list and truth."""
    top = recs.where(F.col("rank") <= k)
    return ranking_metrics(top, truth, k).select("user_id", "recall", "precision", "ndcg").join(intra_list_diversity(top, vectors), "user_id").join(novelty(top, popularity), "user_id").join(serendipity(top, truth, popular), "user_id")


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(user_id, overlap): shared items of two top-k lists over k."""
    both = a.where(F.col("rank") <= k).join(b.where(F.col("rank") <= k).select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("c"))
    return a.select("user_id").distinct().join(both, "user_id", "left").select("user_id", (F.coalesce("c", F.lit(0)) / F.lit(float(k))).alias("overlap"))


def catalog_coverage(recs: DataFrame, n_items: DataFrame) -> DataFrame:
    """One row: distinct recommended items, and their share of all."""
    return recs.agg(F.countDistinct("item_id").alias("n_distinct")).crossJoin(n_items.agg(F.count("*").alias("n_items"))).select("n_distinct", "n_items", (F.col("n_distinct") / F.col("n_items")).alias("coverage"))


def gini(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: the Gini coefficient; 0 if there is nothing or it sums to 0.

    Equal values are counted first; running counts are made in ranges of the distinct values.
    """
    counts = values.groupBy(value).agg(F.count("*").alias("c"))
    placed = scanned(counts, value, value, {"_upto": "c"}).withColumn("_before", F.col("_upto") - F.col("c"))
    weighted = F.sum(F.col(value) * (F.col("c") * F.col("_before") + F.col("c") * (F.col("c") + 1) / 2))
    return placed.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), weighted.alias("ranked"), F.sum(F.col(value) * F.col("c")).alias("total")).select(F.when((F.col("n") > 0) & (F.coalesce("total", F.lit(0.0)) != 0), 2 * F.col("ranked") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def popularity_percentile(popularity: DataFrame) -> DataFrame:
    return ordinal_percent(popularity.select("item_id", "popularity"), "popularity", "item_id").select("item_id", "pct")


def novelty_calibration(recs: DataFrame, percentiles: DataFrame) -> DataFrame:
    """(user_id, mean_pct): mean popularity percentile of a list."""
    return recs.join(percentiles, "item_id").groupBy("user_id").agg(F.avg("pct").alias("mean_pct"))
