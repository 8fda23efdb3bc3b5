"""The item catalogue: tags, quality, popularity and constraint metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinix.functions import text
from affinix.functions.text import apply_alias, json_weights, normalize_tag, price_of, split_list
from affinix.functions.windows import ordinal_percent, top_k
from affinix.operators.content import without_self
from affinix.operators.products import best_products


def tag_format(df: DataFrame) -> str:
    """'weights' for a tags_json column, 'list' for a tags column."""
    if "tags_json" in df.columns:
        return "weights"
    if "tags" in df.columns:
        return "list"
    raise ValueError(f"neither tags_json nor tags among {df.columns}")


def required(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean_tag(tag: Column, ascii_only: bool = False) -> Column:
    return apply_alias(normalize_tag(tag, ascii_only))


def tag_rows(df: DataFrame, key: str = "item_id", least: float = 5, ascii_only: bool = False) -> DataFrame:
    """(item_id, tag, weight): normalised tags of either format, the highest weight where two become one."""
    if tag_format(df) == "weights":
        rows = json_weights(df, "tags_json", [key], least)
    else:
        rows = df.select(key, F.explode(split_list(F.col("tags"))).alias("tag"), F.lit(1.0).alias("weight"))
    return rows.withColumn("tag", clean_tag(F.col("tag"), ascii_only)).where("tag <> ''").groupBy(key, "tag").agg(F.max("weight").alias("weight"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(tag, n): every tag and how many items carry it."""
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(rows: DataFrame, n: int = 10) -> DataFrame:
    return vocabulary(rows).orderBy(F.desc("n"), "tag").limit(n)


def tag_bags(rows: DataFrame, pool: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(item_id, tags): sorted distinct tags of pool items, of those allowed."""
    kept = rows.join(pool.select("item_id"), "item_id", "left_semi")
    if allowed is not None:
        kept = kept.join(allowed.select("tag"), "tag", "left_semi")
    return kept.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def dropped_tags(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row: how many tag rows the vocabulary doesn't know."""
    return rows.join(allowed.select("tag"), "tag", "left_anti").agg(F.count("*").alias("n_dropped"))


def tag_matrix(bags: DataFrame) -> DataFrame:
    """(item_id, tag, value) of the binary matrix, by its cells that aren't 0."""
    return bags.select("item_id", F.explode("tags").alias("tag")).withColumn("value", F.lit(1))


def shrunk_quality(votes: DataFrame, prior: float = 200.0, cap: float = 1000.0) -> DataFrame:
    """votes(item_id, raw, n) with the global mean (weights up to cap) and q = (n raw + prior mean) / (n + prior)."""
    w = F.least(F.col("n").cast("double"), F.lit(cap))
    mean = votes.agg((F.sum(F.col("raw") * w) / F.sum(w)).alias("global_mean"))
    return votes.crossJoin(F.broadcast(mean)).withColumn("q", (F.col("n") * F.col("raw") + prior * F.col("global_mean")) / (F.col("n") + prior))


def vote_quality(votes: DataFrame, prior: float = 200.0) -> DataFrame:
    """votes(item_id, positive, negative): raw is ten times the positive share; items without votes are left out."""
    n = F.coalesce("positive", F.lit(0)) + F.coalesce("negative", F.lit(0))
    return shrunk_quality(votes.withColumn("n", n).where("n > 0").select("item_id", (10.0 * F.coalesce("positive", F.lit(0)) / F.col("n")).alias("raw"), "n"), prior)


def score_quality(reviews: DataFrame, prior: float = 20.0) -> DataFrame:
    """reviews(item_id, s): raw is the mean of an item's scores; values that aren't finite are left out."""
    finite = reviews.where("s is not null and not isnan(s) and abs(s) < double('infinity')")
    per_item = finite.groupBy("item_id").agg(F.avg("s").alias("raw"), F.count("*").alias("n"))
    mean = finite.agg(F.avg("s").alias("global_mean"))
    return per_item.crossJoin(F.broadcast(mean)).withColumn("q", (F.col("n") * F.col("raw") + prior * F.col("global_mean")) / (F.col("n") + prior))


def quality_percentile(quality: DataFrame, least_reviews: int = 5) -> DataFrame:
    """(item_id, pct): place by q among items with enough reviews."""
    return ordinal_percent(quality.where(F.col("n") >= least_reviews).select("item_id", "q"), "q", "item_id").select("item_id", "pct")


def popularity_floor(pool: DataFrame, rates: DataFrame) -> DataFrame:
    """(item_id, popularity) of every pool item; unknown or not positive ones get the lowest positive rate (1e-6 if none)."""
    low = rates.join(pool.select("item_id"), "item_id", "left_semi").where("rate > 0").agg(F.coalesce(F.min("rate"), F.lit(1e-6)).alias("low"))
    positive = rates.where("rate > 0").select("item_id", "rate")
    return pool.select("item_id").join(positive, "item_id", "left").crossJoin(F.broadcast(low)).select("item_id", F.coalesce("rate", "low").alias("popularity"))


def popularity_chain(pool: DataFrame, owners: DataFrame | None, reviews: DataFrame) -> DataFrame:
    """(item_id, popularity, source): the owners' midpoint if not 0, else the number of reviews, else 1."""
    counts = reviews.groupBy("item_id").agg(F.count("*").cast("double").alias("n_reviews"))
    base = pool.select("item_id").join(counts, "item_id", "left")
    base = base.join(owners.select("item_id", "midpoint"), "item_id", "left") if owners is not None else base.withColumn("midpoint", F.lit(None).cast("double"))
    mid = F.nullif(F.col("midpoint"), F.lit(0.0))
    return base.select("item_id", F.coalesce(mid, "n_reviews", F.lit(1.0)).alias("popularity"), F.when(mid.isNotNull(), "owners").when(F.col("n_reviews").isNotNull(), "reviews").otherwise("imputed").alias("source"))


def popularity_summary(popularity: DataFrame) -> DataFrame:
    return popularity.agg(F.count("*").alias("n"), F.min("popularity").alias("min"), F.max("popularity").alias("max"), F.median("popularity").alias("median"), F.avg("popularity").alias("mean"), *[F.count(F.when(F.col("source") == s, 1)).alias(f"n_{s}") for s in ("owners", "reviews", "imputed")])


def constraint_row(df: DataFrame) -> DataFrame:
    """Constraint metadata from categories_json, languages, price_final, price_currency, is_free, release_date and metacritic."""
    described = F.array_join(F.transform(F.from_json("categories_json", "array<struct<description:string>>"), lambda c: c["description"]), " ")
    categories = F.coalesce(described, F.lit(""))
    free = F.coalesce(F.col("is_free"), F.lit(False))
    return df.select(
        "item_id",
        F.contains(categories, F.lit("Co-op")).alias("coop"),
        F.contains(categories, F.lit("Multi-player")).alias("multiplayer"),
        F.contains(categories, F.lit("Single-player")).alias("single_player"),
        F.contains(F.coalesce("languages", F.lit("")), F.lit("Korean")).alias("korean"),
        price_of(free, F.col("price_final")).alias("price"),
        F.when(free, F.lit("KRW")).otherwise(F.col("price_currency")).alias("currency"),
        free.alias("is_free"),
        F.nullif(F.col("release_date"), F.lit("")).alias("release"),
        F.when(F.col("metacritic") > 0, F.col("metacritic").cast("double")).alias("metacritic"),
    )


def neighbours_by_tags(rows: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, item_id, sim, rank): the k items with the highest Jaccard of tag sets; items without a common tag have 0 and are left out.

    Repeated tags of an item count once.
    """
    sets = rows.select("item_id", "tag").distinct().select(F.col("item_id").alias("key"), F.col("tag").alias("dim"), F.lit(1.0).alias("w"))
    left = sets.join(seeds.select(F.col("item_id").alias("key")), "key", "left_semi").select(F.col("key").alias("seed"), "dim", "w")
    return without_self(best_products(left, sets, k + 1, value=lambda c, a, b: c / (a[:, None] + b - c)), k)


#: Characters of the pieces by which titles are looked up.
GRAM = 4


def _grams(x: Column, n: int | Column) -> Column:
    """The distinct pieces of n characters; none of a shorter text."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substr(x, i, F.lit(n) if isinstance(n, int) else n)))).otherwise(F.array().cast("array<string>"))


def _parts_of(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """(part, whole) of texts that hold another of GRAM characters or more, found by that one's rarest piece."""
    pieces = wholes.select(whole, F.explode(_grams(F.col(whole), GRAM)).alias("_g"))
    counts = pieces.groupBy("_g").agg(F.count("*").alias("_c"))
    own = parts.where(F.length(part) >= GRAM).select(part, F.explode(_grams(F.col(part), GRAM)).alias("_g")).join(counts, "_g", "left")
    # A piece that no text holds rules its title out: it is the rarest of all.
    rarest = own.groupBy(part).agg(F.min_by("_g", F.struct(F.coalesce("_c", F.lit(0)), "_g")).alias("_g"))
    return rarest.join(pieces, "_g").where(F.contains(whole, part)).select(part, whole)


def title_matches(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """(wanted, title): which of titles(title) each of wanted(wanted) means, as text.titles_match says, without comparing all with all.

    Titles within each other are found by pieces of GRAM characters and then compared (wanted ones of two or
    three characters by pieces of their length); series by the beginnings of a title that end with a word.  Null and repeated ones are passed over.
    """
    w = wanted.where("wanted is not null").select("wanted", F.lower(F.trim("wanted")).alias("_w")).distinct().where(F.length("_w") >= 2)
    t = titles.where("title is not null").select("title", F.lower(F.trim("title")).alias("_t")).distinct()
    ws, ts = w.select("_w").distinct(), t.select("_t").distinct()
    within = _parts_of(ts, "_t", ws, "_w").select("_w", "_t").union(_parts_of(ws, "_w", ts, "_t").select("_w", "_t"))
    short = ws.where(F.length("_w") < GRAM)
    pieces = ts.select("_t", F.explode(F.concat(*[_grams(F.col("_t"), n) for n in range(2, GRAM)])).alias("_w"))
    begun = F.transform(F.filter(F.sequence(F.lit(1), F.length("_t")), lambda i: F.substr(F.col("_t"), i + 1, F.lit(1)).isin(" ", ":", "")), lambda i: F.substr(F.col("_t"), F.lit(1), i))
    starts = ts.where(F.length("_t") > 0).select("_t", F.explode(F.array_distinct(begun)).alias("_p"))
    series = ws.withColumn("_p", text.series_prefix(F.col("_w"))).where(F.length("_p") >= 4).join(starts, "_p").select("_w", "_t")
    pairs = within.union(short.join(pieces, "_w").select("_w", "_t")).union(series).distinct()
    return pairs.join(w, "_w").join(t, "_t").select("wanted", "title")
