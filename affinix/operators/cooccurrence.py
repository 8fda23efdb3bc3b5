"""Item-item co-occurrence: counts, cosines, containment and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinix.functions.scratch import new_folder, stored
from affinix.functions.windows import placed, top_k


def liked(scores: DataFrame, pool: DataFrame | None = None, threshold: float = 0.5, least: int = 2) -> DataFrame:
    """(user_id, item_id) with s >= threshold in the pool, of users with at least so many."""
    rows = scores.where(F.col("s") >= threshold).select("user_id", "item_id")
    if pool is not None:
        rows = rows.join(pool.select("item_id"), "item_id", "left_semi")
    # Dealt by user, so that scores are made once, and rows are shuffled once.
    rows = rows.repartition("user_id").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("user_id")))
    return rows.where(F.col("user_id").isNotNull() & (F.col("_n") >= least)).drop("_n")


#: Items of a block of a user's items; users with more are met block by block.
BLOCK = 256


def item_pairs(rows: DataFrame, columns: list[str], same: bool = False, block: int = BLOCK) -> DataFrame:
    """(user_id, i, j, a_<column>, b_<column> ...), i < j (same: i <= j): every pair of a user's items, once.

    A user of more than block items is cut into blocks of like size by a hash of the item,
    and each pair of blocks is a key of its own; so a heavy user is many tasks, and others are joined as they are.
    """
    sized = rows.select("user_id", "item_id", *columns).withColumn("_n", F.ceil(F.count("*").over(Window.partitionBy("user_id")) / block).cast("int"))
    meet = F.col("i") <= F.col("j") if same else F.col("i") < F.col("j")

    def side(d: DataFrame, item: str, mark: str, *more: str) -> DataFrame:
        return d.select("user_id", F.col("item_id").alias(item), *[F.col(c).alias(f"{mark}_{c}") for c in columns], *more)

    light = sized.where("_n = 1")
    few = side(light, "i", "a").join(side(light, "j", "b"), "user_id").where(meet)
    heavy = sized.where("_n > 1").withColumn("_own", F.pmod(F.xxhash64("item_id"), F.col("_n")).cast("int"))
    left = side(heavy.withColumn("_other", F.explode(F.sequence("_own", F.col("_n") - 1))), "i", "a", "_own", "_other")
    right = side(heavy.withColumn("_other", F.col("_own")).withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_own")))), "j", "b", "_own", "_other")
    many = left.join(right, ["user_id", "_own", "_other"]).where((F.col("_own") < F.col("_other")) | meet)
    # Items of different blocks meet in the order of their blocks.
    turn = F.col("i") > F.col("j")
    swapped = [F.when(turn, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")).alias(f"{x}_{c}") for c in columns for x, y in (("a", "b"), ("b", "a"))]
    many = many.select("user_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *swapped)
    return few.select(*many.columns).union(many)


def pair_counts(rows: DataFrame, value: str | None = None, same: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, c), i < j (same: i <= j): over users that have both, their number, or the sum of the product of their values.

    Sums are made in the tasks that make the pairs, before they are shuffled.
    """
    pairs = item_pairs(rows, [value] if value else [], same, block)
    c = F.sum(F.col(f"a_{value}") * F.col(f"b_{value}")) if value else F.count("*")
    return pairs.groupBy("i", "j").agg(c.alias("c"))


def degrees(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_id").agg(F.count("*").alias("deg"))


def conditional_cosine(rows: DataFrame, min_count: int = 3, min_degree: int = 1) -> DataFrame:
    """(i, j, c, sim), both ways round: c / sqrt(deg_i * deg_j) for pairs with enough users and partners with enough support."""
    half = pair_counts(rows).where(F.col("c") >= min_count)
    ways = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    both = half.select(F.inline(ways), "c")  # not a union, which would count all pairs twice
    d = degrees(rows)
    di, dj = d.select(F.col("item_id").alias("i"), F.col("deg").alias("di")), d.where(F.col("deg") >= min_degree).select(F.col("item_id").alias("j"), F.col("deg").alias("dj"))
    return both.join(di, "i").join(dj, "j").select("i", "j", "c", (F.col("c") / F.sqrt(F.col("di") * F.col("dj").cast("double"))).alias("sim"))


def neighbours(cosines: DataFrame, n: int) -> DataFrame:
    """The n most similar j of each i, with rank."""
    return top_k(cosines, n, ["i"], [F.desc("sim"), F.asc("j")])


#: Common owners within the prefix that make a pair a candidate, where so many are needed at all.
MET = 4


def containment_pairs(rows: DataFrame, threshold: float = 0.98, min_own: int = 3, block: int = BLOCK) -> DataFrame:
    """(i, j), both ways round: items of which nearly all owners of the rarer own the other too.

    Owners are put in an order, those with the fewest items first.  Of the d owners of the rarer item
    n = ceil(threshold * d) at least have the other, so t = min(n, MET) of its first d - n + t
    have it: only such pairs are candidates, and are counted whole.  Items owned equally often go by id.

    Items are numbered from the rarest on.  What is shuffled for a prefix's owner is a list of the commoner items, not
    a row for each; pairs are made and counted where all lists of an item are.
    """
    numbers = placed(degrees(rows.select("user_id", "item_id")).where(F.col("deg") >= min_own), "deg", "item_id", "_at", "_total").select("item_id", "deg", F.col("_at").cast("int").alias("_at"))
    folder = new_folder(rows.sparkSession, "containment")
    numbers = stored(numbers, f"{folder}/numbers")
    owned = rows.select("user_id", "item_id").join(numbers, "item_id")
    sized = rows.select("user_id", "item_id").withColumn("_size", F.count("*").over(Window.partitionBy("user_id"))).join(numbers, "item_id")
    # Counts and thresholds are compared as in c >= threshold * d; the margin keeps rounding from cutting a prefix short.
    need = F.greatest(F.ceil(threshold * F.col("deg") - 1e-9), F.lit(1))
    met = F.least(need, F.lit(MET)).cast("int")
    first = sized.withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy("_size", "user_id"))).where(F.col("_r") <= F.col("deg") - need + met)
    # A user's items are cut into blocks, each of which meets the prefixes that hold the user.
    blocks = F.ceil(F.col("_size") / block).cast("int")
    probes = first.select("user_id", F.col("_at").alias("i"), met.alias("_met"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"))
    theirs = sized.groupBy("user_id", F.pmod(F.xxhash64("item_id"), blocks).cast("int").alias("_b")).agg(F.collect_list("_at").alias("_items"))
    lists = probes.join(theirs, ["user_id", "_b"]).select("i", "_met", F.filter("_items", lambda x: x > F.col("i")).alias("_items")).where(F.size("_items") > 0)
    # So many tasks that each has few items, whatever the lists of all take.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, numbers.count() // 2000)
    counted = lists.repartition(tasks, "i").select("i", "_met", F.explode("_items").alias("j")).groupBy("i", "j").agg(F.count("*").alias("c"), F.max("_met").alias("_met"))
    candidates = stored(counted.where(F.col("c") >= F.col("_met")).select("i", "j"), f"{folder}/candidates")
    of = lambda name: owned.select("user_id", F.col("_at").alias(name))
    both = candidates.join(of("i"), "i").join(of("j"), ["user_id", "j"], "left_semi").groupBy("i", "j").agg(F.count("*").alias("c"))
    named = lambda name: numbers.select(F.col("_at").alias(name), F.col("item_id").alias(f"_{name}"), F.col("deg").alias(f"_d{name}"))
    half = both.join(named("i"), "i").join(named("j"), "j").where(F.col("c") >= threshold * F.col("_di")).select(F.col("_i").alias("i"), F.col("_j").alias("j"))
    return half.union(half.select("j", "i"))


def cf_scores(cosines: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, item_id, score): the weighted sum of the cosines of profiles(user_id, item_id, w)'s items."""
    return profiles.join(cosines, profiles["item_id"] == cosines["i"]).groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum(F.col("w") * F.col("sim")).alias("score"))
