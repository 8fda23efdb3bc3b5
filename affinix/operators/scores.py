"""Preference scores: functions of the interactions frame that give (user_id, item_id, s), s >= 0.

Each is one plan of columns and windows over the interactions; REGISTRY names
them, and new ones are added with @score.  Zero playing time scores 0 unless a
score says otherwise.  Null becomes 0 only at the end.  The names of scores and the defaults of their parameters are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinix.functions.maths import hashed_order, normal_cdf
from affinix.functions.scratch import new_folder, stored
from affinix.functions.windows import average_percent_rank, hazen, spread

Score = Callable[..., DataFrame]
REGISTRY: dict[str, Score] = {}
FAMILY: dict[str, str] = {}


def score(family: str) -> Callable[[Score], Score]:
    def register(f: Score) -> Score:
        REGISTRY[f.__name__], FAMILY[f.__name__] = f, family
        return f

    return register


def compute(name: str, inter: DataFrame, **params) -> DataFrame:
    """The named score of interactions; extra parameters go to it."""
    return REGISTRY[name](inter, **params)


def _out(df: DataFrame, s: Column) -> DataFrame:
    return df.select("user_id", "item_id", F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0)).cast("double").alias("s"))


def _played() -> Column:
    return F.col("playtime") > 0


def _has() -> Column:
    return F.coalesce("ach_total", F.lit(0)) > 0


def _completion() -> Column:
    """Completion of items with achievements (null unlocks are 0), else null."""
    return F.when(_has(), F.coalesce("completion", F.lit(0.0)))


def _pctl() -> Column:
    return hazen("playtime", "item_id")


def _blend(base: Column, other: Column, lam: float) -> Column:
    """lam * base + (1 - lam) * other where there is an other, else base."""
    return F.when(other.isNotNull(), lam * F.coalesce(base, F.lit(0.0)) + (1 - lam) * other).otherwise(base)


def _median() -> Column:
    """Median positive playing time of the item."""
    return F.median(F.when(_played(), F.col("playtime"))).over(Window.partitionBy("item_id"))


@score("anchor")
def anchor_binary(inter: DataFrame, floor_min: float = 60.0) -> DataFrame:
    """1 where playing time reaches the item's median and the floor."""
    threshold = F.greatest(F.coalesce(_median(), F.lit(floor_min)), F.lit(floor_min))
    return _out(inter, (F.col("playtime") >= threshold).cast("double"))


@score("rank")
def pctl_game(inter: DataFrame) -> DataFrame:
    """Mid-rank percentile of playing time within the item."""
    return _out(inter, _pctl())


@score("magnitude")
def logratio_median(inter: DataFrame, cap: float = 4.0) -> DataFrame:
    """Logarithm of 1 + playing time over the item's median, capped, scaled to 0..1."""
    ratio = F.log1p(F.col("playtime") / F.nullif(_median(), F.lit(0.0)))
    return _out(inter, F.when(_played(), F.least(ratio, F.lit(cap)) / cap))


def _pvalue(inter: DataFrame, k_shrink: float) -> DataFrame:
    """inter with pv: the place of log playing time in the item's lognormal, shrunk to the global one."""
    lg = F.when(_played(), F.ln("playtime"))
    w = Window.partitionBy("item_id")
    all_rows = inter.select(lg.alias("lg")).agg(F.avg("lg").alias("_mu0"), F.stddev_pop("lg").alias("_sd0"))
    n = F.count(lg).over(w)
    share = n / (n + F.lit(k_shrink))
    mu = share * F.avg(lg).over(w) + (1 - share) * F.col("_mu0")
    sd = F.greatest(share * F.coalesce(F.stddev_pop(lg).over(w), F.col("_sd0")) + (1 - share) * F.col("_sd0"), F.lit(0.25))
    with_fit = inter.crossJoin(F.broadcast(all_rows)).withColumn("_z", (lg - mu) / sd)
    return with_fit.withColumn("pv", F.when(_played(), normal_cdf(F.col("_z"))).otherwise(0.0)).drop("_mu0", "_sd0", "_z")


@score("parametric")
def pvalue_lognorm_eb(inter: DataFrame, k_shrink: float = 20.0) -> DataFrame:
    d = _pvalue(inter, k_shrink)
    return _out(d, F.col("pv"))


@score("rank-user")
def pctl_user(inter: DataFrame) -> DataFrame:
    """Mid-rank percentile of playing time within the user."""
    return _out(inter, hazen("playtime", "user_id"))


def _double(inter: DataFrame) -> DataFrame:
    return inter.withColumn("_r1", hazen("playtime", "user_id")).withColumn("_r2", hazen("_r1", "item_id", rank_zero=True))


@score("rank-double")
def double_quantile(inter: DataFrame) -> DataFrame:
    """Percentile within the user, then the percentile of that within the item."""
    return _out(_double(inter), F.col("_r2"))


@score("achievement")
def ach_completion_mult(inter: DataFrame, gamma: float = 0.4) -> DataFrame:
    """Percentile times gamma + (1 - gamma) * completion; items without achievements are neutral."""
    return _out(inter, _pctl() * F.when(_has(), gamma + (1 - gamma) * F.coalesce("completion", F.lit(0.0))).otherwise(1.0))


def _completion_blend(inter: DataFrame, lam: float) -> DataFrame:
    d = inter.withColumn("_c", _completion())
    return d.withColumn("_blend", _blend(_pctl(), hazen("_c", "item_id", rank_zero=True), lam))


@score("achievement")
def ach_completion_pctl_blend(inter: DataFrame, lam: float = 0.6) -> DataFrame:
    """Percentile blended with the percentile of completion within the item; completion 0 is ranked."""
    return _out(_completion_blend(inter, lam), F.col("_blend"))


def _gate(hi: float, floor: float) -> Column:
    """floor where much is played but nothing unlocked, else 1."""
    return F.when(_has() & (F.coalesce("ach_unlocked", F.lit(0)) == 0) & F.coalesce(_pctl() >= hi, F.lit(False)), floor).otherwise(1.0)


@score("achievement")
def afk_joint_gate(inter: DataFrame, hi_pctl: float = 0.8, floor: float = 0.25) -> DataFrame:
    return _out(inter, _pctl() * _gate(hi_pctl, floor))


@score("anchor")
def random_s(inter: DataFrame, seed: int = 42) -> DataFrame:
    """A seeded hash of user and item in [0, 1) on played rows."""
    return _out(inter, F.when(_played(), hashed_order(F.col("user_id") * 31 + F.col("item_id"), seed) / 10007.0))


@score("anchor")
def random_support(inter: DataFrame, seed: int = 42) -> DataFrame:
    """Items of played rows put in another order over all rows, with random s; one row for each user and item.

    Rows and items are numbered by two hashed orders.  Numbers are given within
    hash ranges, whose sizes are added up, so no task holds all rows.
    """
    played = inter.where(_played()).select("user_id", "item_id")

    def numbered(df: DataFrame, salt: int) -> DataFrame:
        h = df.withColumn("_h", hashed_order(F.col("user_id") * 31 + F.col("item_id"), seed + salt)).withColumn("_part", F.floor(F.col("_h") / 64))
        before = h.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return h.join(before, "_part").withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", "user_id", "item_id")))

    users, things = numbered(played, 0).select("_at", "user_id", "_h"), numbered(played, 1).select("_at", "item_id")
    return users.join(things, "_at").groupBy("user_id", "item_id").agg(F.min(F.col("_h") / 10007.0).alias("s"))


@score("achievement")
def comp_afk_combo(inter: DataFrame, lam: float = 0.6, hi_pctl: float = 0.8, floor: float = 0.25) -> DataFrame:
    d = _completion_blend(inter, lam)
    return _out(d, F.col("_blend") * _gate(hi_pctl, floor))


@score("achievement")
def resid2way_completion(inter: DataFrame, lam: float = 0.6, k_user: float = 5.0, rows: int | None = None) -> DataFrame:
    """Percentile blended with that of completion less the user's (shrunk) and the item's mean; rows, their number if it is known, bounds what a task sorts."""
    d = inter.withColumn("_c", _completion())
    d = d.crossJoin(F.broadcast(d.agg(F.avg("_c").alias("_grand"))))
    by_user, by_item = Window.partitionBy("user_id"), Window.partitionBy("item_id")
    user = (F.coalesce(F.sum("_c").over(by_user), F.lit(0.0)) + k_user * F.col("_grand")) / (F.count("_c").over(by_user) + k_user)
    d = d.withColumn("_user", user)
    if rows is not None:
        d = spread(d, "item_id", rows)
    d = d.withColumn("_resid", F.round(F.col("_c") - F.col("_user") - F.avg("_c").over(by_item) + F.col("_grand"), 10))
    return _out(d, _blend(_pctl(), hazen("_resid", "item_id", rank_zero=True), lam))


@score("magnitude")
def bm25_sat(inter: DataFrame, k: float = 1.0) -> DataFrame:
    """pt / (pt + k * median)."""
    ref = F.coalesce(F.nullif(_median(), F.lit(0.0)), F.lit(60.0))
    return _out(inter, F.when(_played(), F.col("playtime") / (F.col("playtime") + k * ref)))


def _base(inter: DataFrame, base: str, lam: float) -> DataFrame:
    """inter with _b, the score to cap."""
    made = {
        "pctl_game": lambda: inter.withColumn("_b", _pctl()),
        "blend": lambda: _completion_blend(inter, lam).withColumnRenamed("_blend", "_b"),
        "double_quantile": lambda: _double(inter).withColumnRenamed("_r2", "_b"),
        "logratio": lambda: inter.withColumn("_b", F.when(_played(), F.least(F.log1p(F.col("playtime") / F.nullif(_median(), F.lit(0.0))), F.lit(4.0)) / 4.0)),
        "pvalue": lambda: _pvalue(inter, 20.0).withColumnRenamed("pv", "_b"),
    }[base]()
    return made.withColumn("_b", F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(0.0)))


def _capped(d: DataFrame, alpha: float, rows: int | None = None) -> DataFrame:
    """d with _cap; rows, their number if it is known, bounds what a task sorts."""
    w = Window.partitionBy("user_id")
    if rows is not None:
        d = spread(d, "user_id", rows)
    return d.withColumn("_cap", F.coalesce(F.col("_b") / F.nullif(F.sum("_b").over(w), F.lit(0.0)) * F.pow(F.count("*").over(w), F.lit(alpha)), F.lit(0.0)))


@score("robustness")
def per_user_cap(inter: DataFrame, base: str = "pctl_game", alpha: float = 0.5, lam: float = 0.6, rows: int | None = None) -> DataFrame:
    """A base score as its share of the user's sum, times the size of the library to the power alpha; rows as in resid2way_completion."""
    return _out(_capped(_base(inter, base, lam).select("user_id", "item_id", "_b"), alpha, rows), F.col("_cap"))


@score("parametric-achievement")
def pvalue_comp_blend(inter: DataFrame, lam: float = 0.6) -> DataFrame:
    d = _pvalue(inter, 20.0).withColumn("_c", _completion())
    return _out(d, _blend(F.col("pv"), hazen("_c", "item_id", rank_zero=True), lam))


@score("temporal")
def cap_blend_recency(inter: DataFrame, lam: float = 0.4, alpha: float = 0.3, tau_days: float = 365.0, beta: float = 0.5) -> DataFrame:
    """The capped blend, times a factor that decays with days since the last unlock, counted from the latest in the data."""
    d = _capped(_base(inter, "blend", lam), alpha).crossJoin(F.broadcast(inter.agg(F.max("unlock_last").alias("_anchor"))))
    age = F.greatest((F.col("_anchor") - F.col("unlock_last")) / 86400.0, F.lit(0.0))
    return _out(d, F.col("_cap") * F.when(F.col("unlock_last").isNotNull(), beta + (1 - beta) * F.exp(-age / tau_days)).otherwise(1.0))


@score("temporal")
def cap_blend_span(inter: DataFrame, lam: float = 0.4, alpha: float = 0.3, w_span: float = 0.3) -> DataFrame:
    """The capped blend, raised by the percentile of the days between first and last unlock (of two or more)."""
    d = _capped(_base(inter, "blend", lam), alpha).withColumn("_span", F.when(F.coalesce("n_unlocks", F.lit(0)) >= 2, (F.col("unlock_last") - F.col("unlock_first")) / 86400.0))
    return _out(d, F.col("_cap") * (1 + w_span * F.coalesce(hazen("_span", "item_id", rank_zero=True), F.lit(0.0))))


@score("rarity")
def rarity_mastery_blend(inter: DataFrame, lam: float = 0.4) -> DataFrame:
    """Percentile blended with that of the mean surprisal of what was unlocked."""
    return _out(inter, _blend(F.coalesce(_pctl(), F.lit(0.0)), hazen("mean_surprisal", "item_id"), lam))


@score("rarity")
def rarity_depth_blend(inter: DataFrame, lam: float = 0.4) -> DataFrame:
    """Percentile blended with that of how rare the rarest unlock is."""
    d = inter.withColumn("_depth", 100.0 - F.col("min_pct"))
    return _out(d, _blend(F.coalesce(_pctl(), F.lit(0.0)), hazen("_depth", "item_id"), lam))


@score("intent")
def pvalue_eb_intent0(inter: DataFrame, eps: float = 0.05, cont_thr: float = 0.98, min_own: int = 3) -> DataFrame:
    """The p-value score, and eps for items owned but not played, unless the user played an item they come bundled with."""
    from affinix.operators.cooccurrence import containment_pairs

    # Written once: pairs, bundles and p-values each read it.
    inter = stored(inter.select("user_id", "item_id", "playtime"), f"{new_folder(inter.sparkSession, 'intent')}/interactions")
    partners = containment_pairs(inter, cont_thr, min_own)
    played = inter.where(_played()).select("user_id", F.col("item_id").alias("i"))
    blocked = inter.where("playtime = 0").select("user_id", F.col("item_id").alias("j")).join(partners, "j").join(played, ["user_id", "i"], "left_semi").select("user_id", F.col("j").alias("item_id")).distinct().withColumn("_blocked", F.lit(True))
    d = _pvalue(inter, 20.0).join(blocked, ["user_id", "item_id"], "left")
    return _out(d, F.when((F.col("playtime") == 0) & F.col("_blocked").isNull(), eps).otherwise(F.col("pv")))


def review_scores(reviews: DataFrame, alpha_pos: float = 0.3, alpha_neg: float = 0.5, mode: str = "linear") -> DataFrame:
    """reviews(item_id, user_id, voted, playtime) with ptile, s_round10, vote_factor and s_round10_rec added.

    mode 'fixed': a negative vote costs alpha_neg whatever the score; 'linear': in
    proportion to it.  The factor isn't below 0, the result within 0..10.
    """
    d = reviews.withColumn("ptile", average_percent_rank("playtime", "item_id")).withColumn("s_round10", F.least(F.greatest(F.rint(F.col("ptile") * 10), F.lit(0.0)), F.lit(10.0)).cast("int"))
    loss = F.lit(alpha_neg) * (1 - F.col("voted")) * (F.col("s_round10") / 10 if mode == "linear" else F.lit(1.0))
    d = d.withColumn("vote_factor", F.greatest(1 + alpha_pos * F.col("voted") - loss, F.lit(0.0)))
    return d.withColumn("s_round10_rec", F.least(F.greatest(F.col("s_round10") * F.col("vote_factor"), F.lit(0.0)), F.lit(10.0)))


def playtime_weight(playtime: Column, mean: Column) -> Column:
    """log(1 + playing time / the item's mean); 1 where the mean is unknown or 0."""
    return F.when(F.coalesce(mean, F.lit(0.0)) > 0, F.log1p(playtime / mean)).otherwise(1.0)


def liked_map(scores: DataFrame, pool: DataFrame, min_s: float = 0.0) -> DataFrame:
    """(user_id, liked): a map from item to s of each user's scores above min_s within the pool."""
    kept = scores.where(F.col("s") > min_s).join(pool.select("item_id"), "item_id", "left_semi")
    return kept.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_id", "s")))).alias("liked"))
