"""Queries of the feature frames and of every preference score."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinix.functions.maths import interpolated, rounded_scaled
from affinix.functions.windows import spread
from affinix.operators import features, scores
from affinix.plans._sql import INTER, LINES, PCTL, hazen, normal_cdf
from affinix.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def inter_of(spark, d):
    return features.interactions(tables.lines(spark, d), tables.items(spark, d))


def lines_number(spark, d):
    """The number of lines, from the files' footers: not fewer than interactions."""
    return tables.table(spark, d, "lineitem").count()


def rounded(df, *keep: str):
    """Doubles to six places."""
    return df.select(*[rounded_scaled(F.col(c), 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return register


@query("interactions", f"WITH {INTER} SELECT user_id, item_id, round(playtime, 6) AS playtime, ach_unlocked, ach_total, unlock_first, unlock_last, n_unlocks, round(mean_surprisal, 6) AS mean_surprisal, round(min_pct, 6) AS min_pct, round(completion, 6) AS completion FROM inter")
def _(spark, d):
    return inter_of(spark, d)


@query("achievement_rates", f"WITH {INTER} SELECT item_id, ach_id, round(pct, 6) AS pct FROM ach")
def _(spark, d):
    return features.achievement_rates(tables.lines(spark, d))


@query(
    "item_stats",
    f"""WITH {INTER}, b AS (
  SELECT item_id, count(*) AS n_owners, count(*) FILTER (WHERE playtime > 0) AS n_played,
    quantile_cont(playtime, [0.5, 0.9, 0.99]) FILTER (WHERE playtime > 0) AS q, avg(playtime) FILTER (WHERE playtime > 0) AS pt_mean,
    count(completion) FILTER (WHERE ach_total > 0) AS n_ach_rows, median(completion) FILTER (WHERE ach_total > 0) AS completion_median, avg(completion) FILTER (WHERE ach_total > 0) AS completion_mean
  FROM inter GROUP BY item_id), h AS (
  SELECT item_id, count(*) AS n_ach, quantile_cont(pct, [0.25, 0.5, 0.75]) AS a, avg(CASE WHEN pct < 5 THEN 1.0 ELSE 0.0 END) AS ach_deep_frac FROM ach GROUP BY item_id)
SELECT item_id, n_owners, n_played, round(q[1], 6) AS pt_median, round(pt_mean, 6) AS pt_mean, round(q[2], 6) AS pt_p90, round(q[3], 6) AS pt_p99, n_ach_rows,
  round(completion_median, 6) AS completion_median, round(completion_mean, 6) AS completion_mean, n_ach, round(a[2], 6) AS ach_pct_median, round(a[3] - a[1], 6) AS ach_pct_iqr, round(ach_deep_frac, 6) AS ach_deep_frac
FROM b LEFT JOIN h USING (item_id)""",
)
def _(spark, d):
    lines = tables.lines(spark, d)
    return features.item_stats(features.interactions(lines, tables.items(spark, d)), features.achievement_rates(lines))


@query(
    "user_stats",
    f"""WITH {INTER} SELECT user_id, count(*) AS lib_size, count(*) FILTER (WHERE playtime > 0) AS n_played, round(median(playtime) FILTER (WHERE playtime > 0), 6) AS pt_median,
  round(avg(playtime) FILTER (WHERE playtime > 0), 6) AS pt_mean, round(avg(CASE WHEN playtime = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_frac,
  count(*) FILTER (WHERE ach_total > 0) AS ach_items, round(avg(completion) FILTER (WHERE ach_total > 0), 6) AS completion_mean FROM inter GROUP BY user_id""",
)
def _(spark, d):
    return features.user_stats(inter_of(spark, d))


@query("extract_stats", f"WITH {INTER} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_rows, count(*) FILTER (WHERE playtime > 0) AS n_played FROM inter")
def _(spark, d):
    return features.extract_stats(inter_of(spark, d))


@query("eval_pool", "SELECT p_partkey AS item_id FROM part WHERE p_size > 10 AND p_size <= 45")
def _(spark, d):
    items = tables.items(spark, d).select("item_id", F.when(F.col("size") > 10, "game").alias("type"), F.when(F.col("size") > 20, (F.col("size") > 45).cast("int")).alias("coming_soon"))
    return features.eval_pool(items)


@query("usable_interactions", f"WITH {INTER} SELECT user_id, count(*) AS n FROM inter WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3) GROUP BY user_id")
def _(spark, d):
    users = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).cast("int").alias("public"), (F.col("c_nationkey") != 3).cast("int").alias("complete"))
    return features.usable(inter_of(spark, d), users).groupBy("user_id").agg(F.count("*").alias("n"))


_ZEROS = str([0.0] * 21)
_GRID = f"""WITH {INTER}, g AS (SELECT item_id, quantile_cont(playtime, [{", ".join(str(k / 20) for k in range(21))}]) AS grid FROM inter WHERE playtime > 0 GROUP BY item_id)"""


@query("pt_ecdf_grid", f"""{_GRID}, p AS (SELECT p_partkey AS item_id, coalesce(grid, {_ZEROS}::DOUBLE[]) AS grid FROM part LEFT JOIN g ON item_id = p_partkey)
SELECT item_id, round(unnest(grid), 6) AS q, unnest(range(21)) AS level FROM p""")
def _(spark, d):
    grid = features.playtime_grid(inter_of(spark, d), tables.items(spark, d))
    return grid.select("item_id", F.posexplode("grid").alias("level", "q")).select("item_id", "q", F.col("level").cast("long").alias("level"))


@query("ecdf_interp_weight", f"""{_GRID}, x AS (SELECT user_id, item_id, playtime, grid, len(list_filter(grid, lambda v: v <= playtime)) AS k FROM inter JOIN g USING (item_id))
SELECT user_id, item_id, round(round(CASE WHEN playtime <= 0 THEN 0.0 WHEN grid[21] <= 0 THEN 0.5 WHEN k = 0 THEN 0.0 WHEN k >= 21 THEN 1.0
  ELSE (k - 1) / 20.0 + (playtime - grid[k]) / (grid[k + 1] - grid[k]) * (k / 20.0 - (k - 1) / 20.0) END, 9), 6) AS w FROM x""")
def _(spark, d):
    inter = inter_of(spark, d)
    grid = features.playtime_grid(inter, inter.where("playtime > 0").select("item_id").distinct())
    levels = F.array(*[F.lit(k / 20) for k in range(21)])
    w = F.when(F.col("playtime") <= 0, 0.0).when(F.element_at("grid", -1) <= 0, 0.5).otherwise(interpolated(F.col("playtime"), F.col("grid"), levels))
    return inter.join(grid, "item_id").select("user_id", "item_id", rounded_scaled(w, 9).alias("w"))


# Scores.  Each oracle is SELECT user_id, item_id, <expression> over inter, through stages where needed.
_HAS = "coalesce(ach_total, 0) > 0"
_CP = hazen("c", "item_id", "c IS NOT NULL")
_C = f"cc AS (SELECT *, CASE WHEN {_HAS} THEN coalesce(completion, 0) END AS c FROM inter)"
_MED = "med AS (SELECT inter.*, m FROM inter LEFT JOIN (SELECT item_id, median(playtime) AS m FROM inter WHERE playtime > 0 GROUP BY item_id) USING (item_id))"
_PV = f"""fit AS (SELECT item_id, avg(ln(playtime)) AS mu_g, stddev_pop(ln(playtime)) AS sd_g, count(*) AS n_g FROM inter WHERE playtime > 0 GROUP BY item_id),
gl AS (SELECT avg(ln(playtime)) AS mu0, stddev_pop(ln(playtime)) AS sd0 FROM inter WHERE playtime > 0),
zz AS (SELECT inter.*, CASE WHEN playtime > 0 THEN (ln(playtime) - (n_g / (n_g + 20.0) * mu_g + (1 - n_g / (n_g + 20.0)) * mu0)) / greatest(n_g / (n_g + 20.0) * sd_g + (1 - n_g / (n_g + 20.0)) * sd0, 0.25) END AS z
  FROM inter LEFT JOIN fit USING (item_id) CROSS JOIN gl),
pv AS (SELECT *, CASE WHEN playtime > 0 THEN {normal_cdf("z")} ELSE 0.0 END AS pv FROM zz)"""


def _gate_sql(p: str) -> str:
    return f"(CASE WHEN {_HAS} AND coalesce(ach_unlocked, 0) = 0 AND coalesce({p} >= 0.8, false) THEN 0.25 ELSE 1.0 END)"


def _blend_sql(base: str, other: str, lam: float) -> str:
    return f"(CASE WHEN {other} IS NOT NULL THEN {lam} * coalesce({base}, 0) + {1 - lam} * {other} ELSE {base} END)"


def _cap_sql(stages: str, b: str, src: str, alpha: float) -> str:
    return f"{stages}bb AS (SELECT *, greatest(coalesce({b}, 0), 0) AS b FROM {src}), cap AS (SELECT *, coalesce(b / nullif(sum(b) OVER (PARTITION BY user_id), 0) * pow(count(*) OVER (PARTITION BY user_id), {alpha}), 0) AS cap FROM bb)"


def _score_sql(stages: str, expression: str, source: str = "inter") -> str:
    more = f", {stages}" if stages else ""
    return f"WITH {INTER}{more} SELECT user_id, item_id, round(greatest(coalesce({expression}, 0), 0)::DOUBLE, 6) AS s FROM {source}"


_LOGRATIO = "(CASE WHEN playtime > 0 THEN least(ln(1 + playtime / nullif(m, 0)), 4.0) / 4.0 END)"
_DQ = f"r1 AS (SELECT *, {hazen('playtime', 'user_id', 'playtime > 0')} AS r FROM inter), r2 AS (SELECT *, {hazen('r', 'item_id', 'r IS NOT NULL')} AS rr FROM r1)"
_CAPB = _cap_sql(f"{_C}, ", _blend_sql(PCTL, _CP, 0.4), "cc", 0.3)
_SCORES = {
    "anchor_binary": (dict(floor_min=20.0), _score_sql(_MED, "CASE WHEN playtime >= greatest(coalesce(m, 20.0), 20.0) THEN 1.0 ELSE 0.0 END", "med")),
    "pctl_game": ({}, _score_sql("", PCTL)),
    "logratio_median": ({}, _score_sql(_MED, _LOGRATIO, "med")),
    "pvalue_lognorm_eb": ({}, _score_sql(_PV, "pv", "pv")),
    "pctl_user": ({}, _score_sql("", hazen("playtime", "user_id", "playtime > 0"))),
    "double_quantile": ({}, _score_sql(_DQ, "rr", "r2")),
    "ach_completion_mult": ({}, _score_sql("", f"{PCTL} * (CASE WHEN {_HAS} THEN 0.4 + 0.6 * coalesce(completion, 0) ELSE 1.0 END)")),
    "ach_completion_pctl_blend": ({}, _score_sql(_C, _blend_sql(PCTL, _CP, 0.6), "cc")),
    "afk_joint_gate": ({}, _score_sql("", f"{PCTL} * {_gate_sql(PCTL)}")),
    "random_s": ({}, _score_sql("", "CASE WHEN playtime > 0 THEN (((user_id * 31 + item_id) * 7919 + 42) % 10007) / 10007.0 END")),
    "random_support": ({}, f"""WITH {INTER}, p AS (SELECT user_id, item_id, ((user_id * 31 + item_id) * 7919 + 42) % 10007 AS h0, ((user_id * 31 + item_id) * 7919 + 43) % 10007 AS h1 FROM inter WHERE playtime > 0),
a AS (SELECT user_id, h0, row_number() OVER (ORDER BY h0, user_id, item_id) AS n FROM p), b AS (SELECT item_id, row_number() OVER (ORDER BY h1, user_id, item_id) AS n FROM p)
SELECT user_id, item_id, round(min(h0 / 10007.0)::DOUBLE, 6) AS s FROM a JOIN b USING (n) GROUP BY user_id, item_id"""),
    "comp_afk_combo": ({}, _score_sql(_C, f"{_blend_sql(PCTL, _CP, 0.6)} * {_gate_sql(PCTL)}", "cc")),
    "resid2way_completion": ({}, _score_sql(f"""{_C}, gr AS (SELECT cc.*, (SELECT avg(c) FROM cc) AS grand FROM cc),
rs AS (SELECT *, round(c - (coalesce(sum(c) OVER (PARTITION BY user_id), 0) + 5 * grand) / (count(c) OVER (PARTITION BY user_id) + 5) - avg(c) OVER (PARTITION BY item_id) + grand, 10) AS r FROM gr)""", _blend_sql(PCTL, hazen("r", "item_id", "r IS NOT NULL"), 0.6), "rs")),
    "bm25_sat": ({}, _score_sql(_MED, "CASE WHEN playtime > 0 THEN playtime / (playtime + coalesce(nullif(m, 0), 60.0)) END", "med")),
    "per_user_cap": ({}, _score_sql(_cap_sql("", PCTL, "inter", 0.5), "cap", "cap")),
    "per_user_cap_blend": (dict(base="blend"), _score_sql(_cap_sql(f"{_C}, ", _blend_sql(PCTL, _CP, 0.6), "cc", 0.5), "cap", "cap")),
    "per_user_cap_double": (dict(base="double_quantile"), _score_sql(_cap_sql(f"{_DQ}, ", "rr", "r2", 0.5), "cap", "cap")),
    "per_user_cap_logratio": (dict(base="logratio"), _score_sql(_cap_sql(f"{_MED}, ", _LOGRATIO, "med", 0.5), "cap", "cap")),
    "per_user_cap_pvalue": (dict(base="pvalue"), _score_sql(_cap_sql(f"{_PV}, ", "pv", "pv", 0.5), "cap", "cap")),
    "pvalue_comp_blend": ({}, _score_sql(f"{_PV}, pc AS (SELECT *, CASE WHEN {_HAS} THEN coalesce(completion, 0) END AS c FROM pv)", _blend_sql("pv", _CP, 0.6), "pc")),
    "cap_blend_recency": ({}, _score_sql(_CAPB, "cap * (CASE WHEN unlock_last IS NOT NULL THEN 0.5 + 0.5 * exp(-greatest(((SELECT max(unlock_last) FROM inter) - unlock_last) / 86400.0, 0) / 365.0) ELSE 1.0 END)", "cap")),
    "cap_blend_span": ({}, _score_sql(f"{_CAPB}, sp AS (SELECT *, CASE WHEN n_unlocks >= 2 THEN (unlock_last - unlock_first) / 86400.0 END AS sp FROM cap)", f"cap * (1 + 0.3 * coalesce({hazen('sp', 'item_id', 'sp IS NOT NULL')}, 0))", "sp")),
    "rarity_mastery_blend": ({}, _score_sql("", _blend_sql(f"coalesce({PCTL}, 0)", hazen("mean_surprisal", "item_id", "mean_surprisal > 0"), 0.4))),
    "rarity_depth_blend": ({}, _score_sql("dd AS (SELECT *, 100.0 - min_pct AS depth FROM inter)", _blend_sql(f"coalesce({PCTL}, 0)", hazen("depth", "item_id", "depth > 0"), 0.4), "dd")),
    "pvalue_eb_intent0": (dict(cont_thr=0.3), _score_sql(f"""{_PV}, own AS (SELECT item_id, count(*) AS n FROM inter GROUP BY item_id HAVING count(*) >= 3),
cp AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM inter a JOIN inter b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
par AS (SELECT i, j FROM cp JOIN own oi ON oi.item_id = i JOIN own oj ON oj.item_id = j WHERE c >= 0.3 * least(oi.n, oj.n)),
bl AS (SELECT DISTINCT z.user_id, z.item_id FROM inter z JOIN par ON par.j = z.item_id JOIN inter p ON p.user_id = z.user_id AND p.item_id = par.i AND p.playtime > 0 WHERE z.playtime = 0),
ps AS (SELECT pv.*, bl.user_id IS NOT NULL AS blocked FROM pv LEFT JOIN bl USING (user_id, item_id))""", "CASE WHEN playtime = 0 AND NOT blocked THEN 0.05 ELSE pv END", "ps")),
}


def _register(name: str, params: dict, sql: str) -> None:
    of = name if name in scores.REGISTRY else "per_user_cap"

    @query(f"score_{name}", sql)
    def _(spark, d):
        # Interactions come dealt by item.
        more = {"rows": lines_number(spark, d)} if of in ("per_user_cap", "resid2way_completion") else {}
        return scores.compute(of, inter_of(spark, d), **params, **more)


for _name, (_params, _sql) in _SCORES.items():
    _register(_name, _params, _sql)

_REV = f"""WITH {LINES}, rv AS (SELECT item_id, user_id, CASE WHEN max(flag) = 'R' THEN 0 ELSE 1 END AS voted, sum(playtime) AS playtime FROM lines GROUP BY item_id, user_id),
pt AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY item_id) > 1 THEN (rank() OVER (PARTITION BY item_id ORDER BY playtime) + (count(*) OVER (PARTITION BY item_id, playtime) - 1) / 2.0 - 1)::DOUBLE / (count(*) OVER (PARTITION BY item_id) - 1) ELSE 1.0 END AS ptile FROM rv),
s10 AS (SELECT *, CAST(least(greatest(round_even(ptile * 10, 0), 0), 10) AS INT) AS s_round10 FROM pt)
"""


def _reviews(spark, d):
    lines = spread(tables.lines(spark, d).select("item_id", "user_id", "flag", "playtime"), "item_id", lines_number(spark, d))
    return lines.groupBy("item_id", "user_id").agg(F.when(F.max("flag") == "R", 0).otherwise(1).alias("voted"), F.sum("playtime").alias("playtime"))


for _mode, _loss in (("linear", "s_round10 / 10.0"), ("fixed", "1.0")):
    query(f"review_scores_{_mode}", f"""{_REV}, vf AS (SELECT *, greatest(1 + 0.3 * voted - 0.5 * (1 - voted) * {_loss}, 0) AS vote_factor FROM s10)
SELECT item_id, user_id, voted, playtime, round(ptile, 6) AS ptile, s_round10, round(vote_factor::DOUBLE, 6) AS vote_factor, round(least(greatest(s_round10 * vote_factor, 0), 10)::DOUBLE, 6) AS s_round10_rec FROM vf""")(
        lambda spark, d, mode=_mode: scores.review_scores(_reviews(spark, d), mode=mode)
    )


@query("playtime_weight", f"WITH {INTER}, m AS (SELECT item_id, avg(playtime) AS mean FROM inter GROUP BY item_id) SELECT user_id, item_id, round(CASE WHEN mean > 0 THEN ln(1 + playtime / mean) ELSE 1.0 END, 6) AS w FROM inter JOIN m USING (item_id)")
def _(spark, d):
    inter = inter_of(spark, d)
    mean = inter.groupBy("item_id").agg(F.avg("playtime").alias("mean"))
    return inter.join(mean, "item_id").select("user_id", "item_id", scores.playtime_weight(F.col("playtime"), F.col("mean")).alias("w"))


@query("liked_map", f"WITH {INTER}, s AS (SELECT user_id, item_id, coalesce({PCTL}, 0) AS s FROM inter) SELECT user_id, count(*) AS n, string_agg(item_id || '=' || CAST(round(s * 1000000)::BIGINT AS VARCHAR), ',' ORDER BY item_id) AS items FROM s WHERE s > 0.25 AND item_id IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY user_id")
def _(spark, d):
    inter = inter_of(spark, d)
    m = scores.liked_map(scores.pctl_game(inter), tables.items(spark, d).where("size > 10"), 0.25)
    return m.select("user_id", F.size("liked").cast("long").alias("n"), F.array_join(F.transform(F.array_sort(F.map_entries("liked")), lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.round(x["value"] * 1_000_000).cast("long").cast("string"))), ",").alias("items"))
