"""SQL shared by the oracles: the same frames as in sources and operators."""

from __future__ import annotations

LINES = """lines AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_linenumber AS INT) AS ach_id,
    CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS playtime, l_returnflag AS flag,
    CAST(round(l_tax * 100) AS INT) AS progress, CAST(epoch(l_shipdate) AS BIGINT) AS unlock_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ACH = """owners AS (SELECT item_id, count(DISTINCT user_id) AS owners FROM lines GROUP BY item_id),
ach AS (
  SELECT item_id, ach_id, 100.0::DOUBLE * count(DISTINCT user_id) / any_value(owners) AS pct
  FROM lines JOIN owners USING (item_id) WHERE flag = 'A' GROUP BY item_id, ach_id)"""

INTER = f"""{LINES}, {ACH},
base AS (
  SELECT user_id, item_id, sum(playtime) AS playtime, sum(progress) AS progress,
    min(unlock_time) FILTER (WHERE flag = 'A') AS unlock_first, max(unlock_time) FILTER (WHERE flag = 'A') AS unlock_last,
    count(*) FILTER (WHERE flag = 'A') AS n_unlocks
  FROM lines GROUP BY user_id, item_id),
rar AS (
  SELECT user_id, item_id, avg(-ln(least(greatest(pct, 0.1), 100.0) / 100)) AS mean_surprisal, min(pct) AS min_pct
  FROM lines JOIN ach USING (item_id, ach_id) WHERE flag = 'A' GROUP BY user_id, item_id),
tot AS (SELECT p_partkey AS item_id, CAST((p_size % 4) * 5 AS BIGINT) AS ach_total FROM part),
inter AS (
  SELECT user_id, item_id, playtime::DOUBLE AS playtime, least(ach_total, coalesce(progress, 0)::BIGINT) AS ach_unlocked, ach_total, unlock_first, unlock_last, n_unlocks,
    mean_surprisal, min_pct, CASE WHEN ach_total > 0 THEN least(ach_total, coalesce(progress, 0)::BIGINT)::DOUBLE / ach_total END AS completion
  FROM base LEFT JOIN tot USING (item_id) LEFT JOIN rar USING (user_id, item_id))"""


def hazen(v: str, by: str, cond: str) -> str:
    k = f"PARTITION BY {by}, coalesce({cond}, false)"
    return f"(CASE WHEN {cond} THEN (rank() OVER ({k} ORDER BY {v}) + (count(*) OVER ({k}, {v}) - 1) / 2.0 - 0.5)::DOUBLE / count(*) OVER ({k}) END)"


def normal_cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = f"((((1.061405429 * {t} + -1.453152027) * {t} + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592)"
    erf = f"(1 - {poly} * {t} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


PCTL = hazen("playtime", "item_id", "playtime > 0")
LIKED = f"""sc AS (SELECT user_id, item_id, coalesce({PCTL}, 0) AS s FROM inter),
lk0 AS (SELECT user_id, item_id FROM sc WHERE s >= 0.5),
lk AS (SELECT * FROM lk0 WHERE user_id IN (SELECT user_id FROM lk0 GROUP BY user_id HAVING count(*) >= 2))"""
COOC = f"""{LIKED},
half AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM lk a JOIN lk b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2),
deg AS (SELECT item_id, count(*) AS deg FROM lk GROUP BY item_id),
sim AS (
  SELECT i, j, c, c / sqrt(di.deg * dj.deg::DOUBLE) AS sim
  FROM (SELECT i, j, c FROM half UNION ALL SELECT j, i, c FROM half) p JOIN deg di ON di.item_id = i JOIN deg dj ON dj.item_id = j WHERE c >= 2)"""
