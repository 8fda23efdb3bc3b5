"""Queries of the catalogue, text functions and the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinix.functions import maths, text
from affinix.operators import catalogue, evaluation, recommend, sampling, statistics, store
from affinix.plans.engagement import rounded
from affinix.sources import files, tables
from affinix.streaming.upserts import activity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return register


VOTES = "votes AS (SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1)"
TAGS = f"""{VOTES}, tags AS (SELECT item_id, tag, max(weight)::DOUBLE AS weight FROM (
  SELECT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS tag, coalesce(n, 0) AS weight FROM part LEFT JOIN votes ON item_id = p_partkey
  UNION ALL SELECT p_partkey, lower(p_type), 5 FROM part UNION ALL SELECT p_partkey, lower(p_brand), 3 FROM part) WHERE weight > 0 GROUP BY 1, 2)"""


def votes_of(spark, d):
    return tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"))


def tags_of(spark, d):
    """(item_id, tag, weight): words of the name weighted by lines, the type by 5, the brand by 3."""
    items = tables.items(spark, d).join(votes_of(spark, d), "item_id", "left")
    words = items.select("item_id", F.explode(F.split("name", " ")).alias("tag"), F.coalesce("n", F.lit(0)).alias("weight"))
    rows = words.union(items.select("item_id", F.lower("type"), F.lit(5).cast("long"))).union(items.select("item_id", F.lower("brand"), F.lit(3).cast("long")))
    return rows.where("weight > 0").groupBy("item_id", "tag").agg(F.max("weight").cast("double").alias("weight"))


def json_of(spark, d):
    """(item_id, tags_json): the same as one JSON object for each item."""
    return tags_of(spark, d).groupBy("item_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tag", F.col("weight").cast("long"))))).alias("tags_json"))


@query("tag_normalize", r"""SELECT p_partkey AS item_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(' ' || p_brand || ' /  ' || p_type || '-' || p_name || '/ '), '\s+', ' ', 'g')), '[/ ]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM part""")
def _(spark, d):
    raw = F.concat(F.lit(" "), "brand", F.lit(" /  "), "type", F.lit("-"), "name", F.lit("/ "))
    return tables.items(spark, d).select("item_id", text.normalize_tag(raw, ascii_only=True).alias("tag"))


@query("tag_words_unicode")
def _(spark, d):
    """Normalised words of whole documents, with compatibility forms, and how often each comes."""
    words = tables.table(spark, d, "documents").select(F.explode(F.split("text", r"[\s.,]+")).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).select(catalogue.clean_tag(F.col("w")).alias("tag"), "n").where("tag <> ''").groupBy("tag").agg(F.sum("n").alias("n"))


@query("json_tag_rows", "SELECT event_id, 'k' AS tag, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS weight FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 5")
def _(spark, d):
    return text.json_weights(tables.table(spark, d, "events"), "props", ["event_id"])


_CLEAN = "SELECT item_id, regexp_replace(tag, '[/ ]', '-', 'g') AS tag, weight FROM tags WHERE weight >= 5"


@query("tag_rows", f"WITH {TAGS} {_CLEAN}")
def _(spark, d):
    return catalogue.tag_rows(json_of(spark, d), ascii_only=True)


@query("tag_list_rows", "SELECT DISTINCT p_partkey AS item_id, unnest([lower(p_type), string_split(p_name, ' ')[1]]) AS tag, 1.0::DOUBLE AS weight FROM part")
def _(spark, d):
    listed = tables.items(spark, d).select("item_id", F.concat_ws(", ", F.lit(""), F.col("type"), F.split("name", " ")[0], F.lit(" ")).alias("tags"))
    return catalogue.tag_rows(listed, ascii_only=True)


@query("tag_vocabulary", f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def _(spark, d):
    return catalogue.vocabulary(tags_of(spark, d))


@query("top_tags", f"WITH {TAGS} SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def _(spark, d):
    return catalogue.top_tags(tags_of(spark, d))


@query("tag_bags", f"WITH {TAGS} SELECT item_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags WHERE tag NOT LIKE 'brand%' AND item_id IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY item_id")
def _(spark, d):
    rows = tags_of(spark, d)
    allowed = catalogue.vocabulary(rows).where("tag not like 'brand%'")
    return catalogue.tag_bags(rows, tables.items(spark, d).where("size > 10"), allowed).select("item_id", F.array_join("tags", ",").alias("tags"))


@query("tag_matrix", f"WITH {TAGS} SELECT item_id, tag, 1 AS value FROM tags")
def _(spark, d):
    return catalogue.tag_matrix(catalogue.tag_bags(tags_of(spark, d), tables.items(spark, d)))


@query("dropped_tags", f"WITH {TAGS}, v AS (SELECT tag FROM tags GROUP BY tag HAVING count(*) >= 90) SELECT count(*) AS n_dropped FROM tags WHERE tag NOT IN (SELECT tag FROM v)")
def _(spark, d):
    rows = tags_of(spark, d)
    return catalogue.dropped_tags(rows, catalogue.vocabulary(rows).where("n >= 90"))


@query("owners_midpoint", "SELECT p_partkey AS item_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 1500.0 END::DOUBLE AS midpoint FROM part")
def _(spark, d):
    return _owners(spark, d)


def _owners(spark, d):
    size = F.col("size")
    raw = F.when(size % 7 == 0, F.lit("none")).otherwise(F.concat(size, F.lit(",000 .. "), size * 2, F.lit(",000")))
    return tables.items(spark, d).select("item_id", text.owners_midpoint(raw).alias("midpoint"))


_POP = f"""{VOTES}, pop AS (SELECT p_partkey AS item_id, coalesce(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 1500.0 END, n, 1.0)::DOUBLE AS popularity,
  CASE WHEN p_size % 7 <> 0 THEN 'owners' WHEN n IS NOT NULL THEN 'reviews' ELSE 'imputed' END AS source FROM part LEFT JOIN votes ON item_id = p_partkey)"""


def popularity_of(spark, d):
    reviews = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"))
    return catalogue.popularity_chain(tables.items(spark, d), _owners(spark, d), reviews)


@query("popularity_chain", f"WITH {_POP} SELECT item_id, popularity, source FROM pop")
def _(spark, d):
    return popularity_of(spark, d)


@query("popularity_summary", f"WITH {_POP} SELECT count(*) AS n, min(popularity) AS min, max(popularity) AS max, median(popularity) AS median, round(avg(popularity), 6) AS mean, count(*) FILTER (WHERE source = 'owners') AS n_owners, count(*) FILTER (WHERE source = 'reviews') AS n_reviews, count(*) FILTER (WHERE source = 'imputed') AS n_imputed FROM pop")
def _(spark, d):
    return catalogue.popularity_summary(popularity_of(spark, d))


@query("popularity_floor", "WITH r AS (SELECT l_partkey AS item_id, avg(l_tax) - 0.03 AS rate FROM lineitem GROUP BY 1) SELECT p_partkey AS item_id, round(coalesce(CASE WHEN rate > 0 THEN rate END, (SELECT min(rate) FROM r WHERE rate > 0)), 6) AS popularity FROM part LEFT JOIN r ON item_id = p_partkey")
def _(spark, d):
    rates = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg((F.avg("l_tax") - 0.03).alias("rate"))
    return catalogue.popularity_floor(tables.items(spark, d), rates)


_VOTE = """v AS (SELECT l_partkey AS item_id, count(*) FILTER (WHERE l_returnflag <> 'R') AS positive, count(*) AS n FROM lineitem GROUP BY 1),
raw AS (SELECT item_id, 10.0::DOUBLE * positive / n AS raw, n FROM v),
gm AS (SELECT sum(raw * least(n, 1000)) / sum(least(n, 1000)) AS global_mean FROM raw),
ql AS (SELECT item_id, raw, n, global_mean, (n * raw + 200 * global_mean) / (n + 200) AS q FROM raw CROSS JOIN gm)"""


def vote_quality_of(spark, d):
    votes = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("positive"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("negative"))
    return catalogue.vote_quality(votes)


@query("quality_votes", f"WITH {_VOTE} SELECT item_id, round(raw, 6) AS raw, n, round(global_mean, 6) AS global_mean, round(q, 6) AS q FROM ql")
def _(spark, d):
    return vote_quality_of(spark, d)


@query("quality_scores", "WITH r AS (SELECT l_partkey AS item_id, avg(l_discount * 100) AS raw, count(*) AS n FROM lineitem GROUP BY 1), g AS (SELECT avg(l_discount * 100) AS global_mean FROM lineitem) SELECT item_id, round(raw, 6) AS raw, n, round(global_mean, 6) AS global_mean, round((n * raw + 20 * global_mean) / (n + 20), 6) AS q FROM r CROSS JOIN g")
def _(spark, d):
    return catalogue.score_quality(tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), (F.col("l_discount") * 100).alias("s")))


_QPCT = f"{_VOTE}, qp AS (SELECT item_id, (row_number() OVER (ORDER BY round(q, 9), item_id) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS pct FROM ql WHERE n >= 5)"


def quality_pct_of(spark, d):
    return catalogue.quality_percentile(vote_quality_of(spark, d).withColumn("q", F.round("q", 9)))


@query("quality_percentile", f"WITH {_QPCT} SELECT item_id, round(pct, 6) AS pct FROM qp")
def _(spark, d):
    return quality_pct_of(spark, d)


_CAT = """cat AS (SELECT p_partkey AS item_id, p_size % 2 = 0 AS coop, p_size % 3 = 0 AS multiplayer, p_size % 3 <> 0 AS single_player, p_size > 25 AS korean,
  CASE WHEN p_size % 10 = 0 THEN 0.0 WHEN p_size % 11 = 0 THEN NULL ELSE round(p_retailprice * 100) / 100.0 END::DOUBLE AS price,
  CASE WHEN p_size % 10 = 0 THEN 'KRW' WHEN p_size % 13 = 0 THEN 'USD' ELSE 'KRW' END AS currency, p_size % 10 = 0 AS is_free,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(2000 + p_size % 25 AS VARCHAR) END AS release, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size + 45)::DOUBLE END AS metacritic FROM part)"""


def catalogue_of(spark, d):
    n = F.col("size")
    kinds = F.concat_ws(",", F.when(n % 2 == 0, F.lit('{"description":"Co-op"}')), F.when(n % 3 == 0, F.lit('{"description":"Multi-player"}')).otherwise(F.lit('{"description":"Single-player"}')))
    raw = tables.items(spark, d).select(
        "item_id",
        F.concat(F.lit("["), kinds, F.lit("]")).alias("categories_json"),
        F.when(n > 25, F.lit("English, Korean")).otherwise(F.lit("English")).alias("languages"),
        F.when(n % 11 != 0, F.round(F.col("price") * 100)).alias("price_final"),
        F.when(n % 13 == 0, F.lit("USD")).otherwise(F.lit("KRW")).alias("price_currency"),
        (n % 10 == 0).alias("is_free"),
        F.when(n % 9 == 0, F.lit("")).otherwise((2000 + n % 25).cast("string")).alias("release_date"),
        F.when(n % 4 == 0, 0).otherwise(n + 45).alias("metacritic"),
    )
    return catalogue.constraint_row(raw)


@query("catalog_constraints", f"WITH {_CAT} SELECT item_id, coop, multiplayer, single_player, korean, round(price, 6) AS price, currency, is_free, release, metacritic FROM cat")
def _(spark, d):
    return catalogue_of(spark, d)


def _all_pairs(spark, d):
    """Every bought item of every user as a candidate."""
    return tables.lines(spark, d).groupBy("user_id", "item_id").agg(F.count("*").alias("c"))


_PAIRS = "pairs AS (SELECT o_custkey AS user_id, l_partkey AS item_id, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query("constraint_filter", f"WITH {_CAT}, {_PAIRS} SELECT user_id, item_id, c FROM pairs JOIN cat USING (item_id) WHERE coop AND korean AND price <= 1500 AND currency = 'KRW' AND CAST(release AS INT) >= 2010")
def _(spark, d):
    return recommend.constrained(_all_pairs(spark, d), catalogue_of(spark, d), {"coop": True, "korean": True, "max_price": 1500, "released_after": "2010-01-01", "free": None}).select("user_id", "item_id", "c")


@query("quality_gate", f"""WITH {_CAT}, {_QPCT}, {_PAIRS} SELECT user_id, item_id, c FROM pairs LEFT JOIN cat USING (item_id) LEFT JOIN qp USING (item_id) WHERE (metacritic IS NULL OR metacritic >= 75) AND (pct IS NULL OR pct >= 0.3)""")
def _(spark, d):
    signals = catalogue_of(spark, d).select("item_id", "metacritic").join(quality_pct_of(spark, d).withColumnRenamed("pct", "quality_pct"), "item_id", "left").withColumn("pop_pct", F.lit(None).cast("double"))
    return recommend.quality_gate(_all_pairs(spark, d), signals, 75, 0.3).select("user_id", "item_id", "c")


@query("availability", f"WITH {_CAT}, {_PAIRS} SELECT user_id, item_id, c FROM pairs LEFT JOIN cat USING (item_id) WHERE coalesce(is_free OR price IS NOT NULL, true)")
def _(spark, d):
    return recommend.available(_all_pairs(spark, d), catalogue_of(spark, d)).select("user_id", "item_id", "c")


@query("release_date_parse", """SELECT o_orderkey AS order_id, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN date_trunc('month', o_orderdate) WHEN 3 THEN date_trunc('year', o_orderdate) END AS DATE) AS released FROM orders""")
def _(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(t, "MMM d, yyyy")).when(k == 1, F.date_format(t, "d MMM, yyyy")).when(k == 2, F.date_format(t, "MMM yyyy")).when(k == 3, F.date_format(t, "yyyy")).otherwise(F.lit("soon"))
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), text.parsed_date(raw).alias("released"))


@query("series_prefix", r"SELECT p_partkey AS item_id, trim(string_split_regex(lower(trim(p_name || ' ' || p_size || ': ' || p_type)), '\s+(?:[ivx]+|\d+)(?:\s|:|$)|\s*:\s*')[1]) AS prefix FROM part")
def _(spark, d):
    title = F.concat("name", F.lit(" "), "size", F.lit(": "), "type")
    return tables.items(spark, d).select("item_id", text.series_prefix(title).alias("prefix"))


@query("title_match", r"""WITH w AS (SELECT DISTINCT lower(p_type || ' ' || p_name) AS wanted FROM part), p AS (SELECT wanted, trim(string_split_regex(wanted, '\s+(?:[ivx]+|\d+)(?:\s|:|$)|\s*:\s*')[1]) AS pf FROM w)
SELECT wanted, p_partkey AS item_id FROM p JOIN part ON contains(lower(p_name), wanted) OR (length(p_name) >= 4 AND contains(wanted, lower(p_name))) OR (length(pf) >= 4 AND (lower(p_name) = pf OR starts_with(lower(p_name), pf || ' ') OR starts_with(lower(p_name), pf || ':')))""")
def _(spark, d):
    items = tables.items(spark, d)
    wanted = items.select(F.lower(F.concat("type", F.lit(" "), "name")).alias("wanted")).distinct()
    hits = catalogue.title_matches(wanted, items.select(F.col("name").alias("title")))
    return items.join(hits, items["name"] == hits["title"]).select("wanted", "item_id")


@query("binary_rounding", """WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 2 + 1 AS o FROM lineitem), b AS (SELECT *, (o * 625 - 1) // 2 AS b FROM o) SELECT l_orderkey, l_linenumber, o / 32.0 AS shown, b + b % 2 AS units FROM b""")
def _(spark, d):
    """Odd numbers of thirty-seconds lie between two numbers of four places, exactly, and go to the even one."""
    odd = F.col("l_quantity").cast("long") * 2 + 1
    value = odd / F.lit(32.0)
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("shown"), F.rint(maths.rounded_binary(value, 4) * 10000).cast("long").alias("units"))


@query("vote_words", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS voted FROM lineitem")
def _(spark, d):
    raw = F.when(F.col("l_linestatus") == "F", F.lit(" Yes ")).otherwise(F.lit("nope"))
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", text.vote(raw).alias("voted"))


@query("regression_fitness", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_discount * 10 > 0.9 THEN 'excellent' WHEN l_discount * 10 > 0.7 THEN 'good' WHEN l_discount * 10 > 0.5 THEN 'fair' ELSE 'poor' END AS fitness FROM lineitem")
def _(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", evaluation.fitness(F.col("l_discount") * 10).alias("fitness"))


# The store: orders of before 1996 are old rows, the others come in.
_OLD = "old AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderdate AS t, o_orderkey AS seq, o_orderpriority AS p FROM orders WHERE o_orderdate < DATE '1996-01-01'), new AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderdate AS t, o_orderkey AS seq, o_orderpriority AS p FROM orders WHERE o_orderdate >= DATE '1996-01-01')"


def _halves(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("p"))
    return o.where("t < DATE '1996-01-01'"), o.where("t >= DATE '1996-01-01'")


@query("upsert_latest", f"WITH {_OLD} SELECT k, round(v, 6) AS v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) WHERE n = 1")
def _(spark, d):
    old, new = _halves(spark, d)
    return store.latest(old, new, ["k"], "seq").select("k", "v", "seq")


@query("insert_ignore", f"WITH {_OLD}, o1 AS (SELECT k, min(seq) AS seq FROM old GROUP BY k) SELECT k, seq FROM o1 UNION ALL SELECT k, min(seq) FROM new WHERE k NOT IN (SELECT k FROM o1) GROUP BY k")
def _(spark, d):
    old, new = _halves(spark, d)
    return store.inserted(old.groupBy("k").agg(F.min("seq").alias("seq")), new.select("k", "seq"), ["k"], "seq")


@query("upsert_columns", f"WITH {_OLD}, a AS (SELECT k, min(v) AS v, max(p) AS p FROM old GROUP BY k), b AS (SELECT k, max(v) AS v FROM new GROUP BY k) SELECT coalesce(a.k, b.k) AS k, round(CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END, 6) AS v, p FROM a FULL JOIN b ON a.k = b.k")
def _(spark, d):
    old, new = _halves(spark, d)
    return store.updated(old.groupBy("k").agg(F.min("v").alias("v"), F.max("p").alias("p")), new.groupBy("k").agg(F.max("v").alias("v")), ["k"], ["v"])


@query("intern_ids", f"WITH {_OLD}, k AS (SELECT count(*) AS n FROM (SELECT DISTINCT k, p FROM old)), a AS (SELECT count(*) AS n FROM (SELECT DISTINCT k, p FROM (SELECT * FROM old UNION ALL SELECT * FROM new))) SELECT a.n AS n_names, a.n AS n_ids, 1 AS low, a.n AS high, k.n AS n_kept, k.n AS high_of_old FROM a CROSS JOIN k")
def _(spark, d):
    """Which name has which id follows a hash; that ids are distinct, without gaps, kept, and those of old names below all others, every engine can say."""
    old, new = _halves(spark, d)
    known = store.interned(spark.createDataFrame([], "k long, p string, id long"), old, ["k", "p"])
    both = store.interned(known, new, ["k", "p"])
    kept = known.withColumnRenamed("id", "old_id").join(both, ["k", "p"], "right")
    return kept.agg(F.countDistinct("k", "p").alias("n_names"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.when(F.col("id") == F.col("old_id"), 1)).alias("n_kept"), F.max("old_id").alias("high_of_old"))


@query("pending_queue", f"WITH {_OLD} SELECT k AS user_id, p AS depth, seq FROM new WHERE k NOT IN (SELECT k FROM old) ORDER BY p, seq LIMIT 500")
def _(spark, d):
    old, new = _halves(spark, d)
    return store.pending(new.select(F.col("k").alias("user_id"), F.col("p").alias("depth"), "seq"), old.select(F.col("k").alias("user_id"), F.lit(1).alias("complete")).distinct(), 500)


@query("unfetched_items", "SELECT DISTINCT l_partkey AS item_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, d):
    return store.unfetched(tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id")), tables.items(spark, d).where("size > 10"))


@query("merge_columns", f"WITH {_OLD}, a AS (SELECT k, min(v) AS v, max(p) AS p FROM old GROUP BY k), b AS (SELECT k, max(CASE WHEN k % 3 <> 0 THEN v END) AS v, max(CASE WHEN k % 2 = 0 THEN p END) AS p, max(seq) AS seq FROM new GROUP BY k) SELECT coalesce(a.k, b.k) AS k, round(coalesce(b.v, a.v), 6) AS v, coalesce(b.p, a.p) AS p, b.seq FROM a FULL JOIN b ON a.k = b.k")
def _(spark, d):
    """New rows lack some values: those of the old rows stay, column by column."""
    old, new = _halves(spark, d)
    some = new.select("k", F.when(F.col("k") % 3 != 0, F.col("v")).alias("v"), F.when(F.col("k") % 2 == 0, F.col("p")).alias("p"), "seq")
    return store.merged(old.groupBy("k").agg(F.min("v").alias("v"), F.max("p").alias("p")), some, ["k"])


@query("queue_depths", f"WITH {_OLD}, q AS (SELECT DISTINCT k, 0 AS depth FROM old UNION ALL SELECT DISTINCT k, 1 FROM new WHERE k NOT IN (SELECT k FROM old)) SELECT depth, count(*) AS n_users, count(*) FILTER (WHERE k % 5 <> 0) AS n_pending FROM q GROUP BY depth")
def _(spark, d):
    old, new = _halves(spark, d)
    empty = spark.createDataFrame([], "user_id long, depth int, seq long")
    queue = store.enqueued(store.enqueued(empty, old.select(F.col("k").alias("user_id")), 0), new.select(F.col("k").alias("user_id")), 1)
    return store.queue_depths(queue, queue.where("user_id % 5 = 0").select("user_id", F.lit(1).alias("complete")))


# Samples.
_PRIME = statistics.PRIME


def _drawn_sql(x: str) -> str:
    for add in (40_692, 16_807, 950_706):
        x = f"list_transform([{x}], lambda y: (y * y + y * {add} + {add}) % {_PRIME})[1]"
    return x


_USERS = "us AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 3 <> 0 THEN 1 ELSE 0 END AS public, CASE WHEN c_nationkey % 5 <> 0 THEN 1 ELSE 0 END AS complete FROM customer), ow AS (SELECT o_custkey AS user_id, l_partkey AS item_id, sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END)::DOUBLE AS playtime FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def users_of(spark, d):
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 3 != 0).cast("int").alias("public"), (F.col("c_nationkey") % 5 != 0).cast("int").alias("complete"))


@query("example_library", f"""WITH {_USERS}, pr AS (SELECT user_id, row_number() OVER (ORDER BY user_id * 7919 % 1000003, user_id) AS try FROM us WHERE public = 1 AND complete = 1),
lib AS (SELECT user_id, item_id, playtime, try FROM ow JOIN pr USING (user_id) JOIN part ON p_partkey = item_id WHERE p_size > 10 AND playtime > 0 AND try <= 200), f AS (SELECT user_id FROM lib GROUP BY user_id, try HAVING count(*) >= 8 ORDER BY try LIMIT 1) SELECT user_id, item_id, round(playtime, 6) AS playtime FROM lib JOIN f USING (user_id)""")
def _(spark, d):
    owned = tables.lines(spark, d).groupBy("user_id", "item_id").agg(F.sum("playtime").alias("playtime"))
    return sampling.example_library(users_of(spark, d), owned, tables.items(spark, d).where("size > 10"))


@query("unscreened_candidates", f"""WITH n AS (SELECT count(*) // 10 AS n, 3 * count(*) AS top FROM customer), dr AS (SELECT t AS try, 1 + {_drawn_sql(f"((t % {_PRIME}) * 48271 + 42) % {_PRIME}")} % top AS user_id FROM n, unnest(range(1, 5 * n + 1)) AS r(t)),
o AS (SELECT try, user_id, row_number() OVER (ORDER BY try) AS r FROM dr WHERE user_id NOT IN (SELECT c_custkey FROM customer)) SELECT try, user_id FROM o, n WHERE r <= n""")
def _(spark, d):
    """A tenth as many ids as there are customers, drawn from three times as many."""
    known = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    total = known.count()
    return sampling.unscreened(spark, known, total // 10, 0, 3 * total)


@query("first_seen_sample", "WITH s AS (SELECT o_custkey AS user_id, min(o_orderkey) AS f FROM orders GROUP BY 1), h AS (SELECT user_id FROM s ORDER BY f, user_id LIMIT 300) SELECT user_id, row_number() OVER (ORDER BY (user_id * 7919 + 42) % 1000003, user_id) AS place FROM h")
def _(spark, d):
    return sampling.first_seen(tables.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq")), "user_id", "seq", 300)


@query("bottom_k_by_group", "WITH k AS (SELECT DISTINCT l_returnflag AS flag, l_partkey AS item_id FROM lineitem), r AS (SELECT *, (item_id * 7919 + 42) % 1000003 AS priority, row_number() OVER (PARTITION BY flag ORDER BY (item_id * 7919 + 42) % 1000003, item_id) AS rank FROM k) SELECT flag, item_id, priority, rank FROM r WHERE rank <= 50")
def _(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("item_id"))
    return sampling.bottom_k(rows, "item_id", 50, ["flag"])


@query("table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def _(spark, d):
    return store.counts(**{t: tables.table(spark, d, t) for t in ("orders", "lineitem", "events")})


@query("event_activity", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, user_id, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    events = tables.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return activity(events).select(F.unix_seconds("start").alias("start"), "user_id", "n", "value")


@query("file_fingerprint")
def _(spark, d):
    return files.fingerprints(spark, d, "*.parquet")


@query("account_number_scan", r"""WITH n AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]{16}'), lambda x: x <> '4111111111111111'))) AS numbers FROM documents WHERE regexp_matches(text, '[0-9]{16}'))
SELECT doc_id, array_to_string(numbers, ',') AS numbers FROM n WHERE len(numbers) > 0""")
def _(spark, d):
    """The tables hold no account numbers; card numbers stand for them."""
    found = files.account_numbers(tables.table(spark, d, "documents").select("doc_id", "text"), "text", ["4111111111111111"], "[0-9]{16}")
    return found.select("doc_id", F.array_join(F.array_sort("numbers"), ",").alias("numbers"))
