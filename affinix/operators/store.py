"""An incremental store on files: upserts, interning, queues and cursors as plans over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both; of equal keys the one with the highest order, the new one on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def inserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old, and the first new row of each key that old lacks."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = new.join(old.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(fresh)


def updated(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with the given columns taken from new where its key is there, null included; keys that old lacks are added."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_has"))
    rest = [c for c in old.columns if c not in keys]
    out = [F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rest]
    return old.join(n, keys, "full").select(*keys, *out)


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with every column taken from new where new has a value, and kept where it has none; keys that old lacks are added.

    Columns that only one side has stay.  Where new has a key more than once, each column has its last
    non-null value by order; without order the highest.
    """
    fields = [c for c in new.columns if c not in keys and c != order]
    picked = [(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)).alias(f"_{c}") for c in fields]
    n = new.groupBy(*keys).agg(*picked) if picked else new.select(*keys).distinct()
    kept = [c for c in old.columns if c not in keys]
    out = [F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in kept] + [F.col(f"_{c}").alias(c) for c in fields if c not in kept]
    return old.join(n, keys, "full").select(*keys, *out)


def enqueued(queue: DataFrame, users: DataFrame, depth: int) -> DataFrame:
    """queue(user_id, depth, seq) with the users(user_id) that it lacks, at a depth, behind all others; users that are in it stay as they are.

    New ones are numbered in ranges of a hash; null users are passed over.
    """
    numbered = interned(queue.select("user_id", F.col("seq").alias("id")), users.where("user_id is not null").select("user_id"), ["user_id"])
    fresh = numbered.join(queue.select("user_id"), "user_id", "left_anti").select("user_id", F.lit(depth).cast("int").alias("depth"), F.col("id").alias("seq"))
    return queue.select("user_id", F.col("depth").cast("int").alias("depth"), "seq").unionByName(fresh)


def queue_depths(queue: DataFrame, done: DataFrame) -> DataFrame:
    """(depth, n_users, n_pending): of each depth the users queued, and those that done(user_id, complete) doesn't say are complete."""
    complete = done.where("complete = 1").select("user_id").distinct().withColumn("_done", F.lit(1))
    return queue.join(complete, "user_id", "left").groupBy("depth").agg(F.count("*").alias("n_users"), F.count(F.when(F.col("_done").isNull(), 1)).alias("n_pending"))


def interned(known: DataFrame, names: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """known(keys, id) with ids added for new names: above the highest, without gaps.

    New ids follow ranges of a hash of the first key, and within a range the keys' order; ranks are within those ranges, whose sizes are added up, so no task sorts all names.
    """
    fresh = names.select(*keys).distinct().join(known.select(*keys), keys, "left_anti").withColumn("_part", F.pmod(F.xxhash64(keys[0]), F.lit(256)))
    sizes = fresh.groupBy("_part").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = known.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    numbered = fresh.join(F.broadcast(sizes), "_part").crossJoin(F.broadcast(top)).withColumn(id_column, F.col("_top") + F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return known.select(*keys, id_column).unionByName(numbered.select(*keys, id_column))


def pending(queue: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The first n of queue(user_id, depth, seq) whose user isn't done, by depth and seq."""
    return queue.join(done.where("complete = 1").select("user_id"), "user_id", "left_anti").orderBy("depth", "seq").limit(n)


def unfetched(owned: DataFrame, fetched: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct owned items that aren't fetched, in order."""
    out = owned.select("item_id").distinct().join(fetched.select("item_id"), "item_id", "left_anti").orderBy("item_id")
    return out if n is None else out.limit(n)


def bootstrap_order(rows: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """Distinct keys in a hashed order, up to limit."""
    return rows.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(limit)


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of several tables."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_ITEM = """struct<name:string,type:string,required_age:string,is_free:boolean,controller_support:string,dlc:array<bigint>,short_description:string,detailed_description:string,about_the_game:string,supported_languages:string,
developers:array<string>,publishers:array<string>,platforms:struct<windows:boolean,mac:boolean,linux:boolean>,price_overview:struct<currency:string,initial:string,final:string,discount_percent:string>,metacritic:struct<score:string,url:string>,
categories:array<struct<id:bigint,description:string>>,genres:array<struct<id:string,description:string>>,recommendations:struct<total:string>,achievements:struct<total:string>,release_date:struct<coming_soon:boolean,date:string>,header_image:string,
content_descriptors:struct<ids:array<bigint>,notes:string>,website:string,support_info:struct<url:string>>"""
_VOTED = "struct<name:string,developer:string,publisher:string,score_rank:string,positive:string,negative:string,userscore:string,owners:string,average_forever:string,average_2weeks:string,median_forever:string,median_2weeks:string,price:string,initialprice:string,discount:string,ccu:string,languages:string,genre:string,tags:map<string,bigint>>"


def _filled(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def _list(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.array_join(x, ", "))


def _json(x: Column, n: Column) -> Column:
    return F.when(n > 0, F.to_json(x))


def parsed_item(json: Column) -> Column:
    """The fields of an item's JSON description, all of them; what can't be read is null, flags are 0 or 1."""
    v = F.from_json(json, _ITEM)
    whole = lambda x: x.try_cast("bigint")
    flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    price, score, day, seen = v["price_overview"], v["metacritic"], v["release_date"], v["platforms"]
    fields = {"name": v["name"], "type": v["type"], "required_age": whole(v["required_age"]), "is_free": flag(v["is_free"]), "controller_support": v["controller_support"], "dlc_json": _json(v["dlc"], F.size(v["dlc"]))}
    fields |= {k: _filled(v[k]) for k in ("short_description", "detailed_description", "about_the_game")}
    fields |= {"languages": _filled(v["supported_languages"]), "developers": _list(v["developers"]), "publishers": _list(v["publishers"]), "win": flag(seen["windows"]), "mac": flag(seen["mac"]), "linux": flag(seen["linux"])}
    fields |= {"price_final": whole(price["final"]), "price_initial": whole(price["initial"]), "price_discount": whole(price["discount_percent"]), "price_currency": price["currency"], "metacritic": whole(score["score"]), "metacritic_url": score["url"]}
    fields |= {"categories_json": _json(v["categories"], F.size(v["categories"])), "genres_json": _json(v["genres"], F.size(v["genres"])), "recommendations_total": whole(v["recommendations"]["total"]), "achievements_total": whole(v["achievements"]["total"])}
    fields |= {"release_date": day["date"], "coming_soon": flag(day["coming_soon"]), "header_image": v["header_image"], "content_descriptors_json": F.to_json(v["content_descriptors"]), "website": v["website"], "support_url": _filled(v["support_info"]["url"])}
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def parsed_votes(json: Column) -> Column:
    """The fields of an item's vote and ownership document; numbers that can't be read are null, tags stay JSON."""
    v = F.from_json(json, _VOTED)
    numbers = ("positive", "negative", "userscore", "average_forever", "average_2weeks", "median_forever", "median_2weeks", "price", "initialprice", "discount", "ccu")
    texts = ("name", "developer", "publisher", "owners", "languages", "genre")
    return F.struct(*[v[k].alias(k) for k in texts], _filled(v["score_rank"]).alias("score_rank"), *[v[k].try_cast("bigint").alias(k) for k in numbers], _json(v["tags"], F.size(v["tags"])).alias("tags_json"))


def today_utc() -> Column:
    """The day, as text, in UTC whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")


def now_iso() -> Column:
    """The moment, as text, in UTC to the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
