"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is target weight * size of the mix / its rows.
Each row draws its count by inverting the Poisson distribution of that mean at a
uniform number hashed from seed and doc_id, is exploded by that count, and the
copies are put in a random order over the whole output.  A mean above MAX_RATE is
drawn as a sum of Poisson counts of equal smaller means, each with its own uniform.  Only one row for each
source is aggregated and joined back, so a hot source moves no data of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import free_name

#: Above this mean the count is a sum of several draws; up to here exp(-mean) is a normal double, so one draw is exact.
MAX_RATE = 700.0
#: Copies that one array holds.
RUN = 1 << 16
#: Bytes of the sources' distributions above which they are no longer broadcast.
MAX_BROADCAST = 32 << 20
SEED = 20240229


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None) -> DataFrame:
    """(source, n, rate): rate = weight / sum of weights * size / n for each source that has rows.

    weights: by source, null included; None: all sources alike.  Sources that
    weights doesn't name get 0.  size: expected rows of the mix; None: as many as docs.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, weight double")
        n = n.join(given, n["source"].eqNullSafe(given["given"]), "left").drop("given").fillna({"weight": 0.0})
    total = n.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    wanted = F.col("all_n").cast("double") if size is None else F.lit(float(size))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * wanted / F.col("n")).otherwise(0.0)
    return n.join(F.broadcast(total)).select("source", "n", rate.alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Values of the distribution function at 0, 1, 2, ... up to where it can't be told from 1 in 52 bits."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("steps"))
    run = F.aggregate(F.sequence(F.lit(1), top), start, lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["steps"], F.array(F.element_at(s["steps"], -1) + s["p"] * rate / k)).alias("steps")))
    return run["steps"]


NAMES = ("copy", "rate", "mix_key")


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None, seed: int = SEED, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with each row repeated by its drawn count; columns copy (0, 1, ...), rate and mix_key are added, in no order.

    Null is a source of its own; null and empty texts, and texts of any length, are rows like
    others.  Rows with the same doc_id draw the same count, equal rows too.
    An empty table gives an empty mix; a source with weight 0 gives none of its rows.  names are those of
    the three added columns; existing columns of these names are replaced, all others stay.
    """
    copy, rate, mix_key = names
    base = docs.drop(*names)
    own, draws, steps, count, run = (free_name(docs, x) for x in ("_source", "_draws", "_steps", "_count", "_run"))
    n_draws = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    per_source = rates(base, weights, size).select(F.col("source").alias(own), F.col("rate").alias(rate), n_draws.alias(draws), poisson_steps(F.col("rate") / n_draws).alias(steps))
    size_of = F.coalesce(F.octet_length(own), F.lit(0)) + 8 * F.size(steps) + 64
    few = (per_source.agg(F.sum(size_of.cast("long"))).first()[0] or 0) <= MAX_BROADCAST
    joined = base.join(F.broadcast(per_source) if few else per_source, base["source"].eqNullSafe(per_source[own]))

    def drawn(*part: Column) -> Column:
        u = uniform(seed, F.lit("count"), F.col("doc_id"), *part)
        return F.size(F.filter(steps, lambda s: s <= u))

    more = F.when(F.col(draws) > 1, F.aggregate(F.sequence(F.lit(1), F.col(draws) - 1), F.lit(0), lambda n, k: n + drawn(k))).otherwise(0)
    counted = joined.withColumn(count, drawn() + more)
    runs = counted.where(F.col(count) > 0).withColumn(run, F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / RUN).cast("int"))))
    copies = runs.withColumn(copy, F.explode(F.sequence(F.col(run) * RUN, F.least(F.col(run) * RUN + (RUN - 1), F.col(count) - 1))))
    return copies.withColumn(mix_key, uniform(seed, F.lit("order"), F.col("doc_id"), F.col(copy))).drop(own, draws, steps, count, run)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float | None = None, seed: int = SEED, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """replicated() in the mix's global random order.

    mix_key is uniform, so equal ranges of it are equal parts: rows go to the part of
    their range at once, without a pass that samples keys, and are sorted there.
    """
    mix = replicated(docs, weights, size, seed, names)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mix.repartitionById(parts, F.floor(F.col(names[2]) * parts).cast("int")).sortWithinPartitions(names[2], "doc_id", names[0])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    mix = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), F.round("rate", 9).alias("rate"), F.round("mix_key", 12).alias("mix_key"), F.length("text").cast("long").alias("n_text"))


OP5_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (SELECT source, n, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / n::DOUBLE AS rate FROM n
), steps(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), u AS (
  SELECT doc_id, text, source, ('0x' || substr(md5('20240229|count|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT doc_id, any_value(text) AS text, u.source AS source, any_value(rate) AS rate, count(*) AS m FROM u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source AND s.c <= u.u GROUP BY doc_id, u.source
), copies AS (SELECT doc_id, text, source, rate, unnest(range(m)) AS copy FROM counted)
SELECT doc_id, source, copy::BIGINT AS copy, round(rate, 9) AS rate,
  round(('0x' || substr(md5('20240229|order|' || doc_id || '|' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0, 12) AS mix_key, length(text)::BIGINT AS n_text
FROM copies
"""
