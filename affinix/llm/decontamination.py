"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of 13 words (an item of fewer words is one window) are
the n-gram set.  Their hashes are broadcast as the hash table of a join, at most
MAX_BROADCAST of them at a time; a larger set takes as many passes over the texts.
A text is split into words once and each word is hashed once; the hashes of all its
windows are looked up where they are made, and only those that are found go on, with
their words.  These meet the windows themselves in an equi-join and are so verified
word by word.  So what is shuffled follows the hits, not the text, whatever the size of the benchmark.

Hit spans can be reported, cut from the texts, or make their documents go.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import free_name, shared_folder, written

N = 13
#: Windows whose hashes are broadcast at a time: 12 bytes each, about 60 MB as a table.
MAX_BROADCAST = 2_000_000
MARK = 0
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose letters are not yet in lower case.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashes(w: Column) -> Column:
    """The hash of each word."""
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(key, win, items): the distinct windows of benchmark(item_id, text), the hash of each, and the sorted ids, as strings, of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    cut = items.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n}))")).alias("win"))
    return cut.groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.xxhash64(_hashes(F.col("win"))).alias("key"), "win", "items")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, folder: str | None = None) -> DataFrame:
    """Per row of docs(doc_id, text), and by its doc_id: n_words and what was hit.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window),
    items (sorted item ids, as strings, with occurring windows), spans (sorted
    array of first and last word, merged where they touch or overlap) and contaminated (n_hit > 0
    and 20 * n_hit >= n_words).  Null and empty texts have no words and aren't
    contaminated; texts may be of any length.  Rows that repeat a doc_id, equal ones
    too, are judged one by one.  Items without words match nothing, and items with equal windows
    are all found by them; an empty table of either kind gives no hits.  Extra columns are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    wins = written(windows(benchmark, n), f"{folder}/windows")
    sizes = sorted((r.size for r in wins.select(F.size("win").alias("size")).distinct().collect()), reverse=True)  # n rows at most
    parts = max(1, -(-wins.count() // MAX_BROADCAST))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    if parts > 1:  # each pass must see the same rows
        rows = written(rows, f"{folder}/rows")
    hashed = rows.select("row", "doc_id", words(F.col("text")).alias("w")).select("row", "doc_id", "w", _hashes(F.col("w")).alias("h"))
    entry = "struct<first: int, size: int, key: bigint>"
    listed = [F.expr(f"if(size(h) >= {m}, transform(sequence(1, size(h) - {m - 1}), i -> named_struct('first', i - 1, 'size', {m}, 'key', xxhash64(slice(h, i, {m})))), cast(array() as array<{entry}>))") for m in sizes]
    # Before the windows stands a mark that is always found: so each text has a row in the first pass.
    mark = F.expr(f"array(named_struct('first', -1, 'size', 0, 'key', {MARK}L))")
    keyed = hashed.select("row", "doc_id", "w", F.concat(mark, *listed).alias("x"))
    known = wins.select("key", F.size("win").alias("known_size")).distinct()
    marked = known.union(spark.range(1).select(F.lit(MARK).cast("long"), F.lit(0)))
    passes = []
    for part in range(parts):
        table = known.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if part else marked.where((F.pmod(F.xxhash64("key"), F.lit(parts)) == 0) | (F.col("known_size") == 0))
        # Outer: for an inner one Spark would first filter by the array's size, and compute it there again from the text.
        found = keyed.select("row", "doc_id", "w", F.explode_outer("x").alias("x")).select("row", "doc_id", "w", "x.*").join(F.broadcast(table), "key").where("size = known_size")
        is_mark = F.col("size") == 0
        passes.append(found.select("row", F.when(is_mark, F.col("doc_id")).alias("doc_id"), F.when(is_mark, F.size("w").cast("long")).alias("n_words"), "key", "first", F.when(~is_mark, F.slice("w", F.col("first") + 1, F.col("size"))).alias("win")))
    kept = written(functools.reduce(DataFrame.unionByName, passes), f"{folder}/scan")

    hits = kept.where("win is not null").select("row", "key", "win", "first").join(wins, ["key", "win"]).select("row", "items", "first", (F.col("first") + F.size("win") - 1).alias("last"))
    merged = F.expr("""
        aggregate(array_sort(collect_set(struct(first, last))), cast(array() as array<struct<first: int, last: int>>),
            (out, x) -> if(size(out) > 0 and x.first <= element_at(out, -1).last + 1,
                concat(slice(out, 1, size(out) - 1), array(named_struct('first', element_at(out, -1).first, 'last', greatest(element_at(out, -1).last, x.last)))),
                concat(out, array(x))))""")
    by_row = hits.groupBy("row").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    n_hit = F.expr("coalesce(aggregate(spans, 0L, (n, x) -> n + x.last - x.first + 1), 0L)")
    joined = kept.where("win is null").select("row", "doc_id", "n_words").join(by_row, "row", "left").withColumn("n_hit", n_hit)
    return joined.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<first: int, last: int>>)")).alias("spans"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs without its contaminated documents; all columns stay.

    A doc_id with any contaminated row goes whole; rows with null doc_id stay, as do null and
    empty texts.  An empty table stays empty, and an empty benchmark leaves all.
    """
    bad_id = free_name(docs, "bad_id")
    bad = scan(docs, benchmark, n).where("contaminated").select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[bad_id], "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with every hit word cut from text, each with what stands between it and the word before; all columns stay.

    Texts without a hit, null and empty ones among them, stay as they are.  Equal
    texts are cut alike; rows that repeat a doc_id are cut one by one.
    """
    names = docs.columns
    key, spans, ws, gaps = (free_name(docs, x) for x in ("key", "spans", "ws", "gaps"))
    keyed = docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256))
    found = scan(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, n).where("n_hit > 0").select(F.col("doc_id").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    # Java's split drops nothing with limit -1: one more gap than words.
    cut = keyed.join(found, key, "left").select(*names, spans, F.when(F.col(spans).isNotNull(), F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0))).alias(ws), F.when(F.col(spans).isNotNull(), F.split("text", ANY_WORD, -1)).alias(gaps))
    hit = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size(ws) - 1), hit)
    text = F.concat(F.array_join(F.transform(stay, lambda i: F.concat(F.get(F.col(gaps), i), F.get(F.col(ws), i))), ""), F.element_at(gaps, -1))
    return cut.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(text)).select(*names)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, i, n FROM grams JOIN wins USING (n, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
