"""Removal of repeated passages by super-k-mers.

A window is 35 consecutive words.  Its minimiser is the lowest hash of its 8-word
grams, so equal windows have equal minimisers, and consecutive windows mostly
share one: they form a super-k-mer.  A super-k-mer ends where the hash changes,
not where the gram moves, so periodic text doesn't fall apart into windows.

1. Super-k-mers are listed as (minimiser, row, first window, windows), without
   their words, and minimisers are counted with partial aggregation.  A
   minimiser that comes in one place only can't be that of a repeated window.
2. Only super-k-mers whose minimiser comes again travel, each as one packed
   string of its words, to the minimiser's bucket.  A minimiser of more than HOT
   super-k-mers has several buckets, to which they are dealt by a hash of their place.
3. In a bucket equal strings are put together, and the windows of the distinct ones are
   sorted by two 64-bit hashes and counted; windows of equal hashes are compared byte by byte.
4. Minimisers with several buckets may repeat a window across them.  Each such bucket
   passes every distinct window on once, by a 128-bit digest, with its place if it
   came once there; the digests are summed up, and those places that are repeated
   elsewhere are looked up.
5. Ranges of words of repeated windows meet the texts again by row.

Rows are known by two 64-bit hashes of doc_id and text.  Everything grows in
proportion to the text; no step gathers more than one document's ranges or one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import CHUNK_BYTES, chunks, free_name, gram_hashes, shared_folder, span_hashes, word_bounds, written

WINDOW = 35
GRAM = 8
#: Super-k-mers of one minimiser that a bucket may hold, on average.
HOT = 8000
#: A minimiser with more than this share of all super-k-mers is looked up in a broadcast table, which so has at most 1 / SHARE rows.
SHARE = 1 / 2000
_P3 = 0xD6E8FEB86659FD93
_ROW = ("r1", "r2")


def super_kmers(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, minimiser hash, first window, windows, places of the minimiser) of every super-k-mer of the rows.

    Places count the leftmost grams that have the minimiser's hash, over the windows; equal windows have theirs in different places.
    """
    starts, ends, first = word_bounds(data, offsets)
    grams, gram_first = gram_hashes(span_hashes(data, starts, ends), first, gram)
    width = window - gram + 1
    per_row = np.maximum(np.diff(gram_first) - width + 1, 0)
    total = int(per_row.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[a] <= grams[b], a, b)

    low, reach = np.arange(len(grams)), 1
    while 2 * reach <= width:
        low, reach = lower(low[:-reach], low[reach:]), 2 * reach
    if reach < width:
        low = lower(low[: len(low) - (width - reach)], low[width - reach :])
    row = np.repeat(np.arange(len(per_row)), per_row)
    within = np.arange(total) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    place = low[gram_first[row] + within]
    mz = grams[place]
    new, moved = np.ones(total, bool), np.ones(total, bool)
    new[1:] = (mz[1:] != mz[:-1]) | (row[1:] != row[:-1])
    moved[1:] = new[1:] | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    return row[at], mz[at].view(np.int64), within[at], np.diff(np.append(at, total)), np.add.reduceat(moved.astype(np.int64), at)


def _ranges(flagged: np.ndarray, row_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of flagged windows, counted from each row's first."""
    row = np.repeat(np.arange(len(row_first) - 1), np.diff(row_first))
    before = np.zeros(len(flagged), bool)
    before[1:] = flagged[:-1] & (row[1:] == row[:-1])
    after = np.zeros(len(flagged), bool)
    after[:-1] = flagged[1:] & (row[1:] == row[:-1])
    a, b = np.flatnonzero(flagged & ~before), np.flatnonzero(flagged & ~after)
    return row[a], a - row_first[row[a]], b - row_first[row[a]]


def _repeats(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of distinct packed strings: the number of an equal window that stands for it, and whether it comes more
    than once; also each string's first window, all bytes, and where windows start and end in them."""
    data = np.frombuffer(b"".join(packed), np.uint8)
    starts, ends, first = word_bounds(data, np.concatenate(([0], np.cumsum([len(p) for p in packed]))))
    a, row_first = gram_hashes(span_hashes(data, starts, ends), first, window)
    b, _ = gram_hashes(span_hashes(data, starts, ends, _P3), first, window, _P3)
    word = np.arange(len(a)) + np.repeat(first[:-1] - row_first[:-1], np.diff(row_first))
    begin, end = (starts[word], ends[word + window - 1]) if len(a) else (word, word)
    order = np.lexsort((b, a))
    same = np.zeros(len(a), bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    for k in np.flatnonzero(same):  # a window is compared with the one before it
        i, j = order[k - 1], order[k]
        same[k] = data[begin[i] : end[i]].tobytes() == data[begin[j] : end[j]].tobytes()
    stands = np.empty(len(a), np.int64)
    stands[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))] if len(a) else order
    again = np.zeros(len(a), bool)
    again[order[same]] = True
    again[order[:-1][same[1:]]] = True
    return stands, again, row_first, data, begin, end


class _Bucket:
    """Super-k-mers of one or more whole buckets: each distinct string once, with the places where it comes."""

    def __init__(self) -> None:
        self.places: dict[bytes, list[tuple[int, int, int]]] = {}
        self.size = 0

    def add(self, string: bytes, place: tuple[int, int, int]) -> None:
        known = self.places.setdefault(string, [])
        if not known:
            self.size += len(string)
        known.append(place)

    def found(self, window: int, shared: bool) -> pa.RecordBatch:
        """Ranges (kind 0: r1, r2, a, b) of repeated windows; if the minimiser has other buckets, also its distinct windows (kind 1:
        digest, n 2 or, with the window's r1, r2 and a, 1)."""
        strings, places = list(self.places), list(self.places.values())
        stands, again, row_first, data, begin, end = _repeats(strings, window)
        copied = np.repeat(np.array([len(p) > 1 for p in places]), np.diff(row_first))
        # A window is also repeated if one equal to it lies in a string that comes twice.
        twice = np.zeros(len(stands), bool)
        twice[stands[copied]] = True
        flagged = again | copied | twice[stands]
        of, s, e = _ranges(flagged, row_first)
        lists = [(*place[:2], place[2] + x, place[2] + y + window - 1) for k, x, y in zip(of.tolist(), s.tolist(), e.tolist(), strict=True) for place in places[k]]
        columns = [pa.array([x[k] for x in lists], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        n = len(lists)
        kind, digest, times = pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())
        if not shared:
            return pa.RecordBatch.from_arrays([kind, *columns, digest, times], _FOUND)
        once = np.flatnonzero(stands == np.arange(len(stands)))
        owner = np.repeat(np.arange(len(strings)), np.diff(row_first))[once]
        single = ~flagged[once]
        at = once - row_first[owner]
        digests = [hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=16).digest() for i in once]
        first = [places[k][0] for k in owner.tolist()]
        more = [
            pa.array(np.ones(len(once), np.int32)),
            *[pa.array([p[k] for p in first], pa.int64(), mask=~single) for k in (0, 1)],
            pa.array(np.array([p[2] for p in first], np.int64) + at, mask=~single).cast(pa.int32()),
            pa.nulls(len(once), pa.int32()),
            pa.array(digests, pa.binary()),
            pa.array(np.where(single, 1, 2).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip([kind, *columns, digest, times], more, strict=True)], _FOUND)


_FOUND = ["kind", *_ROW, "a", "b", "digest", "n"]
_FOUND_SCHEMA = "kind int, r1 long, r2 long, a int, b int, digest binary, n int"


def repeated_ranges(rows: DataFrame, folder: str, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(r1, r2, ranges): for each row of rows(r1, r2, text) that has any, the word ranges (first, last) of repeated windows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in chunks(batch.column(2)):
                row, mz, first, n, places = super_kmers(data, offsets, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(mz, pa.int64()), pa.array(r1[i:j][row], pa.int64()), pa.array(r2[i:j][row], pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(places, pa.int32())], ["mz", *_ROW, "first", "n", "places"])

    found = written(rows.select(*_ROW, "text").mapInArrow(listed, "mz long, r1 long, r2 long, first int, n int, places int"), f"{folder}/super-k-mers")
    parts = F.ceil(F.col("c") / hot).cast("int")
    counts = written(found.groupBy("mz").agg(F.count("*").alias("c"), F.sum("places").alias("places")).where("places > 1").select("mz", "c", parts.alias("parts")), f"{folder}/minimisers")
    total = found.count()
    # At most 1 / SHARE minimisers are above their share; all others are joined by a shuffle, with no key above that share.
    often = F.broadcast(counts.where(f"c > {total * SHARE}").select("mz", F.col("parts").alias("often")))
    seldom = counts.where(f"c <= {total * SHARE}").select("mz", "parts")
    marked = found.drop("places").join(often, "mz", "left")
    chosen = marked.where("often is not null").select("mz", *_ROW, "first", "n", F.col("often").alias("parts")).unionByName(marked.where("often is null").drop("often").join(seldom, "mz"))
    part = F.expr("pmod(xxhash64(r1, first), parts)").cast("int")
    # A set: repeated rows list their super-k-mers once.
    kmers = written(chosen.groupBy(*_ROW).agg(F.collect_set(F.struct("mz", part.alias("part"), (F.col("parts") > 1).alias("shared"), "first", "n")).alias("kmers")), f"{folder}/chosen")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made = []
                for r in batch.slice(at, 64).to_pylist():
                    words = r["text"].encode().split()
                    made += [(k["mz"], k["part"], k["shared"], r["r1"], r["r2"], k["first"], b" ".join(words[k["first"] : k["first"] + k["n"] + window - 1])) for k in r["kmers"]]
                columns = zip(*made, strict=True) if made else [()] * 7
                types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["mz", "part", "shared", *_ROW, "first", "packed"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; small whole buckets are taken together, up to about a chunk of text."""
        held, key, own = _Bucket(), None, False
        for batch in batches:
            for mz, part, shared, r1, r2, first, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mz, part) != key:
                    if held.places and (own or shared or held.size >= CHUNK_BYTES // 2):
                        yield held.found(window, own)
                        held = _Bucket()
                    key, own = (mz, part), shared
                held.add(string, (r1, r2, first))
        if held.places:
            yield held.found(window, own)

    strings = rows.join(kmers, [*_ROW]).select(*_ROW, "text", "kmers").mapInArrow(packed, "mz long, part int, shared boolean, r1 long, r2 long, first int, packed binary")
    seen = written(strings.repartition("mz", "part").sortWithinPartitions("mz", "part").mapInArrow(counted, _FOUND_SCHEMA), f"{folder}/windows")
    windows = seen.where("kind = 1").select("digest", "n", *_ROW, "a")
    across = windows.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")
    places = windows.where("n = 1").join(across, "digest").select(*_ROW, "a", (F.col("a") + (window - 1)).alias("b"))
    ranges = seen.where("kind = 0").select(*_ROW, "a", "b").unionByName(places)
    return written(ranges.groupBy(*_ROW).agg(F.collect_set(F.struct("a", "b")).alias("ranges")), f"{folder}/ranges")


def _cut(words: list[bytes], ranges: list[dict] | None) -> list[bytes]:
    """words without those in any range."""
    if not ranges:
        return words
    end, kept = 0, []
    for r in sorted(ranges, key=lambda r: r["a"]):
        kept += words[end : r["a"]] if r["a"] > end else []
        end = max(end, r["b"] + 1)
    return kept + words[end:]


def _rows(docs: DataFrame, r1: str, r2: str) -> DataFrame:
    """docs with two hashes of doc_id and text, together 128 bits; null and empty texts, which have no words, differ in nothing here."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumns({r1: F.xxhash64(doc_id, text), r2: F.xxhash64(text, doc_id, F.lit(29))})


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, folder: str | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space).

    A word goes if a window that covers it has a word sequence that starts
    anywhere else too, in the same text included; windows are judged on the
    input.  So of repeated passages no copy stays.  Null and empty texts have no
    words (digest of the empty string); texts under 35 words lose none; texts may
    be of any length.  Repeated rows repeat each other's windows.  An empty table
    gives an empty result.  Extra columns, whatever their names, are not looked at.
    """
    rows = _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), *_ROW)
    ranges = repeated_ranges(rows, folder or shared_folder(docs.sparkSession), window, gram, hot)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, removed, digest = [], [], []
                for text, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    kept = _cut(words, r)
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.join(ranges, [*_ROW], "left").select("doc_id", "text", "ranges").mapInArrow(digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with repeated passages cut from text; all columns stay, whatever their names.

    Kept words are joined by one space in texts that lose any; other texts, null
    and empty ones among them, stay as they are.  Repeated rows lose what they
    repeat.  An empty table stays empty.
    """
    names, schema = docs.columns, docs.schema
    r1, r2, cuts = (free_name(docs, x) for x in (*_ROW, "ranges"))
    rows = _rows(docs, r1, r2)
    ranges = repeated_ranges(rows.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.col("text").cast("string").alias("text")), shared_folder(docs.sparkSession), window, gram, hot)
    joined = rows.join(ranges.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("ranges").alias(cuts)), [r1, r2], "left").select(*names, cuts)
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(_cut(t.encode().split(), r)).decode() if t is not None and r else t for t, r in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(c).type) if c == at else batch.column(c) for c in range(len(names))], names)

    return joined.mapInArrow(cut, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
