"""Best-fit packing of documents into sequences of a fixed length.

Texts are encoded where they are read, and cut into pieces of the capacity, of which only
the first may be shorter; the pieces are written, with their ids.  Whole ones are
sequences of their own.  The others, one a document at most, are dealt into shards by a hash of their key, and every shard
packs its own: best fit by decreasing length, then local search between underfull bins.
One bin of a shard is at most half full; those of all shards are packed again, until there is one shard.
Only lengths travel; ids are fetched by sequences() alone.

Local search takes the emptiest bin and moves its pieces to fuller ones: a piece as it
is, or against a shorter one, or against two that are shorter together, or two against one.  Each
step fills a fuller bin further, so the sum of squared fills rises; it ends with a bin emptied or with none that
helps.  A bin's pieces count by length: two of one length can't be told apart.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import shared_folder, written
from affinix.llm.token_output import shared_encoder

#: Tokens of a sequence, and pieces of a shard.
CAPACITY = 2048
SHARD = 1 << 16
#: Bits of a key behind the number of the partition that made it.
KEY_BITS = 33
#: A sequence's number: a level of shards, from 1, above these bits, the shard above those, then the bin.  A whole piece has its key.
LEVEL_BITS, SHARD_BITS = 57, 24


def write_pieces(docs: DataFrame, folder: str, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """(key, doc_id, piece, start, length, width, ids, ids_crc32), written: the pieces of each text's ids and the end id behind them.

    A null or empty text is the end id alone.  Texts of any length are encoded whole; a
    null doc_id stays null, and rows that repeat are pieces as often as they come: key tells them apart.
    ids: little-endian, unsigned, of width bytes: 2 where the vocabulary allows it, else 4; ids_crc32 is the
    unsigned checksum of the same ids in 4 bytes.  Other columns, whatever their names, are not looked at.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << KEY_BITS
        encoder = shared_encoder(tokenizer_path, special_as_text)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, made in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = made + end
                    n = len(ids) // 4
                    short = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids
                    a = 0
                    for k, b in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        rows.append((key, doc_id, k, a, b - a, width, short[width * a : width * b], zlib.crc32(ids[4 * a : 4 * b])))
                        a, key = b, key + 1
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "doc_id", "piece", "start", "length", "width", "ids", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(encode, "key long, doc_id long, piece int, start long, length long, width int, ids binary, ids_crc32 long"), folder, compression="zstd")


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below: pieces that can't share one, and what does not fit beside them."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    above, mass = np.concatenate((np.cumsum(counts[::-1])[::-1], [0])), np.concatenate((np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1], [0]))
    half = capacity // 2 + 1  # from here on two don't fit together
    best = -(-int(mass[0]) // capacity)
    for low in range(1, half):
        top = capacity - low + 1  # pieces from here on have no room for one of low or more
        alone, paired = int(above[top]), int(above[half] - above[top])
        room = paired * capacity - int(mass[half] - mass[top])
        best = max(best, alone + paired + max(0, -(-(int(mass[low] - mass[half]) - room) // capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[Counter]:
    """Bins of lengths, longest first, each into the fullest bin that it fits in."""
    bins: list[Counter] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f is set while a bin has f free
    for n in sorted(lengths, reverse=True):
        fits = some >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                some &= ~(1 << f)
        else:
            b, f = len(bins), capacity
            bins.append(Counter())
        bins[b][n] += 1
        free[f - n].append(b)
        some |= 1 << (f - n)
    return bins


class _Offers:
    """What bins take in: for each sum of at most two of their lengths, those that would give it up for a longer one, roomiest first."""

    def __init__(self, bins: list[Counter], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.free = [capacity - sum(n * c for n, c in b.items()) for b in bins]
        self.age = [0] * len(bins)
        self.heaps: dict[tuple[int, int], list] = defaultdict(list)
        self.room = np.full((3, capacity + 1), -1, np.int64)  # by how many lengths are given up, and their sum: the most room
        for b in range(len(bins)):
            self.offer(b)

    def offer(self, b: int) -> None:
        free = self.free[b]
        if free > 0:
            for k, total, given in subsets(self.bins[b]):
                heapq.heappush(self.heaps[k, total], (-free, b, self.age[b], given))
                if free > self.room[k, total]:
                    self.room[k, total] = free

    def withdraw(self, b: int) -> None:
        self.age[b] += 1

    def top(self, k: int, total: int) -> tuple[int, int, tuple[int, ...]] | None:
        """(room, bin, what it gives up) of the roomiest bin; the room table is set right on the way."""
        heap = self.heaps[k, total]
        while heap and heap[0][2] != self.age[heap[0][1]]:
            heapq.heappop(heap)
        self.room[k, total] = -heap[0][0] if heap else -1
        return (-heap[0][0], heap[0][1], heap[0][3]) if heap else None


def subsets(bin_: Counter) -> list[tuple[int, int, tuple[int, ...]]]:
    """(how many, sum, lengths) of none, one and two lengths of a bin."""
    sizes = sorted(bin_)
    out: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]
    for i, n in enumerate(sizes):
        out.append((1, n, (n,)))
        if bin_[n] > 1:
            out.append((2, 2 * n, (n, n)))
        out += [(2, n + m, (n, m)) for m in sizes[i + 1 :]]
    return out


#: How many lengths a bin gives away for how many: one or two as they are, one for one, one for two, two for one.
EXCHANGES = ((1, 0), (2, 0), (1, 1), (1, 2), (2, 1))


def _step(offers: _Offers, a: int) -> bool:
    """Makes the exchange that moves most from bin a to one that is fuller, or then will be, and says whether there is one."""
    best: tuple | None = None
    for k, total, given in subsets(offers.bins[a]):
        for more, less in EXCHANGES:
            if more != k:
                continue
            # Moved: total less the sum s that another bin gives up, which needs the room; most first.
            for less_sum in np.flatnonzero(offers.room[less, :total] >= total - np.arange(total)).tolist():
                moved = total - less_sum
                if best and moved <= best[0]:
                    break
                found = offers.top(less, less_sum)
                if found and found[0] >= moved and moved > found[0] - offers.free[a]:
                    best = (moved, given, found[1], found[2])
                    break
    if best is None:
        return False
    moved, given, b, taken = best
    offers.withdraw(b)
    for bin_, gone, come in ((offers.bins[a], given, taken), (offers.bins[b], taken, given)):
        bin_.subtract(gone)
        bin_.update(come)
        for n in gone:
            if not bin_[n]:
                del bin_[n]
    offers.free[a] += moved
    offers.free[b] -= moved
    offers.offer(b)
    return True


def improved(bins: list[Counter], capacity: int, least: int) -> list[Counter]:
    """Fewer bins by exchanges between underfull ones, or as many, of other fills; ends at least bins or where no bin can be emptied."""
    while len(bins) > least:
        offers, gone = _Offers(bins, capacity), 0
        for a in sorted((b for b in range(len(bins)) if offers.free[b]), key=lambda b: (-offers.free[b], b)):
            if len(bins) - gone <= least:
                break
            offers.withdraw(a)
            while bins[a] and _step(offers, a):
                pass
            if bins[a]:
                offers.offer(a)
            else:
                gone += 1
        bins = [b for b in bins if b]
        # Of two that are half full the emptier goes first in the next round, and can be emptied.
        if not gone and sum(2 * sum(n * c for n, c in b.items()) <= capacity for b in bins) < 2:
            break
    return bins


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[Counter]:
    """Bins of the lengths, as few as best fit and local search find."""
    return improved(best_fit(lengths, capacity), capacity, least_bins(np.asarray(lengths, np.int64), capacity))


def _packed_shard(pdf: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    """(key, length, sequence_id, offset, fill) of a shard's pieces; of one length they are dealt in the order of their keys."""
    pdf = pdf.sort_values("key", kind="stable")
    keys: dict[int, list[int]] = {n: g.tolist()[::-1] for n, g in pdf.groupby("length")["key"]}
    rows = []
    base = (level << LEVEL_BITS) + (int(pdf["shard"].iloc[0]) << LEVEL_BITS - SHARD_BITS)
    for k, b in enumerate(pack(pdf["length"].tolist(), capacity)):
        offset, fill = 0, sum(n * c for n, c in b.items())
        for n in sorted(b.elements(), reverse=True):
            rows.append((keys[n].pop(), n, base + k, offset, fill))
            offset += n
    return pd.DataFrame(rows, columns=["key", "length", "sequence_id", "offset", "fill"])


def _shard_packer(capacity: int, level: int):
    return lambda pdf: _packed_shard(pdf, capacity, level)


def placed_pieces(pieces: DataFrame, folder: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(key, sequence_id, offset), written, for pieces(key, length); as few sequences as best fit with local search finds.

    Pieces of equal length go by key.  An empty table gives an empty one.
    """
    out = [pieces.where(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.where(F.col("length") < capacity).select("key", "length")
    level = 1
    while True:
        n = left.count()
        shards = -(-n // shard)
        if not n:
            break
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)).cast("int")).repartition(shards, "shard")
        made = written(dealt.groupBy("shard").applyInPandas(_shard_packer(capacity, level), "key long, length long, sequence_id long, offset long, fill long"), f"{folder}/level-{level}")
        again = F.lit(shards > 1) & (2 * F.col("fill") <= capacity)
        out.append(made.where(~again).select("key", "sequence_id", "offset"))
        left, level = made.where(again).select("key", "length"), level + 1
    placed = out[0]
    for part in out[1:]:
        placed = placed.unionByName(part)
    return placed


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids, doc_ids, starts): each sequence's ids put together, and what documents' pieces lie in it where."""
    joined = pieces.join(placed, "key").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))  # a sequence is at most its capacity
    return joined.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_ids"), F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, folder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(pieces, placed) of docs(doc_id, text): what write_pieces and placed_pieces return."""
    folder = folder or shared_folder(docs.sparkSession)
    pieces = write_pieces(docs, f"{folder}/pieces", tokenizer_path, capacity, **options)
    return pieces, placed_pieces(pieces, folder, capacity)


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces, placed = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.drop("ids", "width").join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
