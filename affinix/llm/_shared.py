"""What several operators share: the folder for written tables, and array views of text.

The array helpers work on one Arrow batch inside a task.  They look at the UTF-8
bytes of a column in place and never build a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinix.functions.scratch import new_folder

#: Bytes of text that the array helpers look at in one go; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Documents in a chunk; their number within it must fit the top 12 bits of a sort key.
CHUNK_DOCS = 4096

_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (see scratch.new_folder)."""
    return new_folder(spark, "affinix")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_sample(rows: DataFrame, key: str, order: Column, n: int, counts: dict) -> DataFrame:
    """Of each key's rows the n with the lowest hash (order, a 64-bit hash), or fewer by a rare chance.

    counts: each key's rows.  Before the rows of a key meet, those whose hash is
    above what n rows and six standard deviations need are left out, so that what meets doesn't grow with the table.
    """
    limit = F.lit(None).cast("double")
    spread = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, (n + 6 * n**0.5 + 20) / c))]) if counts else None
    if spread is not None:
        limit = F.element_at(spread, F.col(key))
    low = order.cast("double") < (2.0**64) * limit - 2.0**63
    place = free_name(rows, "place")
    top = Window.partitionBy(key).orderBy(order, *[c for c in rows.columns if c != key])
    return rows.where(low | (limit >= 1)).withColumn(place, F.row_number().over(top)).where(F.col(place) <= n).drop(place)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage ends here, and lost executors take nothing with them."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for stretches of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_DOCS, n)
        part = data[offsets[i] : offsets[j]]
        yield i, j, (_LOWER[part] if lower else part), offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each row's first word (one more at the end)."""
    solid = ~_WHITE[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i in 0..n."""
    have = _powers.get(p)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (p, pow(p, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        have = (made[0], made[1])
        if size <= 4 * CHUNK_BYTES:
            _powers[p] = have
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int = _P1) -> np.ndarray:
    """64-bit hashes of values[start:end], by differences of one running polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(p, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_P2))


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int, p: int = _P2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one row, and for each row the index of its first (one more at the end).

    words: word hashes; first: index of each row's first word.  A row of fewer than k words has none.
    """
    n = np.diff(first)
    grams = np.maximum(n - k + 1, 0)
    row_first = np.concatenate(([0], np.cumsum(grams)))
    total = int(row_first[-1])
    if not total:
        return np.zeros(0, np.uint64), row_first
    starts = np.arange(total) + np.repeat(first[:-1] - row_first[:-1], grams)
    return span_hashes(words, starts, starts + k, p), row_first
