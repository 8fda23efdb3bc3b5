"""Quality classifier by Bradley-Terry ranking of documents.

Labelled documents give preference pairs, every one of label 1 over every one of label 0.  Scores are
linear in a text's features and are learned by logistic loss on the pairs'
feature differences, which is the Bradley-Terry likelihood.  Pairs are not listed: what a pair adds depends on both
scores alone, so that counts and sums of features by narrow ranges of the score, made in Spark, give the sums over all pairs.
The cut is a score quantile of all labelled documents: the one that leaves as many below it as have
label 0.  Scores are then scaled to 0..1 with the cut at 0.7.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from affinix.llm._shared import chunks, shared_folder, span_hashes, word_bounds, written

#: Width of a range of scores whose documents meet the others' as one, and the widest range there is.
BIN = 1 / 16
FAR = 64.0
CUT = 0.7
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"

_KIND = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 3 digit, 4 white space, 5 punctuation of prose, 6 other ASCII signs, 7 other bytes
_KIND[0x21:0x7F] = 6
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 4
_KIND[list(b".,;:'\"()-?")] = 5
_KIND[0x80:] = 7
_SLOTS = 256


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x features, each within 0..1 or near it, of whole texts."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _KIND[data]
    shares = np.bincount(row * 8 + kinds, minlength=n * 8).reshape(n, 8) / sizes[:, None]
    signs = np.bincount((row * 256 + data)[kinds == 6], minlength=n * 256).reshape(n, 256)[:, list(b"!|#$%&*@<>{}[]=_/\\~^+")] / sizes[:, None]
    starts, ends, first = word_bounds(data, offsets)
    words = np.maximum(np.diff(first), 1)
    of = np.repeat(np.arange(n), np.diff(first))
    h = span_hashes(data, starts, ends)
    key = np.sort(of.astype(np.uint64) << np.uint64(52) | h >> np.uint64(12))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(52)).astype(np.int64), minlength=n)
    again = np.zeros(len(h), bool)  # the same word twice running
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    length = ends - starts
    tail = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    head = _KIND[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    shout = np.zeros(len(starts), bool)
    if len(starts):
        low = np.concatenate(([0], np.cumsum(kinds == 1)))
        high = np.concatenate(([0], np.cumsum(kinds == 2)))
        shout = (low[ends] - low[starts] == 0) & (high[ends] - high[starts] > 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(of, flag.astype(float), minlength=n) / words

    lines = np.bincount(row[data == 0x0A], minlength=n)
    parts = [shares, signs, share(tail == 6), share(head == 6), share(head == 2), share(shout), share(again), share(length == 1), share(length > 20), distinct / words / np.maximum(1, np.sqrt(words) / 12), np.minimum(1, np.bincount(of, length, minlength=n) / words / 12), np.minimum(1, np.log1p(words) / 10), np.minimum(1, lines / words), (np.diff(first) == 0).astype(float)]
    return np.column_stack(parts)


@dataclass
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + math.log(CUT / (1 - CUT)), -60, 60)))


#: Width of a row of features.
WIDTH = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def _sums(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], dict[object, np.ndarray]]) -> dict[object, np.ndarray]:
    """Over rows(quality, x), the sum of make(qualities, features) by its keys (small whole numbers); a task passes on its own sums alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, WIDTH)
                for key, value in make(batch.column(0).to_numpy(), x).items():
                    total[key] = total[key] + value if key in total else value
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.astype(float).tobytes() for v in total.values()], pa.binary())], ["key", "v"])

    out: dict[object, np.ndarray] = {}
    for r in rows.mapInArrow(run, "key long, v binary").collect():
        v = np.frombuffer(bytes(r.v))
        out[r.key] = out[r.key] + v if r.key in out else v
    return out


def bradley_terry(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights that maximise the likelihood of every row of label 1 over every one of label 0, by Newton's method; rows(quality, x)."""
    w = np.zeros(WIDTH)

    def placed(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = ((x - mean) / scale).clip(-8, 8)
        raw = (z @ w).clip(-FAR, FAR)
        return z, raw, np.floor(raw / BIN).astype(np.int64) * 2

    for _ in range(steps):

        def by_bin(q: np.ndarray, x: np.ndarray, w: np.ndarray = w) -> dict[object, np.ndarray]:
            z, raw, at = placed(x, w)
            keys, of = np.unique(at + q, return_inverse=True)
            table = np.column_stack((np.ones(len(q)), raw, z))
            order = np.argsort(of, kind="stable")
            sums = np.add.reduceat(table[order], np.searchsorted(of[order], np.arange(len(keys))), axis=0)
            return dict(zip(keys.tolist(), sums, strict=True))

        met = _sums(rows, by_bin)
        good, bad = ([k for k in sorted(met) if k % 2 == label] for label in (1, 0))
        a, b = np.array([met[k] for k in good]), np.array([met[k] for k in bad])
        pairs = a[:, 0].sum() * b[:, 0].sum()
        ahead = (a[:, 1] / a[:, 0])[:, None] - (b[:, 1] / b[:, 0])[None, :]
        p = 1 / (1 + np.exp(np.clip(ahead, -40, 40)))  # chance that the worse one wins
        q = p * (1 - p)
        gradient = (a[:, 2:].T @ (p @ b[:, 0]) - b[:, 2:].T @ (p.T @ a[:, 0])) / pairs - ridge * w
        weight = dict(zip(good, q @ b[:, 0] / pairs, strict=True)) | dict(zip(bad, q.T @ a[:, 0] / pairs, strict=True))
        known, heavy = np.array(sorted(weight)), np.array([weight[k] for k in sorted(weight)])

        def squares(label: np.ndarray, x: np.ndarray, w: np.ndarray = w, known: np.ndarray = known, heavy: np.ndarray = heavy) -> dict[object, np.ndarray]:
            z, _, at = placed(x, w)
            return {0: ((z * heavy[np.minimum(np.searchsorted(known, at + label), len(known) - 1)][:, None]).T @ z).ravel()}

        cross = a[:, 2:].T @ q @ b[:, 2:] / pairs
        hessian = _sums(rows, squares)[0].reshape(WIDTH, WIDTH) - cross - cross.T + ridge * np.eye(WIDTH)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return np.round(w, 6)  # sums of other partitions differ in their last digits


def _at_place(raw: DataFrame, place: int) -> float:
    """The value of raw(s) at a place from 0 in ascending order: ranges that hold it are cut until few different values are left."""
    low, high = raw.agg(F.min("s"), F.max("s")).first()
    while True:
        inside = raw.where((F.col("s") >= low) & (F.col("s") <= high))
        step = (high - low) / 1024
        at = F.least(F.floor((F.col("s") - low) / step), F.lit(1023)) if step > 0 else F.lit(0)
        for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("low").collect():  # 1,024 at most
            if place < r.n:
                break
            place -= r.n
        if r.low == r.high:
            return r.low
        low, high = r.low, r.high


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Learns from all labels(doc_id, quality) that aren't held out, and their texts.

    Features are written once, and read again in every step; tasks pass on sums, the driver gets from each those of at most
    2 * FAR / BIN ranges of the score and label.  Rows with a null label or id are left out; of several labels for one id the lower counts,
    and of several rows of docs with one id the one whose features are lowest as bytes.  Null and empty texts count
    as empty.  Without labels of both kinds all documents get one score: kept if there are good ones or none at all.
    """
    usable = labels.where(f"quality in (0, 1) and doc_id is not null and not ({HELD_OUT})").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    texts = docs.where(f"doc_id is not null and not ({HELD_OUT})").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in features(data, offsets)], pa.binary())], ["doc_id", "x"])

    rows = texts.mapInArrow(featured, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).join(usable, "doc_id").select("quality", "x")
    rows = written(rows, f"{shared_folder(docs.sparkSession)}/features")
    sums = _sums(rows, lambda q, x: {label: np.concatenate(([(q == label).sum()], x[q == label].sum(0), (x[q == label] ** 2).sum(0))) for label in (0, 1)})
    bad, good = (int(sums[label][0]) if label in sums else 0 for label in (0, 1))
    if not good or not bad:
        return QualityModel(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), 0.0 if good or not bad else 1.0, 1.0)
    _, first, second = np.split((sums[0] + sums[1]) / (good + bad), (1, 1 + WIDTH))
    mean, scale = np.round(first, 9), np.round(np.maximum(np.sqrt(np.maximum(second - first**2, 0)), 1e-3), 9)
    model = QualityModel(bradley_terry(rows, mean, scale), mean, scale, 0.0, 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x))], ["s"])

    # The cut: the quantile at the share of label 0 among all labelled rows.
    raw = written(rows.mapInArrow(scored, "s double"), f"{shared_folder(docs.sparkSession)}/raw")
    model.cut = (_at_place(raw, bad - 1) + _at_place(raw, bad)) / 2
    return model


NAMES = ("quality_score", "quality_keep")


def score(docs: DataFrame, model: QualityModel, names: tuple[str, str] = NAMES) -> DataFrame:
    """docs with columns quality_score (0 to 1) and quality_keep (score >= 0.7) added; one pass, no shuffle.

    Null texts count as empty; an empty text gets the score of its (all but
    constant) features; texts may be of any length.  Repeated rows get equal scores; an
    empty table stays empty.  All columns stay; existing ones of the two names are replaced.
    """
    base = docs.drop(*names)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(at)):
                s = sent.value.score(features(data, offsets))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(s >= CUT)], [*part.schema.names, *names])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], BooleanType())]))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_keep").cast("int").alias("predicted"))
