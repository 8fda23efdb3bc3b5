"""Language identification in steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigram frequencies of the whole text.  Families are
learned too: a language joins the one whose mean frequencies are nearest; a family
of more than FAMILY languages is divided again in the same way, so the model is a tree
and grows in proportion to the number of languages.  A family is told by
one-versus-rest linear SVMs, a language within a last family by the votes of its
one-versus-one SVMs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinix.llm._features import frequencies
from affinix.llm._shared import chunks, hashed_sample

SLOTS = 4096
#: Bounds of the training sample: documents of each language, and of all together (but LEAST a language at least).
SAMPLE_PER_LANGUAGE = 500
SAMPLE = 6000
LEAST = 12
#: Languages that are told apart by one-versus-one SVMs.
FAMILY = 8
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
_SCALE = 30  # frequencies are small; the regularisation is set for features near 1


@dataclass
class Node:
    """A family: children told by one-versus-rest, or languages told by one-versus-one (pairs; a positive margin votes for the first)."""

    languages: list[int]
    children: list[Node] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None  # slots x SVMs
    bias: np.ndarray | None = None


@dataclass
class LanguageModel:
    languages: list[str]
    root: Node | None
    slots: int = SLOTS

    @property
    def families(self) -> list[list[int]]:
        """The languages of the last families."""

        def last(node: Node) -> list[list[int]]:
            return [g for c in node.children for g in last(c)] if node.children else [node.languages]

        return last(self.root) if self.root else []

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [p for g in self.families for p in itertools.combinations(g, 2)]


def linear_svms(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 250, tolerance: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x SVMs) and biases of linear SVMs (squared hinge) over the same rows, by accelerated gradient steps.

    y: rows x SVMs of -1 or 1; each SVM's classes are weighted to equal mass.  It ends when
    no gradient is above tolerance of its first size.
    """
    used = np.flatnonzero(x.any(0))
    z = np.hstack([x[:, used], np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    good = np.maximum(1, (y > 0).sum(0))
    cost = (c * len(y) / np.where(y > 0, good, np.maximum(1, len(y) - good))).astype(x.dtype)
    # The largest curvature of each, by a few power iterations.
    v = np.ones((z.shape[1], y.shape[1]), x.dtype)
    for _ in range(12):
        v /= np.linalg.norm(v, axis=0)
        v = v + z.T @ (cost * (z @ v))
    pace = 1 / (1.1 * np.linalg.norm(v, axis=0))
    w = ahead = np.zeros_like(v)
    t, first = 1.0, None
    for _ in range(steps):
        gradient = ahead - z.T @ (cost * y * np.maximum(1 - y * (z @ ahead), 0))
        size = np.linalg.norm(gradient, axis=0)
        first = size if first is None else first
        if (size <= tolerance * first).all():
            break
        new = ahead - pace * gradient
        if ((new - w) * gradient).sum() > 0:  # it went past: start again from here
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    full = np.zeros((x.shape[1], y.shape[1]), np.float32)
    full[used] = w[:-1]
    return full, w[-1].astype(np.float32)


def _nearest(means: np.ndarray) -> list[list[int]]:
    """Rows that are joined, over any number of steps, by links from a row to its nearest by cosine."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    cosine = unit @ unit.T - 3 * np.eye(len(means))
    label = list(range(len(means)))
    for i in range(len(means) if len(means) > 1 else 0):
        old, new = label[i], label[int(cosine[i].argmax())]
        label = [new if x == old else x for x in label]
    return [[i for i, x in enumerate(label) if x == k] for k in dict.fromkeys(label)]


def _groups(means: np.ndarray) -> list[list[int]]:
    """Families of rows: joined to their nearest, and these to their nearest, until there are at most FAMILY."""
    groups = _nearest(means)
    while len(groups) > FAMILY:
        groups = [[i for k in g for i in groups[k]] for g in _nearest(np.array([means[g].mean(0) for g in groups]))]
    return groups


def _halves(means: np.ndarray) -> list[list[int]]:
    """Rows divided in two at the middle of the direction in which they differ most."""
    place = np.linalg.svd(means - means.mean(0), full_matrices=False)[0][:, 0]
    order = np.argsort(place, kind="stable").tolist()
    return [order[: len(order) // 2], order[len(order) // 2 :]]


def _grown(languages: list[int], means: np.ndarray, x: np.ndarray, y: np.ndarray, top: bool = True) -> Node:
    """The tree over some languages, learned from their rows."""
    node = Node(languages)
    rows = np.isin(y, languages)
    x, y = x[rows], y[rows]
    groups = _groups(means[languages]) if top or len(languages) > FAMILY else [list(range(len(languages)))]
    if len(groups) == 1 and len(languages) > FAMILY:
        groups = _halves(means[languages])
    if len(groups) > 1:
        node.children = [_grown([languages[i] for i in g], means, x, y, top=False) for g in groups]
        node.weights, node.bias = linear_svms(x, np.array([np.where(np.isin(y, c.languages), 1, -1) for c in node.children]).T)
    elif len(languages) > 1:
        node.pairs = list(itertools.combinations(languages, 2))
        told = [linear_svms(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1)[:, None]) for a, b in node.pairs]
        node.weights, node.bias = np.hstack([w for w, _ in told]), np.concatenate([b for _, b in told])
    if node.weights is not None:
        node.weights = node.weights * np.float32(_SCALE)
    return node


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, slots: int = SLOTS, sample: int = SAMPLE) -> LanguageModel:
    """Learns from rows of docs(doc_id, text, lang) that aren't held out and have a lang and a text.

    The sample is the rows of each language with the lowest hash of doc_id and text,
    per_language at most and fewer where there are many languages; only its
    features reach the driver.  Every language that such rows name is learned.  Repeated
    rows are rows like others; very long texts are read whole; empty ones have no
    trigram.  From an empty table nothing is learned.
    """
    labelled = docs.where(f"lang is not null and text is not null and not ({HELD_OUT})").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    per_language = min(per_language, max(LEAST, sample // max(1, len(counts))))
    chosen = hashed_sample(labelled, "lang", F.xxhash64("doc_id", "text"), per_language, counts).select("lang", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), limit=1 << 18):
                x = frequencies(data, offsets, slots).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in chosen.mapInArrow(featured, "lang string, x binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows], np.float32).reshape(len(rows), slots) * _SCALE
    languages = sorted({lang for lang, _ in rows})
    place = {lang: k for k, lang in enumerate(languages)}
    y = np.array([place[lang] for lang, _ in rows], int)
    if not languages:
        return LanguageModel([], None, slots)
    means = np.array([x[y == k].mean(0) for k in range(len(languages))])
    return LanguageModel(languages, _grown(list(range(len(languages))), means, x, y), slots)


def _decide(node: Node, x: np.ndarray, rows: np.ndarray, lang: np.ndarray, score: np.ndarray) -> None:
    """Sets languages of rows, and multiplies their scores, from the features x of all rows."""
    if not len(rows) or node.weights is None:
        lang[rows] = node.languages[0]
        return
    margins = (x[rows] @ node.weights + node.bias).astype(np.float64)
    if node.children:
        best = margins.argmax(1)
        p = np.exp(margins - margins.max(1, keepdims=True))
        score[rows] *= (p / p.sum(1, keepdims=True))[np.arange(len(rows)), best]
        for k, child in enumerate(node.children):
            _decide(child, x, rows[best == k], lang, score)
        return
    sure = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
    place = {k: i for i, k in enumerate(node.languages)}
    votes, belief = np.zeros((2, len(rows), len(node.languages)))
    for k, (a, b) in enumerate(node.pairs):
        won = margins[:, k] >= 0
        votes[:, place[a]] += won
        votes[:, place[b]] += ~won
        belief[:, place[a]] += sure[:, k]
        belief[:, place[b]] += 1 - sure[:, k]
    best = (votes + belief / 1e3).argmax(1)
    lang[rows] = np.array(node.languages)[best]
    score[rows] *= belief[np.arange(len(rows)), best] / (len(node.languages) - 1)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, lang_pred, score (0 to 1).

    One pass, no shuffle; the weights (some SVMs a language) are broadcast.
    ``und`` with score 0 for null texts, texts without a letter,
    and where nothing could be learned.  A text without a trigram of letters
    still gets the language that the biases favour, with that score.  Texts of any length
    are read whole; repeated rows get equal results, an empty table none; other columns, whatever
    their names, are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in chunks(batch.column(1), limit=1 << 19):
                lang, score = np.zeros(j - i, int), np.ones(j - i)
                if m.root:
                    _decide(m.root, frequencies(data, offsets, m.slots), np.arange(j - i), lang, score)
                known = lettered[i:j] & (m.root is not None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[np.where(known, lang, len(names) - 1)], pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")
