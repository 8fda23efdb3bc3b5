"""Secret scans: fixed shapes by pattern, unknown shapes by sliding-window Shannon entropy.

Base kinds are found by pattern: ``assign``, ``access`` and ``hex``.  The
entropy scan adds kind ``entropy``.  Every character class looks at the runs of its own
alphabet, whatever stands around them: a prefix with a separator behind it doesn't hide a key.  In a run a window
moves along, the counts of its characters are kept up to date as one enters and one leaves, and so
each window's entropy is one addition and one subtraction.  A run whose highest
window reaches its class's threshold is a candidate, unless an allow-list pattern
matches all of it.  Candidates that touch or overlap are one span; those that a base span covers are none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: The patterns of the base kinds, in the order that breaks ties, with the least length of the group that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # leftmost and greedy: exactly the runs of 16 characters or more
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
KINDS = ("assign", "access", "hex", "entropy")

#: Per class: the runs of its alphabet, the window, and the bits a window must reach.  Runs of letters alone must change case often.
CLASSES = (
    ("hex", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"), 32, 3.1),
    ("alnum", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.55),
    ("base64", re.compile(r"[A-Za-z0-9+/]{30,}={0,2}"), 30, 4.1),
    ("url64", re.compile(r"[A-Za-z0-9_-]{30,}={0,2}"), 30, 4.1),
)
#: Runs that look random but are no secrets; a pattern must match a whole run.
ALLOW = (
    re.compile(r"[0-9]+|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # plain numbers, UUIDs
    re.compile(r"(EXAMPLE|example|EXAMPLEKEY|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefgh|ABCDEFGH|0123456789|1234567890|123456789|x+|X+|[-_/+=])+"),  # placeholders
    re.compile(r"[-_=+/]+|[0-9]+([-/_][0-9]+)+"),  # rules, dates, ranges
)
#: The words of a name in any case, and how long they are on average where a run is such a name with few digits.
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORD_LENGTH, FEW_DIGITS = 3.0, 4
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, spans string, base_sha256 string"
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 256)]


def highest_entropy(run: str, window: int) -> float:
    """The highest Shannon entropy, in bits a character, of any window of the run (the run itself where it is shorter)."""
    w = min(window, len(run))
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log2 n over the window's characters
    best = math.inf
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= w:
            n = counts[run[i - w]]
            total += _TERM[n - 1] - _TERM[n]
            counts[run[i - w]] = n - 1
        if i >= w - 1 and total < best:
            best = total
    return math.log2(w) - best / w if w else 0.0


def _plausible(run: str) -> bool:
    """Whether a run's make-up can be a key's: letters and digits, or letters of both cases, but not words with a short number."""
    letters, digits = sum(map(str.isalpha, run)), sum(map(str.isdigit, run))
    if letters < 2 or run.islower() and not digits or run.isupper() and not digits:
        return False
    return digits > FEW_DIGITS or letters < WORD_LENGTH * len(WORD.findall(run))


def entropy_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW) -> Iterator[tuple[int, int]]:
    """Runs of any class with a window of high entropy, those that touch or overlap joined."""
    found = []
    for _, pattern, window, bits in CLASSES:
        for m in pattern.finditer(text):
            run = m.group()
            if _plausible(run) and not any(p.fullmatch(run) for p in allow) and highest_entropy(run, window) >= bits:
                found.append(m.span())
    joined: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    yield from joined


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in code points, by start and then by kind."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    # A base span covers a run if, of those that begin no later, one ends no earlier.
    base = sorted((s, e) for _, s, e in found)
    starts, far = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for s, e in entropy_spans(text):
        before = bisect_right(starts, s)
        if not before or far[before - 1] < e:
            found.append(("entropy", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): counts of each kind, all spans, and the digest of the base spans.

    One pass without a shuffle.  Null and empty texts have no spans (empty
    string; the digest is that of the empty string); texts of any length are read whole, in
    time in proportion to it.  Spans that begin together come in the order of KINDS.  Repeated rows give
    repeated results, an empty table none; other columns, whatever their names, are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [scan(t or "") for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(_joined([s for s in r if s[0] != "entropy"]).encode()).hexdigest() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([_joined(r) for r in rows], pa.string()), pa.array(digest, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of every kind replaced by mask, overlapping ones by one; all columns stay.

    Null stays null, empty stays empty, repeated rows are treated alike; texts of any length are read whole, an empty table stays empty.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                end, parts = 0, []
                for _, s, e in scan(t or ""):
                    if s >= end:
                        parts += [t[end:s], mask]
                    end = max(end, e)
                out.append(None if t is None else "".join(parts) + t[end:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
