"""Periodic run detection on a grammar of the words.

A run is a maximal stretch of words with a smallest period q that it holds twice at
least.  Texts are handled some at a time inside a task, and none leaves its task:

1. Words that lie in no repeated 6-gram of their text are in no run, so what is
   compressed are the stretches between them.
2. Re-Pair, in rounds: every pair of neighbours that comes again, and that
   isn't less frequent than the pairs overlapping it, becomes a nonterminal.  The symbols
   that are left over are joined by a balanced tree.
3. For each nonterminal, once, the runs that cross the boundary between its two halves:
   for every period the longest common extensions on both sides of the boundary.
4. These runs are moved to all places where the nonterminal is derived.  The lowest
   node that holds a run finds it whole; parts that other nodes found lie in it and go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import _P1, _power, chunks, free_name, gram_hashes, mixed, span_hashes, word_bounds

#: Words of a run at least; with the period's double it makes any run hold a repeated GRAM-gram all over.
LEAST = 12
GRAM = 6
#: Bytes of text that are compressed together, and comparisons of one go.
CHUNK = 1 << 21
BATCH = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: The pattern of words.
WORDS = r"[^\x20\x09-\x0D]+"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries of keys come at least twice."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a GRAM-gram that comes twice in their own text; first: index of each text's first word, and of the end."""
    grams, at = gram_hashes(hashes, first, GRAM)
    out = np.zeros(len(hashes) + 1, np.int64)
    if len(grams):
        own = np.repeat(np.arange(len(first) - 1), np.diff(at))
        starts = np.arange(len(grams)) + (first[:-1] - at[:-1])[own]
        hit = starts[repeated(mixed(grams ^ mixed(own.astype(np.uint64) + np.uint64(1))))]
        np.add.at(out, hit, 1)
        np.add.at(out, hit + GRAM, -1)
    return np.cumsum(out)[:-1] > 0


class Grammar:
    """Re-Pair of ids in stretches: nodes (left, middle, right) at their first place, and all (node, place)."""

    def __init__(self, ids: np.ndarray, stretch: np.ndarray):
        lefts, middles, rights, nodes, places = [], [], [], [], []
        symbol, n_nodes = ids.astype(np.int64), 0
        begin = np.arange(len(ids))  # where a symbol starts
        end = begin + 1
        top = int(ids.max()) + 1 if len(ids) else 0
        while len(symbol) > 1:
            inner = stretch[begin[1:]] == stretch[begin[:-1]]
            _, key = np.unique(symbol[:-1] * top + symbol[1:], return_inverse=True)
            counts = np.bincount(key[inner], minlength=int(key.max()) + 1)
            weight = np.where(inner, counts[key], 0)
            # Ties go by the pair itself, so that all its places agree; within a row of one pair every other place is taken.
            rank = weight * (len(counts) + 1) + key
            before, after = np.concatenate(([-1], rank[:-1])), np.concatenate((rank[1:], [-1]))
            best = (weight >= 2) & (rank >= before) & (rank >= after)
            taken = np.flatnonzero(best)
            if not len(taken):
                break
            fresh = np.ones(len(taken), bool)
            fresh[1:] = np.diff(taken) > 1
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(taken)), 0))
            taken = taken[(np.arange(len(taken)) - head) % 2 == 0]
            _, where, number = np.unique(key[taken], return_index=True, return_inverse=True)
            one = taken[where]
            lefts.append(begin[one])
            middles.append(begin[one + 1])
            rights.append(end[one + 1])
            nodes.append(number + n_nodes)
            places.append(begin[taken])
            symbol[taken] = number + top
            end[taken] = end[taken + 1]
            keep = np.ones(len(symbol), bool)
            keep[taken + 1] = False
            symbol, begin, end = symbol[keep], begin[keep], end[keep]
            n_nodes += len(one)
            top += len(one)
        size = 1  # what is left, by a balanced tree over each stretch's symbols
        own = stretch[begin] if len(begin) else begin
        number = np.arange(len(begin)) - np.searchsorted(own, own, "left")
        while len(begin) and size <= int(number.max()):
            half = np.flatnonzero(number % (2 * size) == size)
            low, high = half - size, np.minimum(half + size, np.searchsorted(own, own[half], "right")) - 1
            lefts.append(begin[low])
            middles.append(begin[half])
            rights.append(end[high])
            nodes.append(np.arange(len(half)) + n_nodes)
            places.append(begin[low])
            n_nodes += len(half)
            size *= 2
        flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.left, self.middle, self.right, self.node, self.place = map(flat, (lefts, middles, rights, nodes, places))


def _extension(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from a and b on (back: before them), at most limit, by halving over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), limit.copy()
    while len(a) and (low < high).any():
        mid = (low + high + 1) // 2
        x, y = (a - mid, b - mid) if back else (a, b)
        same = (total[x + mid] - total[x]) * down[x] == (total[y + mid] - total[y]) * down[y]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _exact(ids: np.ndarray, a: int, b: int, limit: int, back: bool) -> int:
    """The same for one pair of places, word by word."""
    x, y = (ids[a - limit : a][::-1], ids[b - limit : b][::-1]) if back else (ids[a : a + limit], ids[b : b + limit])
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else limit


def _smallest(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which stretches have no period that is a proper divisor of q."""
    out = np.ones(len(q), bool)
    if not len(q):
        return out
    top = int(q.max()) + 1
    factor = np.arange(top)  # the smallest prime factor
    for p in range(2, int(top**0.5) + 1):
        if factor[p] == p:
            part = factor[p * p :: p]
            part[part == np.arange(p * p, top, p)] = p
    rest = q.copy()
    while (rest > 1).any():
        f = np.where(rest > 1, factor[rest], 1)
        d = q // f
        n = end - start - d
        shorter = (f > 1) & ((total[start + n] - total[start]) * down[start] == (total[start + d + n] - total[start + d]) * down[start + d])
        out &= ~shorter
        while True:
            again = (f > 1) & (rest % f == 0)
            if not again.any():
                break
            rest = np.where(again, rest // f, rest)
    return out


def crossing(ids: np.ndarray, g: Grammar) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs that cross each node's boundary, at its first place and within it."""
    n = len(ids)
    up, down = _power(_P1, n)
    values = mixed(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    triple = np.zeros(n + 1, np.uint64)
    if n >= 3:
        triple[: n - 2] = mixed(values[:-2] + np.uint64(3) * mixed(values[1:-1] + np.uint64(5) * mixed(values[2:])))
    found: list[tuple[np.ndarray, ...]] = []
    # Periods to the right of the boundary (sign 1), then to its left: places m and m + q, or m - q and m.
    for sign in (1, -1):
        room = g.right - g.middle if sign > 0 else g.middle - g.left
        cuts = np.concatenate(([0], np.cumsum(room)))
        at = 0
        while at < len(room):
            to = max(int(np.searchsorted(cuts, cuts[at] + BATCH, "right")) - 1, at + 1)
            node = np.repeat(np.arange(at, to), room[at:to])
            q = np.arange(int(cuts[at]), int(cuts[to])) - np.repeat(cuts[at:to], room[at:to]) + 1
            at = to
            m = g.middle[node]
            a, b = (m, m + q) if sign > 0 else (m - q, m)
            # The words that agree with those q further on are LEAST - GRAM in a row at least: three of them on one side of the boundary.
            right = (b + 3 <= g.right[node]) & (triple[np.minimum(a, n)] == triple[np.minimum(b, n)])
            left = (a - 3 >= g.left[node]) & (triple[np.maximum(a - 3, 0)] == triple[np.maximum(b - 3, 0)])
            pick = np.flatnonzero(right | left)
            if not len(pick):
                continue
            node, q, a, b = node[pick], q[pick], a[pick], b[pick]
            room_right, room_left = g.right[node] - b, a - g.left[node]
            after = _extension(total, down, a, b, room_right, False)
            ahead = _extension(total, down, a, b, room_left, True)
            run = np.flatnonzero(after + ahead >= np.maximum(q, LEAST - q))
            node, q, a, b, after, ahead = node[run], q[run], a[run], b[run], after[run], ahead[run]
            small = np.flatnonzero(_smallest(total, down, a - ahead, b + after, q))
            node, q, a, b, after, ahead = node[small], q[small], a[small], b[small], after[small], ahead[small]
            for k in range(len(q)):  # hashes decided so far; equal they aren't proved equal
                if not np.array_equal(ids[a[k] - ahead[k] : a[k] + after[k]], ids[b[k] - ahead[k] : b[k] + after[k]]):
                    after[k], ahead[k] = _exact(ids, a[k], b[k], g.right[node[k]] - b[k], False), _exact(ids, a[k], b[k], a[k] - g.left[node[k]], True)
            run = np.flatnonzero(after + ahead >= np.maximum(q, LEAST - q))
            found.append((node[run], (a - ahead)[run], (b + after)[run], q[run]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))


def found_runs(ids: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the ids, within stretches, by start and period."""
    g = Grammar(ids, stretch)
    node, start, end, q = crossing(ids, g)
    # All places of each node with a run.
    order = np.argsort(g.node, kind="stable")
    first, last = np.searchsorted(g.node[order], node, "left"), np.searchsorted(g.node[order], node, "right")
    times = last - first
    which = np.repeat(np.arange(len(node)), times)
    place = g.place[order[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + first[which]]]
    move = place - g.left[node[which]]
    start, end, q = start[which] + move, end[which] + move, q[which]
    # Of one period, those that lie in another go.
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    far = np.zeros(len(q), np.int64)
    if len(q):
        wide = end + q * (len(ids) + 1)  # ascending by period first
        far = np.concatenate(([-1], np.maximum.accumulate(wide)[:-1]))
        keep = wide > far
        start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _text_runs(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By the number of a text, its runs (start, length, period) in words."""
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return {}
    inside = covered(span_hashes(data, starts, ends), first)
    at = np.flatnonzero(inside)
    if not len(at):
        return {}
    raw = data.tobytes()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)), np.int64, len(at))
    text = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(text) > 0)
    start, end, q = found_runs(ids, np.cumsum(new))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, s, length, period in zip(text[start].tolist(), at[start].tolist(), (end - start).tolist(), q.tolist(), strict=True):
        out.setdefault(k, []).append((s - int(first[k]), length, period))
    return out


def _collapsed(text: str, runs: list[tuple[int, int, int]]) -> str:
    words = text.encode().split()
    keep = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        keep[start + period] += 1
        keep[start + length] -= 1
    return b" ".join([w for w, k in zip(words, np.cumsum(keep)[:-1].tolist(), strict=True) if not k]).decode()


def with_runs(docs: DataFrame, text: str = "text", names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs with two more columns: the runs of each text, and the text without their repetitions.

    runs: array of (start, length, period) in words [^\\x20\\x09-\\x0D]+ numbered from 0, by start
    and period.  collapsed: the words, joined by one space, without those that a run holds after its
    first period; empty where the text is null or has no words.  A null or empty text has no runs (an empty array).  Texts are read
    whole; each is compressed in one task, in memory that grows with the words that repeat.  Rows that repeat are
    handled as often as they come, and ties don't arise: a text's runs are a set.  An empty
    table gives an empty one.  All other columns stay, nulls in them included; where docs has one of the
    names already, the new column's gets underscores before it.
    """
    names = (free_name(docs, names[0]), free_name(docs, names[1]))
    columns = [c for c in docs.columns if c != text]

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            column = batch.column(len(columns))
            for i, j, data, offsets in chunks(column, CHUNK):
                found = _text_runs(data, offsets)
                texts = column.slice(i, j - i).to_pylist()
                runs = [found.get(k, []) for k in range(j - i)]
                short = [_collapsed(t or "", r) for t, r in zip(texts, runs, strict=True)]
                made = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(columns) + 1)], made, pa.array(short, pa.string())], names=[f"c{k}" for k in range(len(columns) + 3)])

    # Columns travel by place, so that their names may be anything.
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.col(f"`{text}`").cast("string").alias(f"c{len(columns)}"))
    schema = ", ".join([*[f"c{k} {types[c]}" for k, c in enumerate(columns)], f"c{len(columns)} string", f"c{len(columns) + 1} {RUNS}", f"c{len(columns) + 2} string"])
    back = {c: f"c{k}" for k, c in enumerate([*columns, text])}
    out = sent.mapInArrow(detect, schema)
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns], F.col(f"c{len(columns) + 1}").alias(names[0]), F.col(f"c{len(columns) + 2}").alias(names[1]))


def with_planted_tail(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which a tenth of the texts, by a checksum of doc_id, end in repetitions of their own words; a null doc_id or text is left alone."""
    w, h = free_name(docs, "words"), F.crc32(F.col("doc_id").cast("string"))
    listed = docs.withColumn(w, F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))))
    g, n = F.floor(h / 10).cast("long"), F.size(w).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    whole = lambda x: x.cast("int")
    tail = F.flatten(F.array_repeat(F.slice(w, whole(a + 1), whole(p)), whole(F.ceil((n - a) / p))))
    made = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), whole(a)), tail), F.lit(1), whole(n)), " ")
    return listed.withColumn("text", F.when(F.size(w) > 0, made).otherwise(F.col("text"))).drop(w)


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of with_runs: doc_id, n_runs, the longest run (ties: first, then shortest period) and its exponent, and digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed: Column = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_run_detection(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_digests(with_runs(with_planted_tail(docs)))
