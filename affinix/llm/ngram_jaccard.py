"""Similarity join of documents by their sets of 5-word shingles: Jaccard 0.75 or more.

Prefix filtering over inverted lists, with two ways to skip work that relations
between sets make needless:

* Equal sets are one class; only classes are joined.
* Index lists are built over prefixes: of a set of n shingles, ordered from rare
  to frequent, the first n - ceil(0.75 n) + 1.  Similar sets share one of them,
  and at the first shared one their positions and sizes leave room for the
  overlap that is needed; all other meetings are skipped.
* In each list, every member first meets the list's leader alone (star pairs).
  A member that is linked with the leader has its answers from it: they are in
  one component, so no pair within a component is looked at again.
* Entries outside their list's largest component then meet a few of its members,
  in rounds; members that are linked have their answers from it again.
* What is left, pairs of one list across components, is found by blocks of list
  entries of like position and size: a block whose bounds leave no room for the
  overlap is skipped whole.  After this no pair of one list is untried across
  components, so no link is lost.
* Links within a component are counted by what its sets differ in from one of them,
  the root: the overlap of any two follows from their overlaps with the root and from
  what their differences share, so whole sets are compared with the root alone.
  Blocks of members whose sizes or distances from the root are too far apart
  for any link (the distance is a metric) never meet.

Frequencies are counted over all documents in a sketch of fixed size; that, and a
filter of fixed size that keeps most texts no one asks for out of the shuffle,
are all that is broadcast.  Any order that is the same everywhere gives the same
links; a rough count only costs candidates.  Every candidate pair is verified on
its whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinix.functions.windows import top_k
from affinix.llm._components import components
from affinix.llm._shared import chunks, free_name, gram_hashes, mixed, shared_folder, span_hashes, word_bounds, written

SHINGLE = 5
#: Cells of the sketch (a power of two) and the blocks that it is summed in.
CELLS = 1 << 22
BLOCKS = 64
#: Members of a leader that are verified in one go, and entries of a list block.
STAR = 2000
BLOCK = 256
#: Members of the largest component that an entry meets in a round before the blocks, and such rounds at most.
MEET = 16
ROUNDS = 3
#: Members of a component, and shingles that they differ in from its root, in a block whose links are counted in one go.
MEMBERS = 1024
DIFFERENCES = 1 << 18
#: Bits (as a power of two) of the filter of texts that are asked for.
FILTER_BITS = 24
_TOKEN_BITS = 52


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The 52-bit hashes of each row's distinct shingles, ascending within rows, and the index of each row's first.

    data is lower case already.  A row of 1 to k-1 words has one shingle, all of them.
    """
    starts, ends, first = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    grams, gram_first = gram_hashes(words, first, k)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(gram_first))
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        from affinix.llm._shared import _P2

        grams = np.concatenate((grams, span_hashes(words, first[short], first[short + 1], _P2)))
        row = np.concatenate((row, short))
    key = np.sort(row.astype(np.uint64) << np.uint64(_TOKEN_BITS) | grams >> np.uint64(64 - _TOKEN_BITS))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    found = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(_TOKEN_BITS)) if n < 1 << (64 - _TOKEN_BITS) else np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << np.uint64(_TOKEN_BITS)), len(key))
    return key & np.uint64((1 << _TOKEN_BITS) - 1), found


def set_classes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens + np.uint64(1)), dtype=np.uint64)))
    return mixed(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def prefix_length(n):
    """Of a set of n, how many of the rarest shingles are indexed."""
    return n - (3 * n + 3) // 4 + 1


def _profile(rows: DataFrame, path: str) -> DataFrame:
    """For each row its set's size and class (kind 0); and from each task the counts of its shingles by cell (kind 1)."""
    schema = "kind int, row long, doc_id long, n long, cls long, block int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)

        def made(kind: int, rows: int, **cols) -> pa.RecordBatch:
            types = {"row": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "block": pa.int32(), "counts": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *[cols.get(c) if c in cols else pa.nulls(rows, t) for c, t in types.items()]], ["kind", *types])

        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(2), lower=True):
                tokens, first = shingle_sets(data, offsets)
                np.add.at(counts, (tokens >> np.uint64(_TOKEN_BITS - CELLS.bit_length() + 1)).astype(np.int64), 1)
                yield made(0, j - i, row=batch.column(0).slice(i, j - i), doc_id=batch.column(1).slice(i, j - i), n=pa.array(np.diff(first)), cls=pa.array(set_classes(tokens, first)))
        if counts.any():
            parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(counts, BLOCKS)]
            yield made(1, BLOCKS, block=pa.array(np.arange(BLOCKS, dtype=np.int32)), counts=pa.array(parts, pa.binary()))

    return written(rows.select("row", "doc_id", "text").mapInArrow(run, schema), path)


def _sketch(profile: DataFrame) -> np.ndarray:
    """Counts by cell over all documents, up to 65535: 8 MB, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_py()), "<u4").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 65535).astype("<u2").tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])

    out = np.zeros(CELLS, np.uint16)
    for r in profile.where("kind = 1").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").collect():
        out[r.block * (CELLS // BLOCKS) : (r.block + 1) * (CELLS // BLOCKS)] = np.frombuffer(r.counts, "<u2")
    return out


def _postings(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, cls, place): the prefix of every class; place = size << 32 | position."""
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), lower=True):
                tokens, first = shingle_sets(data, offsets)
                cls, size = set_classes(tokens, first), np.diff(first)
                row = np.repeat(np.arange(len(size)), size)
                rank = counts[(tokens >> np.uint64(_TOKEN_BITS - CELLS.bit_length() + 1)).astype(np.int64)].astype(np.uint64)
                order = np.argsort(row.astype(np.uint64) << np.uint64(52) | rank << np.uint64(36) | tokens >> np.uint64(_TOKEN_BITS - 36), kind="stable")
                place = np.arange(len(tokens)) - first[:-1][row]
                once = np.zeros(len(size), bool)  # of equal sets of this chunk one is enough
                once[np.unique(cls, return_index=True)[1]] = True
                keep = (place < prefix_length(size)[row]) & once[row]
                row, place = row[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order][keep].view(np.int64)), pa.array(cls[row]), pa.array(size[row] << 32 | place)], ["token", "cls", "place"])

    return rows.select("text").mapInArrow(run, "token long, cls long, place long")


def _room(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sets that first meet at these places can be similar enough."""
    na, nb = place_a >> 32, place_b >> 32
    least = np.minimum(na - (place_a & 0xFFFFFFFF), nb - (place_b & 0xFFFFFFFF))
    return (3 * np.maximum(na, nb) <= 4 * np.minimum(na, nb)) & (7 * least >= 3 * (na + nb))


def _lists(postings: DataFrame, path: str) -> DataFrame:
    """From every list of two or more: its entries (kind 1: token, a, place) and the star pairs of its leader a (kind 0: a, b).

    Lists come sorted by token and class, and are walked with one entry in hand, so
    a list of any length needs no more memory than a short one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand: tuple[int, int, int, bool, int] | None = None  # leader's token, class and place; whether it was passed on; the last class
        for batch in batches:
            t, c, p = (batch.column(k).to_numpy() for k in range(3))
            if not len(t):
                continue
            told = False
            if hand:
                t, c, p = np.append(hand[0], t), np.append(hand[1], c), np.append(hand[2], p)
                told = hand[3]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            if hand and len(t) > 1 and t[1] == hand[0] and c[1] == hand[4]:
                fresh[1] = False
            last = (int(t[-1]), int(c[-1]))
            t, c, p = t[fresh], c[fresh], p[fresh]
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(t)))
            lead = np.repeat(start, length)
            entry = np.repeat(length, length) > 1
            out_told = bool(entry[start[-1]]) or (told and start[-1] == 0)
            if told:
                entry[1 : length[0]] = True
                entry[0] = False
            at = np.flatnonzero(~new)
            at = at[_room(p[lead[at]], p[at])]
            hand = (int(t[start[-1]]), int(c[start[-1]]), int(p[start[-1]]), out_told, last[1])
            n, m = len(at), int(entry.sum())
            if n + m:
                zero = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [n, m])), pa.array(np.concatenate((zero, t[entry]))), pa.array(np.concatenate((c[lead[at]], c[entry]))), pa.array(np.concatenate((c[at], np.zeros(m, np.int64)))), pa.array(np.concatenate((zero, p[entry])))], ["kind", "token", "a", "b", "place"])

    dealt = postings.repartition("token").sortWithinPartitions("token", "cls")
    return written(dealt.mapInArrow(run, "kind int, token long, a long, b long, place long"), path)


def _asked_for(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows(row, text) without most of those that asked(row) doesn't hold.

    A Bloom filter of 2 MB and two probes, whatever the input; when it is full it
    lets all rows pass.
    """
    size = 1 << FILTER_BITS
    bits = asked.select(F.explode(F.array(F.col("row").bitwiseAND(size - 1), F.shiftrightunsigned("row", FILTER_BITS).bitwiseAND(size - 1))).alias("bit"))
    words = np.zeros(size // 64, np.uint64)
    for r in bits.selectExpr("shiftright(bit, 6) as word", "shiftleft(1L, cast(bit & 63 as int)) as mask").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        words[r.word] = np.uint64(r.mask & ((1 << 64) - 1))
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            row = batch.column(0).to_numpy().view(np.uint64)
            keep = np.ones(len(row), bool)
            for probe in (row & np.uint64(size - 1), row >> np.uint64(FILTER_BITS) & np.uint64(size - 1)):
                keep &= (table[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(keep))

    return rows.select("row", "text").mapInArrow(run, "row long, text string")


def _beside_leaders(pairs: DataFrame, rows: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """(a, part, member, b, text) for pairs(a, b): in each part a's text (member 0) is followed by those of its b (member 1).

    a's text is sent once for up to STAR members, and each member's text once for
    each pair; rows come sorted, so that one set is in hand.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts"))
    member = pairs.join(counts, "a").select("a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.lit(1).alias("member"), "b")
    leader = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("a").alias("b"))
    asked = written(member.unionByName(leader).join(classes.select(F.col("cls").alias("b"), "row"), "b"), f"{folder}-asked")
    sent = _asked_for(rows, asked).join(asked, "row").select("a", "part", "member", "b", "text")
    return sent.repartition("a", "part").sortWithinPartitions("a", "part", "member", "b")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Those of pairs(a, b) whose sets have Jaccard 0.75 or more, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in batches:
            a, member, b = (batch.column(k).to_numpy() for k in range(3))
            left, right = [], []
            for i, j, data, offsets in chunks(batch.column(3), lower=True):
                tokens, first = shingle_sets(data, offsets)
                for k in range(i, j):
                    own = tokens[first[k - i] : first[k - i + 1]]
                    if not member[k]:
                        lead = own
                        continue
                    both = len(np.intersect1d(lead, own, assume_unique=True))
                    if 100 * both >= 75 * (len(lead) + len(own) - both):
                        left.append(a[k])
                        right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = _beside_leaders(pairs, rows, classes, folder).select("a", "member", "b", "text")
    return written(dealt.mapInArrow(run, "a long, b long"), f"{folder}-links")


def _differences(members: DataFrame, rows: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """(root, cls, n, gone, differing) per member of a component: its size, how many of the root's shingles it lacks, and the shingles that one of both has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        last = None
        for batch in batches:
            root, member, at, cls = (batch.column(k).to_numpy() for k in range(4))
            n, gone, differing, keep = [], [], [], np.ones(batch.num_rows, bool)
            for i, j, data, offsets in chunks(batch.column(4), lower=True):
                tokens, first = shingle_sets(data, offsets)
                for k in range(i, j):
                    own = tokens[first[k - i] : first[k - i + 1]]
                    if not member[k]:
                        lead = own
                    # repeated rows come side by side; the root is a member too, in its first part
                    keep[k] = (root[k], at[k], cls[k]) != last and (member[k] or at[k] == 0)
                    last = (root[k], at[k], cls[k])
                    if not keep[k]:
                        continue
                    other = np.setxor1d(lead, own, assume_unique=True)
                    n.append(len(own))
                    gone.append((len(other) + len(lead) - len(own)) // 2)
                    differing.append(other.tobytes())
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(differing, pa.binary())], ["root", "cls", "n", "gone", "differing"])

    pairs = members.where("cls <> root").select(F.col("root").alias("a"), F.col("cls").alias("b"))
    dealt = _beside_leaders(pairs, rows, classes, folder).select("a", "member", "part", "b", "text")
    return written(dealt.mapInArrow(run, "root long, cls long, n long, gone long, differing binary"), f"{folder}-differences")


def shared_counts(tokens_a: np.ndarray, first_a: np.ndarray, tokens_b: np.ndarray, first_b: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """How many tokens each row of a shares with each row of b; rows hold distinct tokens, first is the index of each row's first."""
    n, m = len(first_a) - 1, len(first_b) - 1
    found = np.zeros(n * m, np.int64)
    order = np.argsort(tokens_b, kind="stable")
    known, owner = tokens_b[order], np.repeat(np.arange(m), np.diff(first_b))[order]
    low = np.searchsorted(known, tokens_a, "left")
    times = np.searchsorted(known, tokens_a, "right") - low
    met = np.flatnonzero(times)
    row, low, times = np.repeat(np.arange(n), np.diff(first_a))[met], low[met], times[met]
    ends = np.cumsum(times)
    i = 0
    while i < len(met):
        done = ends[i] - times[i]
        j = max(int(np.searchsorted(ends, done + limit, "right")), i + 1)
        at = np.arange(int(ends[j - 1] - done)) + np.repeat(low[i:j] - (ends[i:j] - times[i:j] - done), times[i:j])
        found += np.bincount(np.repeat(row[i:j], times[i:j]) * m + owner[at], minlength=n * m)
        i = j
    return found.reshape(n, m)


def _near(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Classes of one cell (two blocks of a component, or one with itself) and how many documents their links there reach."""
    left, right, side, cls, copies, n, gone = (cell.column(c).to_numpy() for c in ("left", "right", "side", "cls", "copies", "n", "gone"))
    parts = cell.column("differing").to_pylist()
    tokens = np.frombuffer(b"".join(parts), np.uint64)
    first = np.concatenate(([0], np.cumsum([len(x) // 8 for x in parts]))).astype(np.int64)
    root = n[0] - (first[1] - first[0]) + 2 * gone[0]
    same = left[0] == right[0]
    x = int((side == 0).sum())
    ours, theirs = slice(0, x), slice(0, x) if same else slice(x, len(cls))
    a, b = tokens[: first[x]], tokens[: first[x]] if same else tokens[first[x] :]
    first_b = first[: x + 1] if same else first[x:] - first[x]
    both = root - gone[ours, None] - gone[None, theirs] + shared_counts(a, first[: x + 1], b, first_b)
    linked = 100 * both >= 75 * (n[ours, None] + n[None, theirs] - both)
    if same:
        np.fill_diagonal(linked, False)
        return cls, linked @ copies
    return cls, np.concatenate((linked @ copies[theirs], linked.T @ copies[ours]))


def _links_within(members: DataFrame, differences: DataFrame) -> DataFrame:
    """(cls, near): how many documents of other classes each member of a component is linked with.

    members(root, cls, copies); the blocks of a component have members of like size
    and distance from the root, and every pair of blocks that leaves room for a link is one cell of bounded size.
    """
    size, band = "cast(log(4D / 3D, n) as long)", "cast(floor(4D * (octet_length(differing) / 8) / (n + gone)) as long)"
    placed = differences.withColumn("kin", F.expr(f"{size} << 40 | {band} << 36"))
    parts = placed.groupBy("root", "kin").agg(F.greatest(F.ceil(F.count("*") / F.lit(MEMBERS)), F.ceil(F.sum(F.octet_length("differing")) / F.lit(8 * DIFFERENCES)), F.lit(1)).alias("parts"))
    blocks = parts.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "kin").select("root", (F.col("kin") + F.col("part")).alias("block"))
    near = "right >= left and (right >> 40) - (left >> 40) <= 1 and abs((right >> 36 & 15) - (left >> 36 & 15)) <= 1"
    cells = blocks.withColumnRenamed("block", "left").join(blocks.withColumnRenamed("block", "right"), "root").where(near)
    sent = cells.select("root", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block")).withColumn("side", (F.col("block") > F.col("left")).cast("int"))
    own = placed.join(parts, ["root", "kin"]).withColumn("block", F.expr("kin + pmod(xxhash64(cls), parts)")).join(members.select("cls", "copies"), "cls")
    rows = sent.join(own.select("root", "block", "cls", "copies", "n", "gone", "differing"), ["root", "block"]).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand: list[pa.Table] = []
        of = None

        def counted(cell: pa.Table) -> pa.RecordBatch:
            cls, near = _near(cell)
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(near, pa.int64())], ["cls", "near"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            keys = np.stack([table.column(c).to_numpy() for c in ("root", "left", "right")], axis=1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(table)]))
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if hand and of != tuple(keys[i]):
                    yield counted(pa.concat_tables(hand))
                    hand = []
                of = tuple(keys[i])
                hand.append(table.slice(i, j - i))
        if hand:
            yield counted(pa.concat_tables(hand))

    dealt = rows.repartition("root", "left", "right").sortWithinPartitions("root", "left", "right", "side")
    return dealt.mapInArrow(run, "cls long, near long").groupBy("cls").agg(F.sum("near").alias("near"))


def _torn(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (token, cls, root, n, at, main, length) of lists that hold several components; main is the largest there."""
    placed = entries.select("token", F.col("a").alias("cls"), "place").join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    by_root = placed.groupBy("token", "root").agg(F.count("*").alias("c"))
    lists = by_root.groupBy("token").agg(F.count("*").alias("roots"), F.sum("c").alias("length"), F.max_by("root", F.struct("c", "root")).alias("main")).where("roots > 1 and length > 2").drop("roots")
    return placed.join(lists, "token").select("token", "cls", "root", F.expr("cast(place >> 32 as int)").alias("n"), F.expr("cast(place & 4294967295 as int)").alias("at"), "main", "length")


def _some_across(torn: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs of entries outside the largest component and MEET of those inside, by a hash that changes with turn."""
    inside = top_k(torn.where("root = main"), MEET, ["token"], [F.xxhash64("cls", F.lit(turn))]).select("token", F.col("cls").alias("y"), F.col("n").alias("y_n"), F.col("at").alias("y_at"))
    room = "3 * greatest(n, y_n) <= 4 * least(n, y_n) and 7 * least(n - at, y_n - y_at) >= 3 * (n + y_n)"
    return torn.where("root <> main").join(inside, "token").where(room).select(F.least("cls", "y").alias("a"), F.greatest("cls", "y").alias("b")).distinct()


def _across(torn: DataFrame) -> DataFrame:
    """Distinct pairs of entries of one list that are in different components and have room for the overlap.

    Every entry outside its list's largest component looks at the list's blocks;
    blocks whose bounds leave no room are skipped.
    """
    blocks = (
        torn.groupBy("token", F.expr("cast(log(4D / 3D, n) as int)").alias("size_class"), F.expr("cast(log2(at + 1) as int)").alias("place_class"), F.expr(f"pmod(xxhash64(cls), greatest(1, cast(length / {BLOCK} as int)))").alias("part"))
        .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("rest"), F.collect_list(F.struct(F.col("cls").alias("y"), F.col("root").alias("y_root"), F.col("n").alias("y_n"), F.col("at").alias("y_at"))).alias("block"))
        .select("token", "low", "high", "rest", "block")
    )
    probe = torn.where("root <> main").select("token", "cls", "root", "n", "at")
    met = probe.join(blocks, "token").where("3 * n <= 4 * high and 3 * low <= 4 * n and 7 * least(n - at, rest) >= 3 * (n + low)")
    fits = F.filter("block", lambda e: (e["y_root"] != F.col("root")) & (3 * F.greatest(e["y_n"], F.col("n")) <= 4 * F.least(e["y_n"], F.col("n"))) & (7 * F.least(F.col("n") - F.col("at"), e["y_n"] - e["y_at"]) >= 3 * (e["y_n"] + F.col("n"))))
    return met.select("cls", F.explode(fits).alias("e")).select(F.least("cls", "e.y").alias("a"), F.greatest("cls", "e.y").alias("b")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _linked(docs: DataFrame, folder: str, count: bool = False) -> DataFrame:
    """(row, doc_id, n_shingles, cls, root, component_id) per row, and n_links with count; root names the component, null where there are no shingles."""
    rows = _rows(docs).select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = _profile(rows, f"{folder}/profile")
    sets = profile.where("kind = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    lists = _lists(_postings(rows, _sketch(profile)), f"{folder}/lists")
    stars = written(lists.where("kind = 0").select("a", "b").distinct(), f"{folder}/stars")
    entries = lists.where("kind = 1").select("token", "a", "place")

    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.count("*").alias("copies"))
    roots = components(_verified(stars, rows, classes, f"{folder}/stars"), f"{folder}/components")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(ROUNDS + 1):
        torn = written(_torn(entries, roots), f"{folder}/torn-{turn}")
        # components only merge, so a list that is whole now stays so
        entries = torn.select("token", F.col("cls").alias("a"), F.expr("cast(n as long) << 32 | at").alias("place"))
        pairs = _across(torn) if turn == ROUNDS else _some_across(torn, turn)
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), f"{folder}/pairs-{turn}")
        if not pairs.isEmpty():
            links = _verified(pairs, rows, classes, f"{folder}/pairs-{turn}")
            roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(links), f"{folder}/components-{turn}")
            tried = tried.union(pairs)

    rooted = classes.select("cls", "low", "copies").join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes"), F.sum("copies").alias("rows"))
    ids = rooted.join(groups, "root")
    if not count:
        return sets.join(ids.select("cls", "root", "component_id"), "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    # one class, or two that are linked: all rows are; else links are counted
    members = written(ids.where("classes > 2").select("root", "cls", "copies"), f"{folder}/members")
    near = _links_within(members, _differences(members, rows, classes, f"{folder}/members"))
    ids = ids.join(near, "cls", "left").withColumn("n_links", F.when(F.col("classes") > 2, F.col("copies") + F.col("near")).otherwise(F.col("rows")) - 1)
    counted = sets.join(ids.select("cls", "root", "component_id", "n_links"), "cls", "left")
    return counted.withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def linked_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, class_id (a hash of the set), component_id and n_links.

    component_id is the lowest doc_id that links reach, its own included; n_links is
    the number of other rows that the row is linked with.  Texts
    without words (null, empty, white space) have 0 shingles, null class_id,
    their own doc_id and no links.  Repeated rows are equal sets and so linked; a null doc_id is
    never the lowest.  Texts of any length are read whole, an empty table gives none,
    ties don't matter, and extra columns are not looked at.
    """
    found = _linked(docs, folder or shared_folder(docs.sparkSession), count=True)
    return found.select("doc_id", "n_shingles", F.col("cls").alias("class_id"), "component_id", "n_links")


def one_of_each(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs with one row of each component, that with the lowest doc_id; all columns stay, whatever their names.

    Rows without words (null, empty or white texts) are in no component: all stay, but of wholly equal
    ids and texts one stays.  A null doc_id is the lowest only where there is no other; ties go by a hash of the text.
    An empty table stays empty.
    """
    found = _linked(docs, folder or shared_folder(docs.sparkSession))
    name = free_name(docs, "_row")
    keep = found.groupBy(F.coalesce("root", "row").alias("of"), F.col("root").isNull().alias("empty")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias(name))
    base = docs.columns
    kept = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(keep.distinct(), name, "left_semi")
    return kept.dropDuplicates([name]).select(*base)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
