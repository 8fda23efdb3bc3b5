"""Cropped and edited copies of images by local descriptors.

1. Images of equal pixels are one class; only classes go on.
2. Corners are found on a pyramid of scales (Harris measure, local maxima, the
   strongest of each scale and cell of about CELL pixels a side).  The patch around each is given an orientation by
   its intensity centroid, and 128 binary tests between points of the smoothed
   patch, turned to that orientation with interpolation, make its descriptor.
3. Hamming tables: a descriptor is cut into 4 bands of 32 bits, so two that
   differ in at most 3 bits agree on a band.  Descriptors meet where a band agrees.
4. Pairs of descriptors within MAX_BITS vote for the similarity transform
   (quarter-octave scale, turn, and coarse shift) that maps one corner
   to the other; a pair of images is linked if at least MIN_VOTES distinct
   corners agree on one transform, in cells that overlap in the turn and in each shift.
5. Links join classes to components.  In lists of up to SHORT corners, and in
   those of up to HELD in which few are near, all pairs vote at once.  In others all members first vote with the list's leader
   alone; what is then in one component needs no more votes, and only pairs of
   corners across components meet, by blocks.  So no link between components is lost, and
   a large group of copies costs in proportion to its size, not to its square.

An image column has rows (image_id, width, height, pixels): 8-bit grey, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinix.llm._components import components
from affinix.llm._shared import shared_folder, written

#: Eighth octaves, so that a copy of any size between has a scale within 5% of one of the original's.
SCALES = tuple(2 ** (-k / 8) for k in range(9))
CORNERS = 7  # of each scale and cell
#: Full-size pixels of a cell's side, so that corners are as dense in a large picture as in its crops.
CELL = 64
RADIUS = 9
TESTS = 128
#: Least distance of the two points of a test: nearer ones tell little.
APART = 5
BANDS = 4
MAX_BITS = 12
MIN_VOTES = 4
#: Corners of a list that vote all with all; and entries of a block of a longer one.
SHORT = 16
BLOCK = 128
#: Longer lists of up to HELD corners vote all with all too where at most NEAR times as many pairs as corners are near: those of random meetings.
HELD, NEAR = 1024, 8
#: Pairs of entries of blocks that are compared at once.
MET = 1 << 19
IMAGE_SCHEMA = "image_id long, width int, height int, pixels binary"


def _test_points() -> np.ndarray:
    """Two points (x, y, u, v) of the disc of RADIUS for each test."""
    draw, out = np.random.default_rng(5), []
    while len(out) < TESTS:
        a = draw.uniform(-RADIUS, RADIUS, 4)
        if max(np.hypot(*a[:2]), np.hypot(*a[2:])) <= RADIUS and np.hypot(*(a[:2] - a[2:])) >= APART:
            out.append(a)
    return np.array(out)


_POINTS = _test_points()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_X**2 + _Y**2 <= RADIUS**2).astype(np.float32)


def _blur(a: np.ndarray) -> np.ndarray:
    """Binomial smoothing of each image of a stack."""
    for axis in (1, 2):
        p = np.pad(a, [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="edge")
        a = (np.take(p, range(0, a.shape[axis]), axis) + 2 * a + np.take(p, range(2, a.shape[axis] + 2), axis)) / 4
    return a


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    """A stack of images at another size, bilinear."""
    if scale == 1:
        return a
    h, w = (max(1, int(round(s * scale))) for s in a.shape[1:])
    y, x = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, s - 1) for n, s in ((h, a.shape[1]), (w, a.shape[2])))
    y0, x0 = np.minimum(y.astype(int), a.shape[1] - 2 if a.shape[1] > 1 else 0), np.minimum(x.astype(int), a.shape[2] - 2 if a.shape[2] > 1 else 0)
    fy, fx = (y - y0)[None, :, None], (x - x0)[None, None, :]
    y1, x1 = np.minimum(y0 + 1, a.shape[1] - 1), np.minimum(x0 + 1, a.shape[2] - 1)
    top = a[:, y0][:, :, x0] * (1 - fx) + a[:, y0][:, :, x1] * fx
    return top * (1 - fy) + (a[:, y1][:, :, x0] * (1 - fx) + a[:, y1][:, :, x1] * fx) * fy


def _sampled(stack: np.ndarray, image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at places between pixels, bilinear; corners x points."""
    x0, y0 = (np.clip(np.floor(c).astype(np.int32), 0, n - 2) for c, n in ((x, stack.shape[2]), (y, stack.shape[1])))
    fx, fy = (x - x0).astype(np.float32), (y - y0).astype(np.float32)
    flat, at = stack.ravel(), (image[:, None] * stack.shape[1] + y0) * stack.shape[2] + x0
    below = at + stack.shape[2]
    return (flat[at] * (1 - fx) + flat[at + 1] * fx) * (1 - fy) + (flat[below] * (1 - fx) + flat[below + 1] * fx) * fy


def describe(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, x, y, scale, angle in radians, descriptor bits) of the corners of a stack of images of one size; x and y are in full-size pixels."""
    out: list[tuple[np.ndarray, ...]] = []
    for scale in SCALES:
        a = _blur(_resized(stack.astype(np.float32), scale)).astype(np.float32)
        n, h, w = a.shape
        margin = RADIUS + 1
        if min(h, w) <= 2 * margin + 2:
            continue
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = (_blur(_blur(g)) for g in (gx * gx, gy * gy, gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        core = r[:, margin:-margin, margin:-margin]
        best = np.ones_like(core, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    best &= core >= r[:, margin + dy : h - margin + dy, margin + dx : w - margin + dx]
        value = np.where(best & (core > 1e-3), core, -1).reshape(n, -1)
        places = np.arange(value.shape[1]).reshape(core.shape[1:])
        cells = [c.ravel() for strip in np.array_split(places, max(1, round(stack.shape[1] / CELL)), 0) for c in np.array_split(strip, max(1, round(stack.shape[2] / CELL)), 1) if c.size]
        top = [c[np.argpartition(-value[:, c], k - 1, axis=1)[:, :k]] for c in cells for k in [min(CORNERS, len(c))]]
        image = np.concatenate([np.repeat(np.arange(n), t.shape[1]) for t in top])
        place = np.concatenate([t.ravel() for t in top])
        good = value[image, place] > 0
        image, place = image[good], place[good]
        y, x = place // core.shape[2] + margin, place % core.shape[2] + margin
        smooth = _blur(a).astype(np.float32)
        patch = smooth[image[:, None, None], y[:, None, None] + _Y, x[:, None, None] + _X] * _DISC
        angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        smooth = _blur(smooth).astype(np.float32)
        one, two = (_sampled(smooth, image, x[:, None] + cos * px - sin * py, y[:, None] + sin * px + cos * py) for px, py in (_POINTS[:, :2].T, _POINTS[:, 2:].T))
        out.append((image, x / scale, y / scale, np.full(len(x), scale), angle, one < two))
    if not out:
        z = np.zeros(0)
        return z.astype(int), z, z, z, z, np.zeros((0, TESTS), bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_CORNER = "key long, cls long, place long, low long, high long"
_CORNER_NAMES = [c.split()[0] for c in _CORNER.split(", ")]
_VOTE = "a long, b long, at long, s int, t int, u int, v int"
_VOTE_NAMES = [c.split()[0] for c in _VOTE.split(", ")]


def packed_places(x: np.ndarray, y: np.ndarray, scale: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Corners in 64 bits: x and y in 64ths of a pixel (22 bits each, so up to 65,535 pixels), the scale's eighth octave (8), and the angle (12)."""
    turn = np.rint(np.asarray(angle) / (2 * np.pi) * 4096).astype(np.int64) % 4096
    octave = np.rint(-8 * np.log2(scale)).astype(np.int64)
    return np.rint(np.asarray(x) * 64).astype(np.int64) << 42 | np.rint(np.asarray(y) * 64).astype(np.int64) << 20 | octave << 12 | turn


def _opened(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, scale and angle of packed corners."""
    p = place.view(np.uint64)
    part = lambda at, bits: (p >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.float64)
    return part(42, 22) / 64, part(20, 22) / 64, 2.0 ** (-part(12, 8) / 8), part(0, 12) / 4096 * 2 * np.pi


def _described(images: DataFrame) -> DataFrame:
    """A row per corner and band: key (the band's number and bits), cls, place (see packed_places), low and high (the 128 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                cls, width, height = (part.column(k).to_numpy() for k in range(3))
                pixels = part.column(3).to_pylist()
                for w, h in {*zip(width.tolist(), height.tolist(), strict=True)}:
                    rows = np.flatnonzero((width == w) & (height == h))
                    stack = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in rows])
                    image, x, y, scale, angle, bits = describe(stack)
                    packed = np.packbits(bits, axis=1, bitorder="little")
                    words, bands = packed.reshape(-1).view("<i8").reshape(-1, 2), packed.reshape(-1).view("<u4").reshape(-1, BANDS).astype(np.int64)
                    key = (bands | np.arange(BANDS) << 32).T.ravel()
                    rest = [cls[rows][image], packed_places(x, y, scale, angle), words[:, 0], words[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(np.tile(c, BANDS)) for c in rest]], _CORNER_NAMES)

    return images.select("cls", "width", "height", "pixels").mapInArrow(run, _CORNER)


def _near(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether corners (rows i and j of c) are of different classes and near in their bits."""
    bits = sum(np.bitwise_count((c[k][i] ^ c[k][j]).view(np.uint64)).astype(np.int32) for k in ("low", "high"))
    return (bits <= MAX_BITS) & (c["cls"][i] != c["cls"][j])


def _votes(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The votes of those pairs of corners (rows i and j of c) that are of different classes and near in their bits."""
    keep = _near(c, i, j)
    i, j = i[keep], j[keep]
    i, j = np.where(c["cls"][i] < c["cls"][j], i, j), np.where(c["cls"][i] < c["cls"][j], j, i)
    full = 2 * np.pi
    x, y, size, angle = _opened(c["place"][i])
    to_x, to_y, to_size, to_angle = _opened(c["place"][j])
    turn, ratio = (to_angle - angle) % full, size / to_size
    # Where a's origin comes to lie in b under that turn and scale.
    dx = to_x - ratio * (np.cos(turn) * x - np.sin(turn) * y)
    dy = to_y - ratio * (np.sin(turn) * x + np.cos(turn) * y)
    at = c["place"][i] >> 20
    cells = (np.rint(4 * np.log2(ratio)), np.floor(turn / full * 24) % 24, np.floor(dx / 8), np.floor(dy / 8))
    return [c["cls"][i], c["cls"][j], at, *[v.astype(np.int32) for v in cells]]


def _listed(corners: DataFrame) -> DataFrame:
    """From every list of corners of one key: the votes of all pairs of a short one, or of one of up to HELD corners few of which are near (kind 0);
    of another one the votes with its leader (kind 0) and all entries (kind 1).

    Lists come sorted by class, so the leader of a group's lists is mostly one image.  A list is held up to HELD
    corners only; then it is walked with the leader in hand.
    """
    schema = f"kind int, {_VOTE}, {_CORNER}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", *_VOTE_NAMES, *_CORNER_NAMES]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * len(_CORNER_NAMES)]

        def made(votes: list[np.ndarray] | None, entries: dict[str, np.ndarray] | None) -> pa.RecordBatch:
            n, m = (len(votes[0]) if votes else 0), (len(entries["key"]) if entries else 0)
            columns = [pa.array(np.repeat(np.array([0, 1], np.int32), [n, m]))]
            for k in range(len(_VOTE_NAMES)):
                columns.append(pa.concat_arrays([pa.array(votes[k], types[1 + k]) if n else pa.nulls(0, types[1 + k]), pa.nulls(m, types[1 + k])]))
            for k, name in enumerate(_CORNER_NAMES):
                t = types[1 + len(_VOTE_NAMES) + k]
                columns.append(pa.concat_arrays([pa.nulls(n, t), pa.array(entries[name], t) if m else pa.nulls(0, t)]))
            return pa.RecordBatch.from_arrays(columns, names)

        def taken(c: dict[str, np.ndarray], leader: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            """What rows of c give; leader: that of the first list, if part of it has gone before."""
            start = np.flatnonzero(np.concatenate(([True], c["key"][1:] != c["key"][:-1])))
            length = np.diff(np.append(start, len(c["key"])))
            long = length > SHORT
            long[0] |= leader is not None
            # Short lists: all pairs, by their distance within the list.
            rows = np.repeat(~long, length)
            left = np.repeat(start + length, length) - np.arange(len(rows)) - 1
            i = np.repeat(np.flatnonzero(rows), left[rows])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left[rows]) - left[rows], left[rows])
            yield made(_votes(c, i, j), None)
            for s, n in zip(start[long].tolist(), length[long].tolist(), strict=True):
                part = {k: v[s : s + n] for k, v in c.items()}
                begun = s == 0 and leader is not None
                if not begun and n <= HELD:
                    i, j = np.triu_indices(n, 1)
                    near = _near(part, i, j)
                    if near.sum() <= NEAR * n:
                        yield made(_votes(part, i[near], j[near]), None)
                        continue
                head = leader if begun else {k: v[:1] for k, v in part.items()}
                joined = {k: np.concatenate((head[k], part[k])) for k in part}
                yield made(_votes(joined, np.zeros(n, np.int64), np.arange(1, n + 1)), part)

        held, leader = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy() for k in _CORNER_NAMES}
            if held is not None:
                c = {k: np.concatenate((held[k], c[k])) for k in c}
            if leader is not None and c["key"][0] != leader["key"][0]:
                leader = None
            last = int(np.searchsorted(c["key"], c["key"][-1]))
            if leader is not None and last == 0 or len(c["key"]) - last > max(HELD, SHORT):  # the last list is long: what is here of it can go
                head = leader if last == 0 and leader is not None else {k: v[last : last + 1] for k, v in c.items()}
                yield from taken(c, leader)
                held, leader = None, head
            else:
                if last:
                    yield from taken({k: v[:last] for k, v in c.items()}, leader)
                    leader = None
                held = {k: v[last:] for k, v in c.items()}
        if held is not None:
            yield from taken(held, leader if leader is not None and leader["key"][0] == held["key"][0] else None)

    return corners.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, votes) of pairs with MIN_VOTES in a cell; votes come sorted by pair."""

    def links(table: pa.Table) -> pa.RecordBatch:
        a, b, at, s, t, u, v = (table.column(k).to_numpy() for k in _VOTE_NAMES)
        s, t, u, v = (x.astype(np.int64) for x in (s, t, u, v))
        pair = np.cumsum(np.concatenate(([0], (np.diff(a) != 0) | (np.diff(b) != 0)))) if len(a) else np.zeros(0, np.int64)
        keep = np.flatnonzero(np.bincount(pair)[pair] >= MIN_VOTES) if len(a) else np.zeros(0, np.int64)
        a, b, at, s, t, u, v, pair = (x[keep] for x in (a, b, at, s, t, u, v, pair))
        # Cells of 16 pixels and a twelfth of a turn, each shifted by none or half on its own: a vote counts from its half cell and from the one next to it.
        shape = [(pair * 64 + s + 32) * 24 + (t + i) % 24 for i in (0, 1) for _ in range(4)]
        place = [((u + j) << 32) + (v + k) for _ in (0, 1) for j in (0, 1) for k in (0, 1)]
        keys = [np.concatenate(x) for x in (shape, place, [at] * 8)]
        order = np.lexsort(keys[::-1])
        shape, place, at = (k[order] for k in keys)
        cell = np.ones(len(order), bool)
        cell[1:] = (np.diff(shape) != 0) | (np.diff(place) != 0)
        new = cell.copy()
        new[1:] |= np.diff(at) != 0
        votes = np.add.reduceat(new.astype(np.int64), np.flatnonzero(cell)) if len(order) else np.zeros(0, np.int64)
        best = np.zeros(int(pair[-1]) + 1 if len(pair) else 0, np.int64)
        np.maximum.at(best, shape[cell] // (64 * 24), votes)
        found, first = np.unique(pair, return_index=True)
        good = best[found] >= MIN_VOTES
        return pa.RecordBatch.from_arrays([pa.array(a[first[good]]), pa.array(b[first[good]]), pa.array(best[found[good]])], ["a", "b", "votes"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        # The last pair may go on in the next batch.
        whole = int(np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))[-1])
        if whole or held and (held[-1].column("a")[-1].as_py(), held[-1].column("b")[-1].as_py()) != (int(a[0]), int(b[0])):
            yield links(pa.Table.from_batches([*held, batch.slice(0, whole)]))
            held = [batch.slice(whole)]
        else:
            held.append(batch)
    if held:
        yield links(pa.Table.from_batches(held))


def _links(votes: DataFrame) -> DataFrame:
    """(a, b, votes) of classes whose corners agree on one similarity transform."""
    dealt = votes.select(*_VOTE_NAMES).repartition("a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(_counted, "a long, b long, votes long")


_FIELDS = ("cls", "root", "place", "low", "high")


def _block_pairs(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of blocks (a_, b_: lists of _FIELDS; same: a block with itself) in which all pairs of entries of one list meet that are in different components.

    The entries of a list's largest component and those outside it have blocks of their own; the latter's meet each other and the former's.
    """
    placed = entries.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    lists = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.max("c").alias("inside"), (F.sum("c") - F.max("c")).alias("outside"), F.max_by("root", F.struct("c", "root")).alias("main")).where("roots > 1").drop("roots")
    torn = placed.join(lists, "key").withColumn("out", F.col("root") != F.col("main"))
    part = F.expr(f"pmod(xxhash64(cls, place), ceil(if(out, outside, inside) / {BLOCK}))")
    blocks = torn.groupBy("key", "out", part.alias("part")).agg(*[F.collect_list(c).alias(c) for c in _FIELDS])
    a, b = (blocks.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("out", "part", *_FIELDS)]) for side in "ab")
    met = a.where("a_out").join(b, "key").where("not b_out or a_part <= b_part")
    return met.select((F.col("b_out") & (F.col("a_part") == F.col("b_part"))).alias("same"), *[f"{side}_{c}" for side in "ab" for c in _FIELDS])


def _across(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The votes of pairs of entries of one list that are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(f"{side}_cls").value_lengths().to_numpy().astype(np.int64) for side in "ab")
            # Some MET pairs of entries at a time.
            some = np.cumsum(size_a * size_b) // MET
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(some)) + 1):
                if not len(rows):
                    continue
                part = batch.slice(rows[0], len(rows))
                n, m = size_a[rows], size_b[rows]
                c = {k: np.concatenate([part.column(f"{side}_{k}").flatten().to_numpy() for side in "ab"]) for k in _FIELDS}
                at = np.arange(int((n * m).sum())) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                width = np.repeat(m, n * m)
                one, two = at // width, at % width
                i = np.repeat(np.cumsum(n) - n, n * m) + one
                j = int(n.sum()) + np.repeat(np.cumsum(m) - m, n * m) + two
                same = np.repeat(part.column("same").to_numpy(zero_copy_only=False), n * m)
                apart = (c["root"][i] != c["root"][j]) & (~same | (one < two))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in _votes(c, i[apart], j[apart])], _VOTE_NAMES)

    return _block_pairs(entries, roots).mapInArrow(run, _VOTE)


def copies(images: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of images(image_id, width, height, pixels): image_id, class_id (a hash of the pixels) and component_id.

    component_id is the lowest image_id that links reach, its own included.  Null, empty or
    misshapen pixels have no corners: such images are linked with nothing (null
    class_id).  Repeated rows are equal images.  Flat images, and those too small for a corner's patch, are only equal to equal
    ones; a very large one has corners in every cell.  A null id is never the lowest.  An empty table gives an
    empty result.  Extra columns, whatever their names, are not looked at.
    """
    folder = folder or shared_folder(images.sparkSession)
    whole = F.col("pixels").isNotNull() & (F.length("pixels") > 0) & (F.col("width") * F.col("height") == F.length("pixels"))
    rows = images.select(F.col("image_id").cast("long").alias("image_id"), "width", "height", "pixels").withColumn("cls", F.when(whole, F.xxhash64("width", "height", "pixels")))
    ids = written(rows.select("image_id", "cls"), f"{folder}/ids")
    classes = ids.where("cls is not null").groupBy("cls").agg(F.min("image_id").alias("low"))
    once = rows.where("cls is not null").dropDuplicates(["cls"])
    lists = written(_listed(_described(once)), f"{folder}/lists")
    votes, entries = lists.where("kind = 0").select(*_VOTE_NAMES), lists.where("kind = 1").select(*_CORNER_NAMES)
    links = written(_links(votes), f"{folder}/links")
    roots = components(links, f"{folder}/components")
    more = written(_across(entries, roots), f"{folder}/across")
    if not more.isEmpty():
        # Votes from short lists, and with leaders, count together with these.
        pairs = more.select("a", "b").distinct()
        late = written(_links(votes.join(pairs, ["a", "b"], "left_semi").unionByName(more)), f"{folder}/late-links")
        roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(late.select("a", "b")), f"{folder}/late-components")
    rooted = classes.join(roots.select(F.col("v").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = rooted.join(lowest, "root").select("cls", "component_id")
    return ids.join(facts, "cls", "left").select("image_id", F.col("cls").alias("class_id"), F.coalesce("component_id", "image_id").alias("component_id"))


# Images that Spark derives from the embeddings table, as it holds no media.
SIDE = 64
#: An edited copy is added for ids of which this is the remainder by EDIT_EVERY; its id is EDIT_BASE higher.
EDIT_EVERY, EDIT_REST, EDIT_BASE = 10, 3, 1 << 40


_wave = np.random.default_rng(3)
_AT = np.stack(np.mgrid[0:SIDE, 0:SIDE]).reshape(2, -1) / SIDE
#: 64 plane waves of fixed frequency, direction and phase; a picture is their sum, weighted by a vector.
_WAVES = np.cos(2 * np.pi * (_wave.uniform(-7, 7, (64, 2)) @ _AT + _wave.uniform(0, 1, (64, 1)))).astype(np.float32)


def _rendered(v: np.ndarray) -> np.ndarray:
    """64 numbers each as a 64 x 64 picture."""
    a = v.astype(np.float32) @ _WAVES
    spread = np.maximum(a.std(1, keepdims=True), 1e-9)
    return (np.clip((a - a.mean(1, keepdims=True)) / spread, -2.5, 2.5) * 45 + 128).reshape(-1, SIDE, SIDE)


def _edited(a: np.ndarray) -> np.ndarray:
    """A quarter turn of the upper left 56 x 56 pixels, darker and with less contrast."""
    return np.rot90(a[:, :56, :56], axes=(1, 2)) * 0.8 + 12


def images_of_vectors(vectors: DataFrame) -> DataFrame:
    """Images of vectors(vec_id, embedding), and edited copies of a tenth of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1).to_pylist()
                good = [i for i, x in enumerate(lists) if x is not None and len(x) == 64 and None not in x]
                ids = np.array(part.column(0).to_pylist(), object)[good]
                a = _rendered(np.array([lists[i] for i in good], float).reshape(-1, 64))
                pick = [i for i, x in enumerate(ids) if x is not None and x % EDIT_EVERY == EDIT_REST]
                for names, pics in ((ids, a), (ids[pick] + EDIT_BASE if len(pick) else [], _edited(a[pick]))):
                    pics = np.rint(pics).astype(np.uint8)
                    n, side = len(pics), pics.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int64()), pa.array([side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array([p.tobytes() for p in pics], pa.binary())], ["image_id", "width", "height", "pixels"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, IMAGE_SCHEMA)


def op10_media_copies(spark, sf_dir: str) -> DataFrame:
    return copies(images_of_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
