"""The prefix trie, packing and run detection against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinix.llm import packing, prefix_trie, run_detection

SMALL = "/root/testdata/sf0.001"


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


# 11
def turn_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows, rebuild=True):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t, r or "", x or ""))
    for c, own in convs.items():
        convs[c] = [(r, x) for t, r, x in sorted(own, key=lambda v: (v[0] is not None, v[0] or 0, turn_digest(v[1], v[2])))]
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:]) if rebuild else tuple(own)
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, s in made.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in children[s])
    ids = lambda s: ",".join(map(str, sorted(ends[s])))
    return sorted((min(members[s]), len(s), min(members[s[:-1]]) if s else -1, len(members[s]), len(children[s]), leaves[s], saved[s], hashlib.sha256(ids(s).encode()).hexdigest()) for s in members)


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def some_conversations(spark, seed=3):
    draw = random.Random(seed)
    rows = [(c, None if draw.random() < 0.05 else t, draw.choice(["user", "assistant", None]), draw.choice(["a b", "c", "a  b c", None, "", "w " * 3000])) for c in draw.sample(range(200), 100) for t in range(draw.randint(1, 6))]
    rows += [(None, 1, "user", "of none"), rows[0], rows[0]]
    return rows, clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "at", "depth", "shard", "unit", "k1", "n", "words")


def test_trie_of_rebuilt_conversations(spark):
    rows, df = some_conversations(spark)
    assert nodes(prefix_trie.rebuilt_trie(df)) == brute_trie(rows)
    assert nodes(prefix_trie.rebuilt_trie(df, shard=50)) == brute_trie(rows)


@pytest.mark.parametrize(("unit", "shard"), [(7, 60), (1, 30)])
def test_trie_of_long_conversations(spark, monkeypatch, unit, shard):
    """Long ones are ordered in ranges, cut in units, and their members' lines are hashed one by one."""
    monkeypatch.setattr(prefix_trie, "LINE", 3)
    draw = random.Random(unit)
    rows = [(c, t, "u", draw.choice("ab") if t > 15 + c % 3 * 4 else "same") for c in range(9) for t in range(40)] + some_conversations(spark)[0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.prefix_trie(df, unit=unit, shard=shard)) == brute_trie(rows, False)


def test_trie_of_nothing_and_of_the_given_table(spark):
    _, df = some_conversations(spark)
    assert nodes(prefix_trie.rebuilt_trie(df.limit(0))) == []
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(prefix_trie.op11_prefix_trie(spark, SMALL)) == brute_trie(rows)


def test_slots_are_minimal_perfect_and_verified():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(-(2**62), 2**62, (5000, 3)), axis=0)
    table = prefix_trie.SlotTable(keys)
    assert sorted(table.find(keys)) == list(range(len(keys)))
    assert (table.find(keys + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.concatenate((keys[:1], keys[:1])))


# 12
def test_best_fit_and_exchanges():
    draw = np.random.default_rng(5)
    for k in range(120):
        capacity = int(draw.integers(5, 40))
        lengths = draw.integers(1, capacity + 1, draw.integers(0, 60)).tolist()
        bins = packing.pack(lengths, capacity)
        assert sum(bins, collections.Counter()) == collections.Counter(lengths)
        fills = [sum(b.elements()) for b in bins]
        assert max(fills, default=0) <= capacity and len(bins) >= packing.least_bins(np.array(lengths, int), capacity)
        assert sum(2 * f <= capacity for f in fills) <= 1
        assert len(bins) <= len(packing.best_fit(lengths, capacity))


def test_least_bins_is_a_lower_bound():
    def fewest(lengths, capacity):
        best = len(lengths)
        for order in itertools.permutations(lengths):
            bins, fill = 1, 0
            for n in order:
                if fill + n > capacity:
                    bins, fill = bins + 1, 0
                fill += n
            best = min(best, bins)
        return best

    draw = np.random.default_rng(8)
    for _ in range(40):
        lengths = draw.integers(1, 11, 6).tolist()
        assert packing.least_bins(np.array(lengths), 10) <= fewest(lengths, 10) <= len(packing.pack(lengths, 10))


def test_exchanges_save_bins_that_best_fit_needs():
    draw = np.random.default_rng(1)
    lengths = draw.integers(600, 800, 1500).tolist()
    assert len(packing.pack(lengths, 2048)) < len(packing.best_fit(lengths, 2048))


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_packed_documents_against_the_tokenizer(spark, shard):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(["alpha", "beta", "gamma 12", "é", "\n"], k=draw.randint(0, 300)))) for i in range(150)] + [(None, "no id"), (7, None), (8, ""), (9, "twice"), (9, "twice"), (10, "x " * 9000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "key", "piece", "length", "offset", "ids", "shard", "fill")
    folder = prefix_trie.shared_folder(spark)
    pieces = packing.write_pieces(df, f"{folder}/pieces", path, 256)
    placed = packing.placed_pieces(pieces, folder, 256, shard)
    tok = Tokenizer.from_file(path)
    want = collections.Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
    docs = collections.defaultdict(list)
    got = pieces.join(placed, "key").orderBy("key").collect()
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.width == 2 and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert len(ids) == r.length <= 256 and (r.length == 256 or r.piece == 0)
        if r.piece == 0:
            assert r.start == 0
            docs[len(docs)] = [r.doc_id, []]
        assert r.start == len(docs[len(docs) - 1][1])
        docs[len(docs) - 1][1] += ids
    assert collections.Counter((d, tuple(ids)) for d, ids in docs.values()) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 256
    least = packing.least_bins(np.array([r.length for r in got]), 256)
    assert least <= len(places) <= least + 2
    whole = packing.sequences(pieces, placed).collect()
    assert len(whole) == len(places) and all(len(r.ids) == 2 * r.n_ids for r in whole)
    by_place = {(r.sequence_id, r.offset): r.ids for r in got}
    assert all(bytes(r.ids) == b"".join(bytes(by_place[r.sequence_id, o]) for o in r.starts) for r in whole)


def test_packing_of_an_empty_table(spark):
    import public_tokenizers

    df = spark.createDataFrame([], "doc_id long, text string")
    pieces, placed = packing.packed(df, public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.count() == 0 == placed.count()


# 13
def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts_with_runs(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        w = draw.choices("abcdefghijklmnopqrstuvwxyz"[: draw.choice([1, 2, 3, 5, 26])], k=draw.choice([0, 5, 12, 30, 60, 150]))
        if w and draw.random() < 0.7:
            a = draw.randrange(len(w))
            p = 1 + draw.randrange(min(20, len(w) - a))
            w += [w[a + k % p] for k in range(draw.randint(0, 90))]
        out.append((i, draw.choice([" ", "\n", " \t "]).join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_brute_force(spark, seed, monkeypatch):
    rows = texts_with_runs(seed, 250) + [(None, None), (None, "a " * 40), (8, None), (9, ""), (9, " \n "), (9, "é ü " * 9), (9, "é ü " * 9)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "runs", "collapsed", "c0", "at_text")
    found = run_detection.with_runs(run_detection.with_planted_tail(df))
    assert found.columns == [*df.columns, "_runs", "_collapsed"] and found.select("runs").distinct().collect() == [("clash",)]
    got = run_detection.run_digests(found.select("doc_id", F.col("_runs").alias("runs"), F.col("_collapsed").alias("collapsed")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_digests(*r) for r in rows), key=str)


def test_runs_of_long_texts_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "tick " * 200_000), (2, "one two three " * 70_000 + "end"), (3, " ".join(map(str, range(100_000))))], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in run_detection.with_runs(df).select("doc_id", "runs").collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [(0, 210_000, 3)], 3: []}
    assert run_detection.with_runs(df.limit(0)).count() == 0


def test_runs_where_prefix_hashes_agree_by_chance():
    """Thue-Morse words defeat polynomial hashes modulo 2^64; runs are compared word by word."""
    t = [0]
    while len(t) < 1 << 13:
        t += [1 - x for x in t]
    w = t + [2] + t[:4096] + [1 - x for x in t[:4096]]
    got = run_detection.found_runs(np.array(w), np.zeros(len(w), int))
    assert not len(got[0]) or all(w[i] == w[i + q] for s, e, q in zip(*got, strict=True) for i in range(s, e - q))


def test_run_digests_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, run_detection.op13_run_detection(spark, SMALL).collect())) == sorted(brute_digests(*r) for r in rows)
