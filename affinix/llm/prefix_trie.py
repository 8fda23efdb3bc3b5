"""A trie of the prefixes of conversations, as tables of slots that a minimal perfect hash finds.

A node is a distinct sequence of turns.  Its key is its depth and two 64-bit sums (by
exclusive or) of hashes of its turns' SHA-256 digests with their places, so running keys need no
chain.  Conversations are cut into units of UNIT turns, and units are dealt into shards.
Each shard enumerates its distinct keys, gives them slots by a minimal perfect hash, and
scatters into flat arrays: a slot is taken only if the key in it is the one that was looked up.

Two passes over shards: the first counts members, and one row for each node and shard
is added up over shards.  Every node is then owned by one shard, where its value counts; the
second accumulates values through parent slots in depth order, and again one
row for each node and shard is added up.  So a prefix of which a third of
all conversations are members is a row for each shard.  Units behind the first of a long conversation pass
their values on to the unit before, which has the ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinix.llm._shared import mixed, shared_folder, written

#: Turns of a unit, rows of a shard, ranges of turns that the order of a long conversation is made in, and ids in a line of members.
UNIT = 4096
SHARD = 1 << 18
RANGES = 1000
LINE = 1 << 12
#: The pattern of words.
WORDS = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


class SlotTable:
    """A minimal perfect hash of distinct keys (columns of 64-bit numbers), and the keys by slot, against which every lookup is verified.

    Level by level, keys are hashed to bits of which there are twice as many; those alone on their
    bit have it, the others go on.  A key's slot is the number of bits before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, left = 0, keys
        while len(left):
            size = 2 * len(left) + 1
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone))
            base += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 64:
                raise ValueError("keys aren't distinct")
        self.keys = np.zeros_like(keys)
        slot = self._slots(keys)
        self.keys[slot] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(keys), level + 1, np.uint64)
        for c in range(keys.shape[1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, c].astype(np.uint64))
        return (h % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level, (alone, before) in enumerate(self.levels):
            at = self._place(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for those that are not in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slots(keys)
        return np.where((self.keys[slot] == keys).all(1), slot, -1)


def _keys(pdf: pd.DataFrame, *names: str) -> np.ndarray:
    return pdf[list(names)].to_numpy(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys.T)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    return s[new]


def ordered_turns(conversations: DataFrame, folder: str, unit: int = UNIT) -> DataFrame:
    """(conv_id, at, digest, words), written: each conversation's turns, numbered from 0 by turn, null first.

    Null role or text is empty; rows without conv_id belong to no conversation and are left out.  Turns of
    one number go by their digest; equal rows stay, one behind the other.  A conversation longer than unit is
    numbered in ranges of its turns, whose sizes are added up.  Other columns are not looked at.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    rows = written(rows, f"{folder}/turns")
    long_ones = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > unit).select("conv_id")
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    if long_ones.isEmpty():
        ranged = rows.withColumn("part", F.lit(0))
    else:
        cuts = rows.join(long_ones, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_distinct(F.percentile_approx("turn", shares, 10_000)).alias("cuts"))
        ranged = rows.join(cuts, "conv_id", "left").withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("turn"))), F.lit(0))).drop("cuts")
    own = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")
    return written(_carried(ranged.withColumn("at", F.row_number().over(own) - 1), "part", {"at": F.count("*")}, "add"), f"{folder}/ordered").select("conv_id", "at", "digest", "words")


def _carried(rows: DataFrame, part: str, sums: dict[str, Column], how: str) -> DataFrame:
    """rows whose running columns start afresh in every part of a conversation, carried on over its parts; sums: what a part adds to each.

    how: add, or xor.  Conversations of one part have nothing to carry, and their rows meet no others.
    """
    sized = rows.groupBy("conv_id", part).agg(*[v.alias(f"_{k}") for k, v in sums.items()])
    before = Window.partitionBy("conv_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum if how == "add" else F.bit_xor
    carry = sized.select("conv_id", part, *[F.coalesce(total(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    # Only parts behind the first have something before them.
    carry = carry.where(F.col(part) > 0)
    joined = rows.join(carry, ["conv_id", part], "left")
    plus = {k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) if how == "add" else F.col(k).bitwiseXOR(F.coalesce(f"_{k}", F.lit(0))) for k in sums}
    return joined.withColumns(plus).drop(*[f"_{k}" for k in sums])


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations that begin with another's turns.

    Conversation c gets the first h turns of conversation c - c % group (all if it has fewer, none if it
    isn't there), then its own behind its first h; h is the unsigned CRC-32 of its decimal id modulo most.  Its rows are
    (conv_id, depth from 1, digest, words); members: (conv_id, depth), its number of turns, 0 among them.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    members = sizes.select("conv_id", "n", first.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    there = sizes.where(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    members = members.join(there, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("depth", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    heads = turns.where((F.pmod("conv_id", F.lit(group)) == 0) & (F.col("at") < most)).withColumnRenamed("conv_id", "base")
    begun = members.where("m > 0").select("conv_id", "base", "m").join(heads, "base").where("at < m").select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "words")
    own = turns.join(members.select("conv_id", "h", "m"), "conv_id").where("at >= h").select("conv_id", (F.col("m") + F.col("at") - F.col("h") + 1).alias("depth"), "digest", "words")
    return begun.unionByName(own), members.select("conv_id", "depth")


def _numbered_prefixes(turns: DataFrame, unit: int) -> DataFrame:
    """(conv_id, unit, depth, k1, k2, p1, p2, digest, words): each prefix's key, and its parent's two hashes."""
    rows = turns.withColumn("unit", F.floor((F.col("depth") - 1) / unit).cast("long")).withColumn("h1", F.xxhash64("digest", "depth")).withColumn("h2", F.xxhash64("depth", F.lit("second"), "digest"))
    w = Window.partitionBy("conv_id", "unit").orderBy("depth")
    run = rows.withColumn("k1", F.bit_xor("h1").over(w)).withColumn("k2", F.bit_xor("h2").over(w))
    carried = _carried(run, "unit", {"k1": F.bit_xor("h1"), "k2": F.bit_xor("h2")}, "xor")
    return carried.select("conv_id", "unit", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "digest", "words")


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes: how many of its conversations pass each, the smallest of them, and what the last turn is."""
    keys = _keys(pdf, *KEY)
    table = SlotTable(_distinct(keys))
    slot = table.find(keys)
    n = len(table.keys)
    count = np.bincount(slot, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, pdf["conv_id"].to_numpy())
    last = np.zeros(n, np.int64)
    last[slot] = np.arange(len(slot))
    some = pdf.iloc[last]
    if not (pdf["digest"].to_numpy() == some["digest"].to_numpy()[slot]).all():
        raise ValueError("two prefixes have one key")
    out = pd.DataFrame({"shard": some["shard"].to_numpy(), "depth": table.keys[:, 0], "k1": table.keys[:, 1], "k2": table.keys[:, 2]})
    return out.assign(p1=some["p1"].to_numpy(), p2=some["p2"].to_numpy(), digest=some["digest"].to_numpy(), words=some["words"].to_numpy(), n=count, least=least)


def _accumulated(pdf: pd.DataFrame, unit: int) -> pd.DataFrame:
    """A shard's nodes with its values summed over subtrees: from the deepest up, each slot is added to its parent's, within units."""
    keys = _keys(pdf, *KEY)
    table = SlotTable(keys)
    slot = table.find(keys)
    parent = table.find(np.column_stack((keys[:, 0] - 1, _keys(pdf, "p1", "p2"))))
    parent[(keys[:, 0] - 1) % unit == 0] = -1
    up, depth, least = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    up[slot], depth[slot], least[slot] = parent, keys[:, 0], pdf["least"].to_numpy()
    sums = np.zeros((len(keys), 2), np.int64)
    sums[slot] = pdf[["leaves", "saved"]].to_numpy(np.int64)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[up[level] >= 0]
        np.add.at(sums, up[level], sums[level])
    above = pd.array(np.where(parent >= 0, least[parent], 0), "Int64")
    above[parent < 0] = pd.NA
    return pd.DataFrame({"depth": keys[:, 0], "k1": keys[:, 1], "k2": keys[:, 2], "leaves": sums[slot, 0], "saved": sums[slot, 1], "above": above})


def member_digests(ends: DataFrame, keys: list[str], value: str = "conv_id") -> DataFrame:
    """(keys, sha256): SHA-256, in hexadecimal, of each key's decimal values, ascending, with commas between.

    Values are sorted over ranges, and packed into lines of LINE values at most; a
    key with several lines is hashed line by line, which is all that its task holds.
    """
    spark = ends.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.select(*keys, value).repartitionByRange(n, *keys, value).sortWithinPartitions(*keys, value)
    types = dict(ends.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, ids = _keys(pdf, *keys), pdf[value].to_numpy()
            new = np.ones(len(ids), bool)
            new[1:] = (names[1:] != names[:-1]).any(1)
            new[::LINE] = True
            at = np.flatnonzero(new)
            shown = list(map(str, ids.tolist()))
            made = [",".join(shown[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
            yield pdf.iloc[at][keys].assign(first=ids[at], line=made)

    packed = rows.mapInPandas(lines, f"{schema}, first long, line string")
    counts = Window.partitionBy(*keys)
    numbered = packed.withColumn("lines", F.count("*").over(counts))
    one = numbered.where("lines = 1").select(*keys, F.sha2("line", 256).alias("sha256"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                now = tuple(getattr(row, k) for k in keys)
                if now != key:
                    if state is not None:
                        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*keys, "sha256"])
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row.line.encode())
        if state is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*keys, "sha256"])

    many = numbered.where("lines > 1").repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "line").mapInPandas(hashed, f"{schema}, sha256 string")
    return one.unionByName(many)


def trie(turns: DataFrame, members: DataFrame, folder: str, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """One row a node of the prefixes of turns(conv_id, depth from 1, digest, words), the root among them unless there are no members.

    members: (conv_id, depth), every conversation with its number of turns, once.  Columns: conv_id, the smallest member;
    depth; parent_conv_id, null for the root; n_convs, members; n_children; n_leaves, nodes of the
    subtree without children; saved_tokens, (members - 1) * words of the last turn summed over the subtree; ends_sha256, of the
    members that end there; k1 and k2, with depth the node's key.
    """
    prefixes = written(_numbered_prefixes(turns, unit), f"{folder}/prefixes")
    shards = max(1, -(-prefixes.count() // shard))
    place = F.pmod(F.xxhash64("conv_id", "unit", F.lit("shard")), F.lit(shards)).cast("int")
    dealt = prefixes.withColumn("shard", place).repartition(shards, "shard")
    parts = "shard int, depth long, k1 long, k2 long, p1 long, p2 long, digest binary, words long, n long, least long"
    local = written(dealt.groupBy("shard").applyInPandas(_counted, parts), f"{folder}/local")
    nodes = local.groupBy(*KEY).agg(*[f(c).alias(a) for c in ("p1", "p2", "digest") for f, a in ((F.min, c), (F.max, f"{c}_"))], F.max("words").alias("words"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min("shard").alias("owner"))
    clash = (F.col("p1") != F.col("p1_")) | (F.col("p2") != F.col("p2_")) | (F.col("digest") != F.col("digest_"))
    checked = F.when(clash, F.raise_error(F.lit("two prefixes have one key")).cast("long")).otherwise(F.col("n")).alias("n")
    found = written(nodes.select(*KEY, "p1", "p2", "words", checked, "least", "owner"), f"{folder}/found")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = written(found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), f"{folder}/nodes")
    valued = nodes.select(*KEY, "owner", "least", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))

    mine = local.select("shard", *KEY, "p1", "p2").join(valued, KEY).withColumns({c: F.when(F.col("shard") == F.col("owner"), F.col(c)).otherwise(0) for c in ("leaves", "saved")}).select("shard", *KEY, "p1", "p2", "least", "leaves", "saved")
    mine = _with_later_units(mine, prefixes, valued, place)
    sums = mine.repartition(shards, "shard").groupBy("shard").applyInPandas(lambda pdf: _accumulated(pdf, unit), "depth long, k1 long, k2 long, leaves long, saved long, above long")
    sums = sums.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("above").alias("above"))

    # The root has all conversations and the values of all nodes.
    whole = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    below = valued.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("s"), F.count(F.when(F.col("depth") == 1, 1)).alias("c"))
    zero = F.lit(0).cast("long")
    root = whole.crossJoin(below).select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("c").alias("n_children"), F.greatest("l", F.lit(1)).alias("n_leaves"), F.col("s").alias("saved_tokens"))
    smallest = members.agg(F.min("conv_id").alias("top"))
    # A parent is in its child's shard, but for those at the end of a unit.
    late = (F.col("depth") - 1) % unit == 0
    parents = nodes.where((F.col("depth") % unit == 0) & (F.col("n_children") > 0)).select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent"))
    parents = nodes.where(late & (F.col("depth") > 1)).select(*KEY, "p1", "p2").join(parents, ["depth", "p1", "p2"]).select(*KEY, "parent")
    every = nodes.join(sums, KEY).join(parents, KEY, "left").crossJoin(F.broadcast(smallest))
    parent = F.when(F.col("depth") == 1, F.col("top")).otherwise(F.coalesce("above", "parent")).alias("parent_conv_id")
    rest = every.select(*KEY, F.col("least").alias("conv_id"), parent, F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    ends = prefixes.join(members, ["conv_id", "depth"], "left_semi").select(*KEY, "conv_id").unionByName(members.where("depth = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    digests = member_digests(ends, KEY).withColumnRenamed("sha256", "ends_sha256")
    out = root.unionByName(rest).join(digests, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "k1", "k2")


def _with_later_units(mine: DataFrame, prefixes: DataFrame, valued: DataFrame, place: Column) -> DataFrame:
    """mine, where the last node of a unit also has the values that later units of its conversation own.

    A node behind a first unit is owned by one unit among those that hold it (the smallest conversation's), not by a shard
    alone, so that its value is passed on along one conversation.
    """
    late = prefixes.where("unit > 0")
    if late.isEmpty():
        return mine
    owner = late.groupBy(*KEY).agg(F.min(F.struct("conv_id", "unit")).alias("o")).select(*KEY, "o.conv_id", "o.unit")
    owned = owner.withColumn("own_shard", place).join(valued.drop("owner", "least"), KEY)
    there = owned.select(F.col("own_shard").alias("shard"), *KEY, F.col("leaves").alias("l"), F.col("saved").alias("s"))
    mine = mine.join(there, ["shard", *KEY], "left").join(owned.select(*KEY, F.lit(True).alias("late")), KEY, "left")
    mine = mine.withColumn("leaves", F.when(F.col("late"), F.coalesce("l", F.lit(0))).otherwise(F.col("leaves"))).withColumn("saved", F.when(F.col("late"), F.coalesce("s", F.lit(0))).otherwise(F.col("saved"))).drop("l", "s", "late")
    sums = owned.groupBy("conv_id", "unit").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    tails = prefixes.groupBy("conv_id", "unit").agg(F.max(F.struct(*KEY)).alias("k")).join(late.select("conv_id").distinct(), "conv_id", "left_semi")
    after = Window.partitionBy("conv_id").orderBy("unit").rowsBetween(1, Window.unboundedFollowing)
    passed = tails.join(sums, ["conv_id", "unit"], "left").select("conv_id", "unit", "k", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("l", "s")])
    passed = passed.withColumn("shard", place).select("shard", "k.*", "l", "s").groupBy("shard", *KEY).agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    joined = mine.join(passed, ["shard", *KEY], "left")
    return joined.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")


def prefix_trie(conversations: DataFrame, folder: str | None = None, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as they are; see ordered_turns for nulls, ties and repeated rows, trie for the columns.

    Turns of any length and number are read whole.  An empty table has no node; columns of other names are not looked at.
    """
    folder = folder or shared_folder(conversations.sparkSession)
    turns = ordered_turns(conversations, folder, unit)
    members = written(turns.groupBy("conv_id").agg(F.count("*").alias("depth")), f"{folder}/members")
    return trie(turns.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "digest", "words"), members, folder, unit, shard)


def rebuilt_trie(conversations: DataFrame, folder: str | None = None, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """The trie of conversations that begin with another's turns (see rebuilt)."""
    folder = folder or shared_folder(conversations.sparkSession)
    turns, members = rebuilt(ordered_turns(conversations, folder, unit))
    return trie(turns.withColumn("depth", F.col("depth").cast("long")), written(members.withColumn("depth", F.col("depth").cast("long")), f"{folder}/members"), folder, unit, shard)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("k1", "k2")
