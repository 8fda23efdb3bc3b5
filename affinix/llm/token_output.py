"""Token-ID output: one concatenated id array with Elias-Fano encoded document boundaries.

Documents are range-partitioned by doc_id, encoded by a public tokenizer, and
written through Spark as blocks (Parquet rows, so that any store works and a
lost executor's part is simply made again).  A block of the file format holds

* ``ids``    little-endian unsigned 16-bit ids where the vocabulary allows it, else 32-bit;
* ``low``    the low l bits of every document's end in the block, packed;
* ``high``   the unary coded high bits: bit (end >> l) + i is set for document i;
* ``rank``   unsigned 32-bit: set bits of ``high`` before each 512 bits of it, for select;

where l = floor(log2(ids / documents)), so a boundary takes about 2 + l bits.  The
documents' ids, ascending too, are kept in the same way (``id_low``, ``id_high``,
``id_rank``) as differences from ``id_base``, behind ``n_null`` documents without one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinix.llm._shared import shared_folder, written

#: Ids of a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
#: Text pieces whose ids a Python worker remembers; beyond it, the older half stays: what came early comes often.
MEMO_PIECES = 1_200_000
_STEP = 512
#: Values that are packed, or looked up, in one go.
_PART = 1 << 12
#: ASCII marks that the pre-tokenizer always parts from letters before them (the apostrophe isn't one).
_MARKS = ".,;:!?#$%&*|()[]{}<>+=/\\~^@_\"-"
#: Documents whose ids are farther apart than this don't share a block.
ID_SPAN = 1 << 62
#: Stands for a null doc_id where documents are read back.
NO_ID = -(1 << 63)
BLOCK_SCHEMA = "shard int, block int, width int, n_docs long, n_ids long, n_null long, id_base long, id_low_bits int, id_low binary, id_high binary, id_rank binary, low_bits int, low binary, high binary, rank binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(last / length) bits each."""

    def __init__(self, low_bits: int, n: int, low: bytes, high: bytes, rank: bytes):
        self.low_bits, self.n, self.low, self.high, self.rank = low_bits, n, low, high, rank

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int(values[-1]) // n).bit_length() - 1 if values[-1] >= n else 0
        # Some at a time: a multiple of eight values fills whole bytes.
        low = b"".join(np.packbits(((values[at : at + _PART, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() for at in range(0, n, _PART))
        high = np.zeros((int(values[-1]) >> bits) + n, np.uint8)
        high[(values >> bits) + np.arange(n)] = 1
        before = np.concatenate(([0], np.cumsum(high)))[::_STEP].astype("<u4")
        return cls(bits, n, low, np.packbits(high, bitorder="little").tobytes(), before.tobytes())

    def select(self, i: int) -> int:
        """The i-th value: jumps by the rank samples to 512 bits, and looks at no others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank = np.frombuffer(self.rank, "<u4")
        at = int(np.searchsorted(rank, i, "right")) - 1
        part = np.unpackbits(np.frombuffer(self.high, np.uint8, min(_STEP // 8, len(self.high) - at * _STEP // 8), at * _STEP // 8), bitorder="little")
        position = at * _STEP + int(np.flatnonzero(part)[i - int(rank[at])])
        value = position - i
        if self.low_bits:
            begin = i * self.low_bits
            piece = int.from_bytes(self.low[begin // 8 : (begin + self.low_bits + 7) // 8], "little") >> (begin % 8)
            value = value << self.low_bits | piece & ((1 << self.low_bits) - 1)
        return value

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at places i, in any order: as select(), for many at once."""
        rank, high, low = np.frombuffer(self.rank, "<u4"), np.frombuffer(self.high, np.uint8), np.frombuffer(self.low, np.uint8)
        width = _STEP // 8
        blocks = np.zeros(-(-len(high) // width) * width, np.uint8)
        blocks[: len(high)] = high
        blocks = blocks.reshape(-1, width)
        out = []
        for part in np.split(i, range(_PART, len(i), _PART)):
            at = np.searchsorted(rank, part, "right") - 1
            # The samples say which 512 bits; in these, the place of the bit that has so many before it.
            bits = np.unpackbits(blocks[at], axis=1, bitorder="little")
            place = (np.cumsum(bits, axis=1) > (part - rank[at])[:, None]).argmax(axis=1)
            value = at * _STEP + place - part
            if self.low_bits:
                own = part[:, None] * self.low_bits + np.arange(self.low_bits)
                piece = (low[own >> 3] >> (own & 7).astype(np.uint8) & 1).astype(np.int64)
                value = value << self.low_bits | (piece << np.arange(self.low_bits)).sum(1)
            out.append(value)
        return np.concatenate(out).astype(np.int64) if len(i) else np.zeros(0, np.int64)

    def decode(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)


class PieceEncoder:
    """Encodes whole texts, remembering the ids of pieces that came before.

    Byte-level BPE never merges across the place before a white-space character
    that stands between two others, so a text in which no two white-space
    characters adjoin is the concatenation of pieces that begin with a space or
    a line feed.  Other texts are encoded in one go.  The tokenizers library
    encodes every piece; new ones are sent to it many at a time, with a line feed,
    which always has an id of its own there, between them.  A text that holds one of
    the vocabulary's added tokens is encoded in one go too: those are cut out first.
    """

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.limit = memo_pieces
        self.memo: dict[str, bytes] = {}  # by a piece without its space, or with its line feed
        self.marks: dict[str, bytes] = {}  # by a run of marks without a space before it
        self.edged: set[str] = set()  # pieces with white space at an end of what follows their space or line feed
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # Added tokens with white space inside might come about where pieces are put together.
        self.line = line[0] if len(line) == 1 and not any(c.isspace() for t in added for c in t) else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        plain: set[str] = set()
        marked = []
        for p in pieces:
            body = p[1:] if p[:1] == "\n" else p
            if not body or body[0].isspace() or body[-1].isspace():
                if body:
                    self.edged.add(p)
            elif self.line is not None and "\n" not in body:
                stem = body.rstrip(_MARKS)
                if stem != body and stem.isalpha():  # letters and the marks behind them are encoded apart
                    cut = len(p) - len(body) + len(stem)
                    marked.append((p, cut))
                    if p[:cut] not in self.memo:
                        plain.add(p[:cut])
                else:
                    plain.add(p)
                continue
            self.memo[p] = self._whole(p if p[:1] == "\n" else " " + p)
        self._encode_many(list(plain))
        for p, cut in marked:
            tail = p[cut:]
            if tail not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[tail] = self._whole(tail)
            self.memo[p] = self.memo[p[:cut]] + self.marks[tail]

    def _encode_many(self, plain: list[str]) -> None:
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            text = "".join([p if p[0] == "\n" else "\n " + p for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.line).tolist()
            if len(cuts) != len(part):
                for p in part:
                    self.memo[p] = self._whole(p if p[0] == "\n" else " " + p)
                continue
            data = ids.tobytes()
            for p, i, j in zip(part, cuts, [*cuts[1:], len(ids)], strict=True):
                self.memo[p] = data[4 * (i + (p[0] != "\n")) : 4 * j]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > self.limit:
            self.memo = dict(islice(self.memo.items(), self.limit // 2))
            self.edged = {p for p in self.edged if p in self.memo}
        # A line feed is put before each text; its one id is cut off again.
        split = [("\n" + t).replace("\n", " \n").split(" ") for t in texts]
        pieces = [p for s in split for p in s[1:]]
        made = list(map(self.memo.get, pieces))
        new = {p for p, ids in zip(pieces, made, strict=True) if ids is None}
        if new:
            self._learn(list(new))
            made = [self.memo[p] if ids is None else ids for p, ids in zip(pieces, made, strict=True)]
        out = []
        at = 0
        for text, s in zip(texts, split, strict=True):
            end = at + len(s) - 1
            if not text:
                out.append(b"")
            elif self.line is None or text[0].isspace() or self._adjoining(text) or self.added and self.added.search(text) or self.edged and not self.edged.isdisjoint(s):
                out.append(self._whole(text))
            else:
                out.append(b"".join(made[at:end])[4:])
            at = end
        return out

    @staticmethod
    def _adjoining(text: str) -> bool:
        """Whether spaces or line feeds adjoin."""
        return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def shared_encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """The encoder of this Python worker, which outlives a task."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, special_as_text=special_as_text)
    return _encoders[key]


def _block(shard: int, number: int, width: int, doc_ids: list[int | None], ids: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    ends = EliasFano.of(np.cumsum(lengths))
    data = np.frombuffer(b"".join(ids), "<u4")
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    names = EliasFano.of(known - base)
    row = (shard, number, width, len(ids), int(lengths.sum()), len(doc_ids) - len(known), base, names.low_bits, names.low, names.high, names.rank, ends.low_bits, ends.low, ends.high, ends.rank, (data.astype("<u2") if width == 2 else data).tobytes())
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in BLOCK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(row, fields, strict=True)], [name for name, _ in fields])


def _parts(r: dict) -> tuple[EliasFano, EliasFano, np.ndarray]:
    """A block's documents' ids (less id_base, without the null ones), their ends, and all token ids."""
    names = EliasFano(r["id_low_bits"], r["n_docs"] - r["n_null"], r["id_low"], r["id_high"], r["id_rank"])
    ends = EliasFano(r["low_bits"], r["n_docs"], r["low"], r["high"], r["rank"])
    return names, ends, np.frombuffer(r["ids"], "<u2" if r["width"] == 2 else "<u4")


def write_blocks(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None, block_ids: int = BLOCK_IDS, special_as_text: bool = False) -> DataFrame:
    """Writes docs(doc_id, text) to folder in ascending doc_id order and returns the blocks, read back.

    Null and empty texts hold the end id alone; texts may be of any length.  Rows with
    null doc_id come first and read back as NO_ID.  Rows that repeat a doc_id are
    written as often as they come, by length and text.  The strings of special tokens
    are those tokens, as by the library's default, or else ordinary text.  An empty table gives no
    block.  Other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        encoder = shared_encoder(tokenizer_path, special_as_text)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held, lowest = 0, None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                for key, made in zip(keys[at : at + 256], encoder.encode([t or "" for t in texts.slice(at, 256).to_pylist()]), strict=True):
                    lowest = key if lowest is None else lowest
                    if ids and key is not None and key - lowest >= ID_SPAN:
                        yield _block(shard, number, width, doc_ids, ids)
                        number, doc_ids, ids, held, lowest = number + 1, [], [], 0, key
                    doc_ids.append(key)
                    ids.append(made + end)
                    held += len(made) // 4 + 1
                    if held >= block_ids:
                        yield _block(shard, number, width, doc_ids, ids)
                        number, doc_ids, ids, held, lowest = number + 1, [], [], 0, None
        if ids:
            yield _block(shard, number, width, doc_ids, ids)

    return written(ordered.mapInArrow(encode, BLOCK_SCHEMA), folder, compression="zstd")


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, first): ids before each block.  Running sums run within shards, then over one row a shard."""
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("before", F.sum("n_ids").over(inner) - F.col("n_ids")).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("before")).alias("first"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids).

    Where documents end is looked up by select in the blocks that are read; only a narrow row per document meets the starts of the blocks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                names, bounds, data = _parts(r)
                ends, data = bounds.select_many(np.arange(bounds.n)), data.astype("<u4")
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                doc_ids = np.concatenate((np.full(r["n_null"], NO_ID, np.int64), names.decode() + r["id_base"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(doc_ids), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    documents = blocks.drop("n_ids").mapInArrow(read, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return documents.join(block_starts(blocks), ["shard", "block"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def sample_documents(blocks: DataFrame, every: int = 100) -> DataFrame:
    """The token ids of each block's documents 0, every, 2 * every, ...: shard, block, at (place in the block), doc_id, ids.

    Only two boundaries of each such document are looked up, by select.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                names, ends, data = _parts(r)
                places = range(0, r["n_docs"], every)
                doc_ids = [names.select(k - r["n_null"]) + r["id_base"] if k >= r["n_null"] else NO_ID for k in places]
                ids = [data[ends.select(k - 1) if k else 0 : ends.select(k)].tolist() for k in places]
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(list(places), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["shard", "block", "at", "doc_id", "ids"])

    return blocks.mapInArrow(read, "shard int, block int, at int, doc_id long, ids array<int>")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Encodes docs, writes the files, and returns what they hold per document."""
    return read_documents(write_blocks(docs, folder or f"{shared_folder(docs.sparkSession)}/tokens", tokenizer_path, **options))


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
