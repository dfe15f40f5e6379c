"""Token-id files of directly addressable codes (operator 6).

A block holds the ids of consecutive documents. Every id is split into chunks of b1, b2, ... bits, low bits first. Level k
stores the k-th chunk of every id that has one, packed bit by bit, beside a bitmap telling which of them continue on level
k + 1; a rank directory holds the number of continuing ids before every 512 positions. Position p of level k + 1 is thus
found by one rank on level k, and any token is read without decoding its neighbours. Chunk widths are whole numbers of bits,
chosen for each block by dynamic programming over its histogram of id lengths, in four levels at most; English text under a
vocabulary of 49,000 comes out as chunks of 10, 2, 2 and 2 bits or near that.

Blocks are written through Spark's committer as the binary column of Parquet files, the container that every store and a lost
executor can cope with; a block is self-contained, so ``Block(payload)`` reads it wherever it lies.

Cases: a null or empty text is a document of just the end id; documents with a null id come first; rows of one id stay
together in any order of equal ones; an empty table makes no block; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

MAGIC, VERSION, RANK = b"DAC1", 2, 512


def chunk_widths(bits: np.ndarray, levels: int = 4) -> list[int]:
    """Widths of least total size for ids of the given bit lengths, in at most ``levels`` levels.

    A level costs (width + 1 continuation bit + its share of the rank directory) for every id on it, the last one its width
    alone. ``levels`` bounds what reading one token costs: one chunk and one rank a level.
    """
    top = max(1, int(bits.max(initial=1)))
    on = (len(bits) - np.cumsum(np.bincount(bits, minlength=top + 1))).tolist()  # ids that reach beyond k bits
    on[0] = len(bits)
    best: dict[int, tuple[float, list[int]]] = {at: (on[at] * (top - at), [top - at]) for at in range(top)}  # one level left
    for _ in range(levels - 1):
        longer = dict(best)
        for at in range(top):
            options = [best[at]] + [((w + 1 + 32 / RANK) * on[at] + best[at + w][0], [w, *best[at + w][1]]) for w in range(1, top - at)]
            longer[at] = min(options, key=lambda x: (x[0], len(x[1])))
        best = longer
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits in a row, low bits first: 64 values fill ``width`` words of 64 bits, so each of the 64 places
    in a group is one vector operation over all groups."""
    groups = -(-len(values) // 64)
    v = np.zeros((64, groups), np.uint64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(values)] = values
    v[:] = padded.reshape(groups, 64).T
    out = np.zeros((width, groups), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= v[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[j] >> np.uint64(64 - shift)
    return out.T.astype("<u8").tobytes()


def _unpack(buf: memoryview, width: int, a: int, b: int) -> np.ndarray:
    """Values at positions a..b-1."""
    if b - a <= 64:
        bits = int.from_bytes(buf[a * width // 8 : -(-b * width // 8)], "little") >> a * width % 8
        mask = (1 << width) - 1
        return np.array([bits >> k * width & mask for k in range(b - a)], np.uint32)
    first, last = a // 64, -(-b // 64)
    words = np.frombuffer(buf[first * width * 8 : last * width * 8], "<u8").reshape(last - first, width).T.copy()
    out = np.empty((64, last - first), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= words[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return out.T.reshape(-1)[a - first * 64 : b - first * 64]


def encode_block(doc_ids: Iterable[int | None], ids: list[np.ndarray], levels: int = 4) -> bytes:
    """A block of documents (id, token ids) as bytes, in at most ``levels`` levels of chunks."""
    doc_ids = list(doc_ids)
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    bits = np.maximum(1, np.frexp(flat.astype(np.float64))[1])
    widths = chunk_widths(bits, levels)
    parts, rest, left = [], flat, bits
    for k, w in enumerate(widths):
        body = _pack(rest & np.uint32((1 << w) - 1), w)
        n = len(rest)
        if k + 1 < len(widths):
            more = left > w
            bitmap = np.packbits(more, bitorder="little").tobytes()
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, n, RANK)))]).astype("<u4").tobytes() if n else b"\0" * 4
            rest, left = rest[more] >> np.uint32(w), left[more] - w
        else:
            bitmap = ranks = b""
        parts.append(struct.pack("<BIIII", w, n, len(body), len(bitmap), len(ranks)) + body + bitmap + ranks)
    known = np.array([x is not None for x in doc_ids], bool)
    names = np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8").tobytes()
    head = MAGIC + struct.pack("<HIQB", VERSION, len(doc_ids), len(flat), len(widths))
    return head + names + np.packbits(known, bitorder="little").tobytes() + offsets + b"".join(parts)


class Block:
    """Reads a block: ``get(p)`` any token, ``doc(k)`` the ids of its k-th document."""

    def __init__(self, payload: bytes):
        buf = memoryview(payload)
        if bytes(buf[:4]) != MAGIC:
            raise ValueError("not a token block")
        _, self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<HIQB", buf, 4)
        at = 4 + struct.calcsize("<HIQB")
        names = np.frombuffer(buf, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        known = np.unpackbits(np.frombuffer(buf, np.uint8, -(-self.n_docs // 8), at), bitorder="little")
        at += -(-self.n_docs // 8)
        self.doc_ids = [int(x) if k else None for x, k in zip(names, known, strict=False)]
        self.offsets = np.frombuffer(buf, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            w, n, body, bitmap, ranks = struct.unpack_from("<BIIII", buf, at)
            at += struct.calcsize("<BIIII")
            self.levels.append((w, n, buf[at : at + body], buf[at + body : at + body + bitmap], np.frombuffer(buf, "<u4", ranks // 4, at + body + bitmap)))
            at += body + bitmap + ranks

    def _rank(self, level: int, p: int) -> int:
        """Continuing ids before position p of a level: the directory, then at most 512 bits."""
        _, _, _, bitmap, ranks = self.levels[level]
        block = p // RANK
        first = block * RANK // 8
        inside = int.from_bytes(bitmap[first : first + RANK // 8], "little") & ((1 << (p - block * RANK)) - 1)
        return int(ranks[block]) + inside.bit_count()

    def get(self, p: int) -> int:
        if not 0 <= p < self.n_tokens:
            raise IndexError(p)
        value = shift = 0
        for k, (w, _, body, bitmap, _) in enumerate(self.levels):
            value |= int(_unpack(body, w, p, p + 1)[0]) << shift
            shift += w
            if k + 1 == len(self.levels) or not bitmap[p // 8] >> p % 8 & 1:
                break
            p = self._rank(k, p)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a..b-1: on each level the continuing ids of a range form a range, bounded by two ranks."""
        out = np.zeros(b - a, np.uint32)
        at, shift = np.arange(b - a), 0
        for k, (w, _, body, bitmap, _) in enumerate(self.levels):
            if a == b:
                break
            out[at] |= _unpack(body, w, a, b) << np.uint32(shift)
            shift += w
            if k + 1 == len(self.levels):
                break
            first = a // 8
            more = np.unpackbits(np.frombuffer(bitmap[first : -(-b // 8)], np.uint8), bitorder="little")[a - first * 8 : b - first * 8].astype(bool)
            at = at[more]
            a, b = self._rank(k, a), self._rank(k, b)
        return out

    @property
    def widths(self) -> list[int]:
        return [level[0] for level in self.levels]

    def doc(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))


CACHE_WORDS = 400_000
_PLAIN = re.compile(rb"([a-z]+)([!-/:-@\[-`{-~]*)")
_LATIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
_SHOWN = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_encoders: dict[str, WordIds] = {}


class WordIds(dict):
    """Chunk of text between white space -> its ids as packed integers, in a cache bounded by clearing.

    The tokenizer cuts at white space and between letters and marks before it merges, so a text's ids are those of its
    chunks in a row, and a run of marks at the end of a chunk, after a letter, can be told apart from it. A chunk of
    Latin letters is one word to the tokenizer and goes to its model directly; any other passes the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        small = self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.kind, self.code = ("=u2", "H") if small else ("=u4", "I")
        self.tokenize = self.tok.model.tokenize
        self.marks: dict[bytes, bytes] = {}
        # the shortcuts hold for a tokenizer that keeps letters as they are and cuts marks off; any other gets whole chunks
        self.plain = all(self._whole(a) == self._model(a) and self._whole(a + b) == self._model(a) + self._whole(b) for a in (b"abc", b"the", b"qzx") for b in (b".", b",", b"!!", b"'", b"***", b".\")", b"-"))
        self.latin = self.plain and all(self._whole(w.encode()) == self._accented(w.encode()) for w in ("été", "ñandú", "größe", "ÀÉÎÕÜ", "þæøå", "ça"))
        self.lower = self.plain and self._whole(b"AbC") == self._whole(b"abc")

    def _whole(self, chunk: bytes) -> bytes:
        return array(self.code, self.tok.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _model(self, chunk: bytes) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(chunk.decode())]).tobytes()

    def _mark(self, mark: bytes) -> bytes:
        if len(self.marks) > 10_000:
            self.marks.clear()
        ids = self.marks[mark] = self._whole(mark)
        return ids

    def _accented(self, chunk: bytes) -> bytes:
        """A word of Latin letters: lower case, no marks to compose, one word to the tokenizer."""
        return self._model(chunk.decode().lower().encode().decode("latin-1").translate(_BYTE_LEVEL).encode())

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        plain = _PLAIN.fullmatch(chunk) if self.plain else None
        if plain:
            core, mark = plain.groups()
            ids = self.get(core) if mark else None
            if ids is None:
                ids = array(self.code, [t.id for t in self.tokenize(core.decode())]).tobytes()
            if mark:
                ids += self.marks.get(mark) or self._mark(mark)
        elif self.latin and (latin := _LATIN.fullmatch(chunk)):
            core, mark = latin.groups()
            ids = self._accented(core)
            if mark:
                ids += self.marks.get(mark) or self._mark(mark)
        else:
            ids = self._whole(chunk)
        self[chunk] = ids
        return ids

    def encode(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        if self.lower and b"<|" not in text:  # names of special tokens are told by their case
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), self.kind)


def word_ids(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def write_blocks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_tokens: int = 1 << 16) -> DataFrame:
    """Encode all documents in ascending id order; returns the written blocks (shard, block, n_docs, n_tokens, payload)."""
    spark = docs.sparkSession
    runtime.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer).encode
        end = np.array([end_id], np.uint32)
        names, ids, held, block, shard = [], [], 0, 0, 0

        def out():
            row = [[shard], [block], [len(names)], [held], [encode_block(names, ids)]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for name, text, at in zip(*batch.columns, strict=True):
                shard = at.as_py()
                e = encode(text.as_py())
                names.append(name.as_py())
                ids.append(np.concatenate([e, end]))
                held += len(e) + 1
                if held >= block_tokens:
                    yield out()
                    names, ids, held, block = [], [], 0, block + 1
        if names:
            yield out()

    n = max(runtime.partitions(spark), 1)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    blocks = ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, payload binary")
    return runtime.staged(blocks, "token-blocks", compression="none")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of written blocks: doc_id, start, n_tokens, ids_crc32, in file order."""
    runtime.ship(blocks.sparkSession)
    # tokens before each block: a running sum over one row a shard, and one over the blocks of each shard
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = sizes.select("shard", F.coalesce(F.sum("shard_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_shard"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("before_block"))
    starts = starts.join(before, "shard").select("shard", "block", (F.col("before_shard") + F.col("before_block")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = Block(payload.as_buffer())
                flat = b.slice(0, b.n_tokens).astype("<u4", copy=False)
                crcs = [zlib.crc32(flat[i:j]) for i, j in itertools.pairwise(b.offsets.tolist())]
                cols = [np.full(b.n_docs, shard, np.int32), np.full(b.n_docs, block, np.int32), pa.array(b.doc_ids, pa.int64()), b.offsets[:-1], np.diff(b.offsets), np.array(crcs, np.int64)]
                yield pa.record_batch([pa.array(c) for c in cols], names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    # digests are narrow, so it is they that meet the sums, and payloads are never shuffled
    read = blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
