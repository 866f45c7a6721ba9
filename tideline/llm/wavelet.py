"""Token ids as wavelet matrices: one compressed file a shard, read by access, rank and select.

A shard's tokens are written bit by bit from the highest: at each level a plane holds that bit of every token in the
order of the level, and the next level takes the tokens with a 0 first, then those with a 1, each in order. Planes carry the
number of ones before every block of 512 bits, so that a rank needs one block. That gives any token (access), the
number of times an id occurs before a place (rank), and the places of an id (select) without unpacking the shard.

File layout, little-endian: magic ``TWM1``, then seven uint32: number of tokens n, documents d, planes b, words of a plane w,
blocks of a plane k, bytes of a document's key (8), and zero; d int64 keys; d+1 int64 document offsets; b uint32 numbers of zeros; b planes of w
uint64; b directories of k uint32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.shared import BROADCAST_ROWS
from tideline.llm.tokens import encoder
from tideline.session import shared_dir

MAGIC, BLOCK = b"TWM1", 8  # words of 64 bits between two counts
#: Tokens a file holds at least before the next begins; a file ends with a document.
SHARD_TOKENS = 1 << 19


def build(tokens: np.ndarray, offsets: np.ndarray, keys: np.ndarray, bits: int | None = None) -> bytes:
    """The file of a shard: tokens of its documents one after the other, where each document begins (and the end), and the documents' keys."""
    n = len(tokens)
    bits = bits or max(1, int(tokens.max()).bit_length() if n else 1)
    words = -(-n // 64)
    blocks = -(-words // BLOCK) + 1
    now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, counts, zeros = [], [], []
    for level in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)) != 0
        plane = np.zeros(words * 8, np.uint8)
        packed = np.packbits(one, bitorder="little")
        plane[: len(packed)] = packed
        plane = plane.view("<u8")
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, words, BLOCK), dtype=np.uint32) if words else np.empty(0, np.uint32)
        counts.append(np.append(np.uint32(0), np.cumsum(ones, dtype=np.uint32)).astype("<u4"))
        planes.append(plane)
        low = np.compress(~one, now)
        zeros.append(len(low))
        now = np.concatenate([low, np.compress(one, now)])
    head = MAGIC + struct.pack("<7I", n, len(keys), bits, words, blocks, 8, 0)
    return b"".join([head, keys.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), np.array(zeros, "<u4").tobytes(), *(p.tobytes() for p in planes), *(c.tobytes() for c in counts)])


class WaveletMatrix:
    """A shard's file, by its bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, docs, self.bits, words, blocks, _, _ = struct.unpack_from("<7I", raw, 4)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.offsets, self.zeros = take("<i8", docs), take("<i8", docs + 1), take("<u4", self.bits)
        self.planes = [take("<u8", words) for _ in range(self.bits)]
        self.counts = [take("<u4", blocks) for _ in range(self.bits)]

    def ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        word, bit = divmod(at, 64)
        block = word // BLOCK
        plane = self.planes[level]
        out = int(self.counts[level][block]) + int(np.bitwise_count(plane[block * BLOCK : word]).sum())
        return out + (int(plane[word]) & (1 << bit) - 1).bit_count() if bit else out

    def places(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) bits of this kind in a plane: the block by its count, then the place within its 512 bits."""
        counts = self.counts[level].astype(np.int64)
        before = counts if bit else np.arange(len(counts)) * (64 * BLOCK) - counts
        block = np.minimum(np.searchsorted(before, k, side="right"), len(counts) - 1) - 1
        plane, out = self.planes[level], np.empty(len(k), np.int64)
        for at in range(0, len(k), 4096):
            b = block[at : at + 4096]
            words = b[:, None] * BLOCK + np.arange(BLOCK)
            bits = np.unpackbits(plane[np.minimum(words, len(plane) - 1)].view(np.uint8), axis=1, bitorder="little") == bit
            out[at : at + 4096] = b * (64 * BLOCK) + (np.cumsum(bits, axis=1) > (k[at : at + 4096] - before[b])[:, None]).argmax(1)
        return out

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at >> 6]) >> (at & 63) & 1
            ones = self.ones(level, at)
            at = int(self.zeros[level]) + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(self.bits):
            a, b = self.ones(level, low), self.ones(level, high)
            if token >> self.bits - 1 - level & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """Times a token occurs before a place (none: in all)."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        return int(self.selected(token, np.array([k]))[0])

    def selected(self, token: int, k: np.ndarray | None = None) -> np.ndarray:
        """The places of a token's k-th occurrences (none: of all), a level at a time from the last."""
        if token >> self.bits:
            return np.empty(0, np.int64)
        low, high = self._range(token, self.n)
        at = low + (np.arange(high - low) if k is None else k)
        for level in range(self.bits - 1, -1, -1):
            bit = token >> self.bits - 1 - level & 1
            at = self.places(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order: the levels undone from the last."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            z, up = int(self.zeros[level]), np.empty_like(now)
            # places instead of a mask: four times as fast
            up[np.flatnonzero(~one)] = now[:z]
            up[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << self.bits - 1 - level)
            now = up
        return now


def shards(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, shard, first_id, n_docs, n_tokens, file): documents in ascending order of id, over parts and shards.

    Rows are dealt by ranges of the id (nulls first, written with the key of the smallest long; rows with equal ids may
    stand in any order). A null text counts as empty; each document ends with end_id, if given.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        code, part, number = encoder(path), None, 0
        keys: list[int] = []
        parts: list[np.ndarray] = []
        ends: list[int] = [0]
        last = [] if end_id is None else [end_id]

        def out():
            tokens = np.concatenate(parts) if parts else np.empty(0, np.uint16)
            raw = build(tokens, np.array(ends), np.array(keys, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([keys[0]], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([ends[-1]], pa.int64()), pa.array([raw], pa.binary())], names=["part", "shard", "first_id", "n_docs", "n_tokens", "file"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, key in enumerate(ids):
                if part is None:
                    part = batch.column(2)[i].as_py()
                ids_now = code.encode(texts[i].as_py())
                parts.append(np.append(ids_now, np.array(last, ids_now.dtype)) if last else ids_now)
                keys.append(-(1 << 63) if key is None else key)
                ends.append(ends[-1] + len(parts[-1]))
                if ends[-1] >= shard_tokens:
                    yield out()
                    keys, parts, ends, number = [], [], [0], number + 1
        if keys:
            yield out()

    conf = docs.sparkSession.conf
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(int(conf.get("spark.sql.shuffle.partitions")), F.col("id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("id").asc_nulls_first()).withColumn("part", F.spark_partition_id().cast("long"))
    return ordered.mapInArrow(run, "part long, shard long, first_id long, n_docs long, n_tokens long, file binary")


def write(docs: DataFrame, path: str, out: str, end_id: int | None, **options) -> None:
    """Writes the shards of documents under ``out``: one row and file image each, through Spark's commit protocol, so any Hadoop store serves."""
    shards(docs, path, end_id, **options).write.option("compression", "zstd").mode("overwrite").parquet(out)


def read(spark, out: str) -> DataFrame:
    """The shards under ``out`` with ``before``, the number of tokens in all shards before. Files aren't read for it: it sums the counts by part, then within parts."""
    held = spark.read.parquet(out)
    counts = held.select("part", "shard", "n_tokens")
    within = Window.partitionBy("part").orderBy("shard")
    # One row a part, as many as there were tasks: the only step over all of them
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    starts = counts.withColumn("inner", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("before"))
    # one row a shard; the number is checked, so that files aren't shuffled where few are broadcast
    return held.join(F.broadcast(starts) if counts.count() <= BROADCAST_ROWS else starts, ["part", "shard"])


def documents(held: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of read()."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m, before = WaveletMatrix(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
                raw, at = m.tokens().astype("<u4"), m.offsets.tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                lost = m.keys == -(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(m.keys, pa.int64(), mask=lost), pa.array(m.offsets[:-1] + before, pa.int64()), pa.array(np.diff(m.offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return held.select("before", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(held: DataFrame, token: int) -> DataFrame:
    """(part, shard, n): times a token occurs in each shard, by rank alone."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([WaveletMatrix(x.as_py()).rank(token) for x in b.column(2)], pa.int64())], names=["part", "shard", "n"])

    return held.select("part", "shard", "file").mapInArrow(run, "part long, shard long, n long")


def find_token(held: DataFrame, token: int) -> DataFrame:
    """(doc_id, at): every occurrence of a token, as its document and its place there, by select alone."""

    def run(batches):
        for b in batches:
            for x in b.column(0):
                m = WaveletMatrix(x.as_py())
                at = m.selected(token)
                doc = np.searchsorted(m.offsets, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(m.keys[doc], pa.int64()), pa.array(at - m.offsets[doc], pa.int64())], names=["doc_id", "at"])

    return held.select("file").mapInArrow(run, "doc_id long, at long")


def round_trip(docs: DataFrame, path: str, end_id: int | None, name: str = "tokens") -> DataFrame:
    """Writes the shards in the shared folder and returns documents() as read back from them."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write(docs, path, out, end_id)
    return documents(read(docs.sparkSession, out))
