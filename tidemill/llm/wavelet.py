"""Wavelet-matrix files of token ids: one compressed file a shard, read without unpacking it whole.

Layout of a file (little-endian): ``WMTX0001``; unsigned 64-bit length and then bytes of a JSON
head; parts. The head names for each part its place, and holds counts of documents, tokens and
planes. Parts are the document ids and lengths (zstd), and for each plane, from the highest bit
down, its blocks of bits (zstd, or raw where that is smaller) with the number of set bits before
each block. The CRC-32 of all parts stands in the head.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ceil_div
from .arrow import gathered, release, slices
from .tokens import SLICE_BYTES, tokenizer

MAGIC = b"WMTX0001"
BLOCK_BITS = 1 << 18
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The file of documents that stand one after another in ``tokens``."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    n, top = len(tokens), int(tokens.max()) if len(tokens) else 0
    bits = max(1, top.bit_length())
    parts: list[bytes] = []
    at = 0

    def put(raw: bytes) -> list:
        nonlocal at
        small = pack(raw)
        data, kind = (small, 1) if len(small) < len(raw) else (raw, 0)
        parts.append(data)
        at += len(data)
        return [at - len(data), len(data), kind]

    head: dict = {"n_docs": len(doc_ids), "n_tokens": n, "bits": bits, "block_bits": BLOCK_BITS}
    head["doc_ids"], head["lengths"] = put(np.asarray(doc_ids, "<i8").tobytes()), put(np.asarray(lengths, "<u8").tobytes())
    current, planes = tokens.astype(np.uint16 if bits <= 16 else np.uint32), []
    for k in range(bits - 1, -1, -1):
        after, blocks, ranks = np.empty_like(current), [], []
        ones, low = 0, 0
        zeros = n - int(np.count_nonzero(current & current.dtype.type(1 << k)))
        for at_bit in range(0, n, BLOCK_BITS):  # block by block, so that places are few and stay in the cache
            piece = current[at_bit : at_bit + BLOCK_BITS]
            one = (piece >> k & 1).astype(bool)
            ranks.append(ones)
            blocks.append(put(np.packbits(one).tobytes()))
            clear, is_set = np.flatnonzero(~one), np.flatnonzero(one)
            after[low : low + len(clear)] = piece.take(clear)
            after[zeros + ones : zeros + ones + len(is_set)] = piece.take(is_set)
            low, ones = low + len(clear), ones + len(is_set)
        planes.append({"ones": ones, "blocks": blocks, "ranks": ranks})
        current = after
    head["planes"] = planes
    body = b"".join(parts)
    head["crc32"] = zlib.crc32(body)
    text = json.dumps(head).encode()
    return b"".join((MAGIC, len(text).to_bytes(8, "little"), text, body))


class WaveletMatrix:
    """Reads a file's bytes: ``access``, ``rank``, ``select``, ``count`` and ``locate`` unpack the blocks that they touch only."""

    def __init__(self, data: bytes, kept_blocks: int = 256):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        size = int.from_bytes(data[8:16], "little")
        self.head = json.loads(data[16 : 16 + size])
        self.body = memoryview(data)[16 + size :]
        self.n, self.bits, self.block = self.head["n_tokens"], self.head["bits"], self.head["block_bits"]
        self.planes, self.store, self.kept = self.head["planes"], {}, kept_blocks

    def check(self) -> None:
        if zlib.crc32(self.body) != self.head["crc32"]:
            raise ValueError("the file's parts don't have its checksum")

    def part(self, place: list) -> bytes:
        import zstandard

        raw = self.body[place[0] : place[0] + place[1]]
        return zstandard.ZstdDecompressor().decompress(raw) if place[2] else bytes(raw)

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self.part(self.head["doc_ids"]), "<i8")

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.part(self.head["lengths"]), "<u8").astype(np.int64)

    def bits_of(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits, and the number of set bits before each of its bytes."""
        if (plane, block) not in self.store:
            if len(self.store) >= self.kept:
                self.store.pop(next(iter(self.store)))
            raw = np.frombuffer(self.part(self.planes[plane]["blocks"][block]), np.uint8)
            self.store[plane, block] = raw, np.concatenate(([0], np.cumsum(_POPCOUNT[raw], dtype=np.int64)))
        return self.store[plane, block]

    def bit(self, plane: int, i: int) -> int:
        raw, _ = self.bits_of(plane, i // self.block)
        j = i % self.block
        return int(raw[j >> 3] >> (7 - (j & 7)) & 1)

    def rank1(self, plane: int, i: int) -> int:
        """Set bits of a plane before place i."""
        block, j = divmod(i, self.block)
        if block >= len(self.planes[plane]["blocks"]):
            return self.planes[plane]["ones"]
        raw, before = self.bits_of(plane, block)
        rest = int(_POPCOUNT[raw[j >> 3] >> (8 - (j & 7))]) if j & 7 else 0
        return self.planes[plane]["ranks"][block] + int(before[j >> 3]) + rest

    def find(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that value."""
        low, high = 0, self.n
        while high - low > 1:  # the last place with at most k such bits before it
            mid = (low + high) // 2
            ones = self.rank1(plane, mid)
            if (ones if bit else mid - ones) <= k:
                low = mid
            else:
                high = mid
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            one, ones = self.bit(p, i), self.rank1(p, i)
            value = value << 1 | one
            i = self.n - self.planes[p]["ones"] + ones if one else i - ones
        return value

    def span(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the tokens of that value from places low..high-1 stand after the last plane."""
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self.rank1(p, low), self.rank1(p, high)
            if token >> (self.bits - 1 - p) & 1:
                z = self.n - self.planes[p]["ones"]
                low, high = z + a, z + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        a, b = self.span(token, low, self.n if high is None else high)
        return b - a

    rank = count

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        at, end = self.span(token, 0, self.n)
        if not 0 <= k < end - at:
            raise IndexError(k)
        at += k
        for p in range(self.bits - 1, -1, -1):
            z = self.n - self.planes[p]["ones"]
            at = self.find(p, 1, at - z) if token >> (self.bits - 1 - p) & 1 else self.find(p, 0, at)
        return at

    def locate(self, token: int) -> Iterator[int]:
        for k in range(self.count(token)):
            yield self.select(token, k)

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes' partitions from the lowest bit up."""
        current = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            low, high, before = 0, self.n - self.planes[p]["ones"], np.empty_like(current)
            bit = current.dtype.type(1 << (self.bits - 1 - p))
            for b, place in enumerate(self.planes[p]["blocks"]):
                piece = before[b * self.block : (b + 1) * self.block]
                one = np.unpackbits(np.frombuffer(self.part(place), np.uint8), count=len(piece)).view(bool)
                clear, is_set = np.flatnonzero(~one), np.flatnonzero(one)
                piece[clear] = current[low : low + len(clear)]
                piece[is_set] = current[high : high + len(is_set)] | bit
                low, high = low + len(clear), high + len(is_set)
            current = before
        return current


def write(docs: DataFrame, to: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 4096, shard_tokens: int = 6_000_000) -> DataFrame:
    """Encodes documents and writes them in ascending id order to files ``to/<part>-<number>.wm``; gives their list.

    Ranges of ids of about ``shard_docs`` documents go to one task each, which begins a new file
    where one has ``shard_tokens`` ids, so that a task holds one file's ids. File names depend on
    the range only and a file gets its name once it is whole: a task that runs again writes the
    same files. Ids are whole numbers (others raise, as does -2**63).
    Rows of equal id stand in an order by a hash of their text and may fill several files; a null id stands first;
    a null text is empty. ``to`` must be a folder that all executors share (any scheme that
    pyarrow's file systems open).
    """
    ranges = ceil_div(docs.count(), shard_docs)
    schema = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("part", "number", "n_docs", "n_tokens"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        n_held, end = 0, int(end_id).to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            nonlocal number, n_held
            ids = np.frombuffer(b"".join(held), "<u4")
            data = build(np.array([_NULL_ID if x is None else x for x in names], "<i8"), np.array([len(x) // 4 for x in held]), ids)
            system, folder = fs.FileSystem.from_uri(to)
            system.create_dir(folder, recursive=True)
            name = f"{part:06d}-{number:06d}.wm"
            draft = f"{folder}/.{name}.{os.getpid()}-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as f:
                f.write(data)
            system.move(draft, f"{folder}/{name}")
            row = [name, part, number, len(names), n_held]
            number, n_held = number + 1, 0
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, (pa.string(), *[pa.int64()] * 4), strict=True)], names=schema.fieldNames())

        for batch in (part for whole in gathered(batches, 1, SLICE_BYTES) for part in slices(whole, 1, SLICE_BYTES)):
            for name, ids in zip(batch.column(0).to_pylist(), tokenizer(path, STORE).encode(batch.column(1)), strict=True):
                names.append(name)
                held.append(ids + end)
                n_held += len(ids) // 4 + 1
                if n_held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()
        release()

    own = F.col(id_col).cast("long")
    usable = F.when(own == _NULL_ID, F.raise_error(F.lit(f"{_NULL_ID} can't be an id")).cast("long")).otherwise(own)
    rows = docs.select(usable.alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    return rows.repartitionByRange(ranges, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text").mapInArrow(work, schema)


_NULL_ID = -(2**63)
STORE = 400_000  # pieces whose ids a worker remembers, in each of two generations


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of the files in a folder: part, number, place in the file, id, ids before it in the file, number and CRC-32 of its ids."""
    schema = T.StructType([T.StructField("file", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("row", "doc_id", "before", "n_tokens", "ids_crc32"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = WaveletMatrix(data.as_buffer().to_pybytes())
                matrix.check()
                ids, lengths, tokens = matrix.doc_ids, matrix.lengths, matrix.tokens()
                ends = np.cumsum(lengths)
                raw = memoryview(tokens.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([file.rpartition("/")[2]] * len(ids), pa.string()), pa.array(np.arange(len(ids)), pa.int64()),
                    pa.array([None if x == _NULL_ID else x for x in ids.tolist()], pa.int64()),
                    pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                ], names=schema.fieldNames())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    return files.mapInArrow(work, schema)


def index_documents(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 4096, shard_tokens: int = 6_000_000) -> DataFrame:
    """Writes the files of ``docs`` and reads them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file."""
    spark = docs.sparkSession
    listed = f"{folder.rstrip('/')}/files"
    write(docs, f"{folder.rstrip('/')}/shards", path, end_id, id_col, text_col, shard_docs, shard_tokens).write.parquet(listed)
    files = spark.read.schema("file string, part long, number long, n_docs long, n_tokens long").parquet(listed)
    # one row for each file, of some millions of ids
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    rows = read(spark, f"{folder.rstrip('/')}/shards").join(firsts, "file")
    return rows.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file")
