"""Packing of tokenized documents into windows: best-fit decreasing over a tree of capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import ceil_div
from .arrow import release, slices
from .tokens import tokenizer

SHARD_BITS = 36


class CapacityTree:
    """A segment tree over remaining capacities 0..size: counts of the open windows, and for each the windows themselves."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list] = {}

    def add(self, capacity: int, window: object) -> None:
        self.open.setdefault(capacity, []).append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at //= 2

    def take(self, need: int) -> tuple[int, object] | None:
        """Removes and gives the window with the least capacity of ``need`` or more."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at //= 2
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.open[capacity].pop()
        while at:
            self.count[at] -= 1
            at //= 2
        return capacity, window


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; pieces are placed from long to short, each into the tightest open window.

    Equal lengths are placed in the order given. A length below 1 or over ``size`` is an error.
    """
    tree, fresh, placed = CapacityTree(size), 0, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if not 0 < n <= size:
            raise ValueError(f"a piece of {n} tokens doesn't fit a window of {size}")
        found = tree.take(n)
        if found is None:
            capacity, window = size, fresh
            fresh += 1
        else:
            capacity, window = found
        placed[i] = (window, size - capacity)
        if capacity > n:
            tree.add(capacity - n, window)
    return placed


def pieces(docs: DataFrame, path: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Documents as runs of at most ``size`` ids: full windows first, then what is left. A null text is empty and has the end id alone."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")),
        *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
    ])
    out, end = to_arrow_schema(schema), int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            encoded = tokenizer(path).encode(batch.column(1))
            rows: list[list] = [[] for _ in schema]
            for name, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    own = ids[4 * start : 4 * (start + size)]
                    for column, v in zip(rows, (name, start, len(own) // 4, zlib.crc32(own), total, own), strict=False):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, out, strict=True)], schema=out)
        release()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)


def pack(docs: DataFrame, path: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, shard_docs: int = 2500) -> DataFrame:
    """Every id of every document in one piece, every piece in one sequence of at most ``size`` ids.

    Pieces are dealt by a hash of id, start and content to as many shards as there are ``shard_docs``
    documents, so that neither rows without an id nor a very long text fill one; each shard is packed
    alone by best-fit decreasing, so that memory is bounded by a shard's pieces. Of equal
    lengths the smaller (doc_id, start) is placed first; repeated rows give repeated pieces. Rows with
    a null id are packed like others. An empty table gives no rows. ``sequence_id`` is the shard's
    number times 2**36 plus the window's number in it. With ``keep_ids`` the ids come along, as
    little-endian unsigned 32-bit integers. Other columns of ``docs`` take no part.
    """
    shards = ceil_div(docs.count(), shard_docs)
    cut = pieces(docs, path, end_id, size, id_col, text_col, keep_ids)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = to_arrow_schema(schema)

    def place(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.drop_columns(["shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(table.column("length").to_pylist(), size)
        table = table.append_column("sequence_id", pa.array([(shard << SHARD_BITS) + w for w, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64())).cast(out)

    key = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "ids_crc32"), F.lit(shards))
    return cut.withColumn("shard", key).groupBy("shard").applyInArrow(place, schema)


def padding(packed: DataFrame, size: int = 1024) -> DataFrame:
    """One row: ids, sequences and padded places; a sequence whose length is a power of two needs none."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.expr("bit_count(n) = 1")
    return each.agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_sequences"), F.sum(F.when(power, 0).otherwise(size - F.col("n"))).alias("n_padding"))
