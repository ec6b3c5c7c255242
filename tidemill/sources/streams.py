"""Text files as streams of white-space separated tokens at any line layout: one pass that counts, one that reads.

A block is a file's part that one scan task reads. The first pass gives each block's number of
tokens with its first and last ones, a row a block, to the driver. From these come the place of
each block in the stream and the few records that lie across blocks. The second pass makes all
other records where they are: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def tokens_of(lines: pa.Array) -> pa.Array:
    found = pc.utf8_split_whitespace(lines).flatten()
    return found.filter(pc.not_equal(found, ""))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(block, tokens) for each run of lines of one block, in order."""
    for batch in batches:
        blocks = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield int(blocks[lo]), tokens_of(batch.column(0).slice(lo, hi - lo))


@dataclass
class Stream:
    """``blocks``: (key, tokens before it, number of tokens, first tokens, last tokens) in the order of file names and places."""

    lines: DataFrame
    blocks: list[tuple[int, int, int, list[str], list[str]]]
    kept: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, kept: int = 6) -> Stream:
        """Counts the tokens of a file, or of a folder's files in the order of their names; ``kept`` of each block's ends are known."""
        text = spark.read.text(path)
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        lines = text.select("value", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("block"))
        names = text.select(*place, F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("block")).distinct()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for block, tokens in runs(batches):
                own = found.setdefault(block, [0, [], []])
                own[0] += len(tokens)
                own[1] += tokens.slice(0, max(0, kept - len(own[1]))).to_pylist()
                own[2] = (own[2] + tokens.slice(max(0, len(tokens) - kept)).to_pylist())[-kept:]
            rows = [(k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, out, strict=True)], schema=out)

        shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("head", T.ArrayType(T.StringType())), T.StructField("tail", T.ArrayType(T.StringType()))])
        out = to_arrow_schema(shape)
        counted = {r["block"]: r for r in lines.mapInArrow(count, shape).collect()}  # a row a block
        blocks, at = [], 0
        for r in sorted(names.collect(), key=lambda r: (r["file"], r["start"])):
            own = counted[r["block"]]
            blocks.append((r["block"], at, own["n"], list(own["head"]), list(own["tail"])))
            at += own["n"]
        return cls(lines, blocks, kept)

    @property
    def total(self) -> int:
        return sum(b[2] for b in self.blocks)

    def head(self, n: int) -> list[str]:
        """The first tokens, at most ``kept``."""
        out: list[str] = []
        for _, _, _, first, _ in self.blocks:
            out += first
            if len(out) >= n:
                break
        return out[:n]

    def records(self, types: dict[str, T.DataType], skip: int = 0) -> DataFrame:
        """Rows of the tokens from the ``skip``-th on, one token a column; an incomplete last one is left out. A token of another type raises."""
        width = len(types)
        if skip + width > self.kept:
            raise ValueError(f"a stream opened with kept={self.kept} has no records of {width} tokens after {skip}")
        schema = T.StructType([T.StructField(n, t) for n, t in types.items()])
        out = to_arrow_schema(schema)
        firsts, across, held = {}, [], []
        for key, begin, n, head, tail in self.blocks:
            start = max(0, skip - begin)  # what is skipped
            first = start + (skip - begin - start) % width  # where its first whole record begins
            held += head[min(start, n) : min(first, n)]
            if len(held) == width:
                across.append(held)
                held = []
            if n > first:
                rest = (n - first) % width
                held = tail[len(tail) - rest :] if rest else []
            firsts[key] = first

        def table(columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, left, carry = None, 0, None
            for block, tokens in runs(batches):
                if block != now:
                    now, left, carry = block, firsts[block], tokens.slice(0, 0)
                drop = min(left, len(tokens))
                left -= drop
                tokens = pa.concat_arrays([carry, tokens.slice(drop)]) if len(carry) else tokens.slice(drop)
                whole = len(tokens) // width * width
                carry = tokens.slice(whole)
                if whole:
                    at = np.arange(0, whole, width)
                    yield table([tokens.take(pa.array(at + k)) for k in range(width)])

        rows = self.lines.mapInArrow(read, schema)
        if not across:
            return rows
        some = table([pa.array([r[k] for r in across], pa.string()) for k in range(width)])
        return rows.union(self.lines.sparkSession.createDataFrame(pa.Table.from_batches([some]), schema))

    def rows(self, width: int, skip: int = 0) -> DataFrame:
        """(row_id, values): runs of ``width`` numbers from the ``skip``-th token on. Only rows that lie across blocks are shuffled."""
        begins = {key: begin - skip for key, begin, *_ in self.blocks}
        aligned = all(begin <= skip or (begin - skip) % width == 0 for _, begin, n, *_ in self.blocks if n)
        schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
        out = to_arrow_schema(schema)

        def piece(row: int, first: int, values: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([first], pa.int64()), lists.cast(out.field("values").type)], schema=out)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, at, held = None, 0, np.zeros(0)
            for block, tokens in runs(batches):
                if block != now:
                    if len(held):
                        yield piece(at // width, at % width, held)
                    now, at, held = block, begins[block], np.zeros(0)
                drop = min(max(0, -at - len(held)), len(tokens))
                at += drop
                numbers = np.concatenate((held, tokens.slice(drop).cast(pa.float64()).to_numpy(zero_copy_only=False)))
                short = min((-at) % width, len(numbers))  # the end of a row that began in another block
                if short and at >= 0 and at % width:
                    if short + at % width < width:  # the row is longer than what is here
                        held = numbers
                        continue
                    yield piece(at // width, at % width, numbers[:short])
                    at, numbers = at + short, numbers[short:]
                whole = len(numbers) // width
                if whole:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(whole + 1) * width, pa.int32()), pa.array(numbers[: whole * width]))
                    yield pa.RecordBatch.from_arrays([pa.array(at // width + np.arange(whole), pa.int64()), pa.array(np.zeros(whole, np.int64)), lists.cast(out.field("values").type)], schema=out)
                    at, numbers = at + whole * width, numbers[whole * width :]
                held = numbers
            if len(held):
                yield piece(at // width, at % width, held)

        pieces = self.lines.mapInArrow(read, schema)
        if aligned:
            return pieces.select("row_id", "values")
        complete = (F.col("first") == 0) & (F.size("values") == width)
        across = pieces.filter(~complete).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("first", "values"))).alias("p"))
        return pieces.filter(complete).select("row_id", "values").union(across.select("row_id", F.flatten(F.transform("p", lambda x: x["values"])).alias("values")))
