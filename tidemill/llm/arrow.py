"""Row-wise Python work over Arrow batches of whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}
_UNSET = "987654321"  # a value that no one sets


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or about 2 MB in this session, and 512 rows in a Parquet reader's, unless it sets these itself.

    A batch stands in the JVM's buffers, in the pipe and in the Python worker at once, and rows are
    whole texts, of which 4,096 take 16 MB or more of the JVM's heap in one piece. Spark reads the settings when a plan runs, so that only a program that owns its
    session can choose them: the registered queries and the pipeline call this, operators don't.
    """
    for key, own in BATCH.items():
        if spark.conf.get(key, _UNSET) == _UNSET:
            spark.conf.set(key, own)


def release() -> None:
    """Gives memory that is free back to the system: a worker lives on after its task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``limit`` bytes of text; one longer row is a run of its own."""
    lengths, start, held = batch.column(text_at).nbytes, 0, 0
    if lengths <= limit:
        yield batch
        return
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of some batches together, as soon as they hold ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(text_at).nbytes for b in held) >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _given(texts: pa.Array, kind: str):
    return texts if kind == "array" else (texts.cast(pa.binary()) if kind == "bytes" else texts).to_pylist()


def map_texts(df: DataFrame, text: str, keep: list[str], added: T.StructType, start: Callable[[], Callable[..., list[Iterable]]], kind: str = "text") -> DataFrame:
    """``keep`` columns of every row, followed by ``added`` ones made from its whole text.

    ``start`` runs once a task and gives a function from a run of texts to a list of columns. The
    texts come as a list of strings, or by ``kind`` as a list of UTF-8 "bytes" or an Arrow "array".
    Columns of ``df`` that are not named take no part, so that their names can't clash.
    """
    clash = set(keep) & set(added.fieldNames())
    if clash:
        raise ValueError(f"kept and added columns share names: {sorted(clash)}")
    names = [*dict.fromkeys([*keep, text])]
    at, kept = names.index(text), [names.index(k) for k in keep]
    schema = T.StructType([*(df.schema[k] for k in keep), *added.fields])
    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for whole in batches:
            for batch in slices(whole, at):
                if not batch.num_rows:
                    continue
                fn = fn or start()
                columns = fn(_given(batch.column(at), kind))
                arrays = [batch.column(i) for i in kept]
                arrays += [pa.array(c, type=f.type) for c, f in zip(columns, list(out)[len(kept):], strict=True)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, out, strict=True)], schema=out)
        del fn
        release()

    return df.select(*names).mapInArrow(work, schema)


def from_text(text: Column, added: T.StructType, start: Callable[[], Callable[..., list[Iterable]]], kind: str = "text") -> Column:
    """A struct of ``added`` fields made from a whole text; the other columns of the row don't go through Python.

    ``start`` and ``kind`` are as in ``map_texts``.
    """
    out = to_arrow_schema(added)

    def work(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = start()
        for whole in arrays:
            parts = []
            for batch in slices(pa.RecordBatch.from_arrays([whole], ["text"]), 0):
                columns = fn(_given(batch.column(0), kind)) if batch.num_rows else [[] for _ in out]
                parts.append(pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], fields=list(out)))
            yield pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
        del fn
        release()

    work.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}  # objects, for Spark's choice of an evaluation
    return F.arrow_udf(work, added)(text)
