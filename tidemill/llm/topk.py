"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ceil_div

PAIRS = "query_id long, vec_id long, score long"


def postings(rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows, weights) of the terms that any row has, of dense integer rows."""
    out = []
    for term in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, term])
        if len(at):
            out.append((term, at, rows[at, term]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of each query (row) and candidate: term after term, each query's weight times the term's postings."""
    scores = np.zeros((len(queries), n), np.int64)
    for term, at, weights in lists:
        own = np.flatnonzero(queries[:, term])
        if not len(own):
            continue
        if len(at) == n and len(own) == len(queries):
            scores += queries[:, term, None] * weights
        elif len(at) == n:
            scores[own] += queries[own, term, None] * weights
        else:
            scores[np.ix_(own, at)] += queries[own, term, None] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; all if fewer."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The vectors as views of the column's own numbers."""
    own = column.combine_chunks()
    values, ends = own.flatten().to_numpy(), np.cumsum(pc.list_value_length(own).to_numpy())
    return np.split(values, ends[:-1]) if len(ends) else []


def single(ids: list[int], rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One row of each id in ascending order: of repeated ids, the smallest vector."""
    kept: dict[int, np.ndarray] = {}
    for i, row in zip(ids, rows, strict=True):
        if i not in kept or row.tolist() < kept[i].tolist():
            kept[i] = row
    order = sorted(kept)
    return np.array(order, np.int64), [kept[i] for i in order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest integer inner product for each query.

    A component x becomes floor(scale * x). Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part. Every other id is a candidate of every query
    of the same number of components; ties go to the smaller id. Rows of equal id count once, with
    the smallest vector. Empty vectors score 0 with each other. An empty table gives no rows. Ids
    are whole numbers; a vector whose squared length is 2**62 or more raises, so that no sum of
    64-bit integers can overflow.

    Both sides are cut into blocks by a hash of the id; a task gets one block of each, so its
    memory is bounded at any size; candidates move once for each block of queries, queries once for
    each block of candidates.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    clean = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("id is not null and x is not null").filter(clean)
    length = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.floor(v * scale).cast("double") * F.floor(v * scale).cast("double"))
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    rows = rows.select("id", "asks", F.when(length < 2.0**62, whole).otherwise(F.raise_error(F.lit("a vector is too long")).cast("array<bigint>")).alias("w"))
    n, asking = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = ceil_div(n, block), ceil_div(asking, query_block)

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    candidates = rows.select("id", "w", dealt(blocks).alias("c"), every(query_blocks).alias("q"))
    queries = rows.filter("asks").select("id", "w", dealt(query_blocks).alias("q"), every(blocks).alias("c"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ask_ids, asks = single(left["id"].to_pylist(), matrix(left["w"]))
            ids, weights = single(right["id"].to_pylist(), matrix(right["w"]))
            sizes = np.array([len(w) for w in weights])
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                own = ids[of]
                lists = postings(np.stack([weights[i] for i in of]))
                asking = [i for i, a in enumerate(asks) if len(a) == size]
                for at in range(0, len(asking), 128):
                    group = asking[at : at + 128]
                    scores = accumulate(np.stack([asks[i] for i in group]), lists, len(own))
                    for i, line in zip(group, scores, strict=True):
                        others = np.flatnonzero(own != ask_ids[i]) if ask_ids[i] in own else slice(None)
                        top = best(line[others], own[others], k)
                        out[0] += [int(ask_ids[i])] * len(top)
                        out[1] += own[others][top].tolist()
                        out[2] += line[others][top].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(search, PAIRS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
