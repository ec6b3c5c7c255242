"""Near-duplicates by resemblance: texts whose sets of word shingles have a Jaccard similarity of a least value.

SimHash fingerprints (``simhash``) give the first candidates: their trie join groups the close
copies, whose members are confirmed against one of them. A 64-bit fingerprint can't tell a
similarity of 0.8, though, whose pairs differ in about ten bits with a wide spread, so further
candidates come from bands of least hashes. Each link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, small
from .arrow import map_texts, release
from ..plans.components import stars
from .simhash import fingerprints_of, hashes, roots

# A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS, at 0.8 under 3 in 100,000.
BANDS, ROWS = 20, 4
_SALTS, _ODD = np.random.default_rng(64).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_ODD |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
FINGERPRINT_BITS = 2  # between fingerprints that are first candidates
TILE = 1_000_000  # shingles of a part of a group; a task holds two parts


def node(text: Column) -> Column:
    """128 bits that equal texts share, and all texts without a word, the null one too."""
    return F.unhex(F.md5(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles."""
    return np.unique(np.array(hashes(text, width), np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys, one a band, for each of some sets that are not empty; keys of different bands are unrelated."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    if sets:
        flat = np.concatenate(sets)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
        for k in range(BANDS * ROWS):
            own = out[:, k // ROWS]
            own ^= np.minimum.reduceat((flat ^ _SALTS[k]) * _ODD[k], starts)
            own *= _MIX
            own ^= own >> np.uint64(29)
    return out


def signer(width: int) -> Callable[[list[bytes | None]], list[list]]:
    def of(texts: list[bytes | None]) -> list[list]:
        all_of = [np.array(hashes(t, width), np.uint64) for t in texts]
        prints = fingerprints_of(all_of)
        sets = [np.unique(h) for h in all_of]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list[list[int]] = [[] for _ in texts]
        for i, keys in zip(full, band_keys([sets[i] for i in full]).view(np.int64).tolist(), strict=True):
            bands[i] = keys
        return [[len(s) for s in sets], prints, bands]

    return of


SIGNED = T.StructType([T.StructField("size", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / (len(a) + len(b) - common) >= least - 1e-12


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect exactly the sets which chains of similar pairs connect.

    Sets that are connected already are not compared, so that a group of close copies takes one pass.
    """
    n, edges = len(sets), []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    root = np.arange(n)
    for p in range(n - 1):
        rest = np.flatnonzero(root[p + 1 :] != root[p]) + p + 1
        rest = rest[np.minimum(sizes[rest], sizes[p]) >= least * np.maximum(sizes[rest], sizes[p]) - 1e-9]
        if not len(rest):
            continue
        lo, hi = np.searchsorted(values, sets[p], "left"), np.searchsorted(values, sets[p], "right")
        width = hi - lo
        if width.sum() <= sizes[rest].sum():
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
            common = np.bincount(owner[at], minlength=n)[rest]
        else:
            other = np.concatenate([sets[j] for j in rest])
            place = np.minimum(np.searchsorted(sets[p], other), sizes[p] - 1)
            common = np.add.reduceat(sets[p][place] == other, np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
        near = rest[common / (sizes[rest] + sizes[p] - common) >= least - 1e-12]
        if len(near):
            edges += [(p, int(j)) for j in near]
            root[np.isin(root, root[near])] = root[p]
    return edges


def sets_of(rows: DataFrame, members: DataFrame, width: int, n: int) -> DataFrame:
    """(node, shingles) of each member (id, node): the set of the text of one row of it."""
    mine = members.select(F.col("id").alias("of_id"), F.col("node").alias("of")).distinct()
    wanted = rows.join(small(cut(mine, n)), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("node") == F.col("of")), "left_semi")
    as_set = lambda: lambda texts: [[shingles(t, width).tobytes() for t in texts]]
    found = map_texts(wanted, "text", ["node"], T.StructType([T.StructField("shingles", T.BinaryType())]), as_set, kind="bytes")
    return found.dropDuplicates(["node"])


def by_tile(rows: DataFrame, tile: list[str], edges: Callable[[list[tuple[bytes, np.ndarray]]], list[tuple[bytes, bytes]]], leader: str | None = None) -> DataFrame:
    """Edges (a, b) that ``edges`` gives for each tile's list of (node, set); with a ``leader`` column, for its row and each other one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[bytes, np.ndarray]] = []
        found: list[tuple[bytes, bytes]] = []
        key = None

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for *now, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if leader is None and len(own) > 1:
                        found.extend(edges(own))
                    own.clear()
                    key = now
                own.append((name, np.frombuffer(data, np.uint64)))
                if leader is not None and len(own) == 2:
                    found.extend(edges(own))
                    own.pop()
            if found:
                yield given()
        if leader is None and len(own) > 1:
            found.extend(edges(own))
        if found:
            yield given()
        release()

    order = tile if leader is None else [*tile, F.col(leader).desc()]
    dealt = rows.repartition(*tile).sortWithinPartitions(*order).select(*tile, "node", "shingles")
    return dealt.mapInArrow(work, "a binary, b binary")


def close_copies(rows: DataFrame, nodes: DataFrame, width: int, least: float, n: int) -> DataFrame:
    """Edges from the members of a group of linked fingerprints to its first member, where they are similar.

    Each member is compared once. Groups beyond ``TILE`` shingles are dealt in parts, each of which gets the first member too.
    """
    known = nodes.filter("size > 0")
    linked_fps = roots(cut(known.select("fp").distinct(), n), FINGERPRINT_BITS).withColumnRenamed("node", "of")
    held = known.join(linked_fps, F.col("fp") == F.col("of"), "left").select(F.coalesce("root", "fp").alias("key"), F.col("first_id").alias("id"), "node", "size")
    groups = held.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("first")).filter("n > 1")
    members = cut(held.join(small(cut(groups, n)), "key"), n)
    parts = F.ceil(F.col("total") / TILE)
    is_first = F.col("node") == F.col("first")
    where = F.when(is_first, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.lit(3), "node"), parts)))
    dealt = members.select("key", F.explode(where).alias("part"), "node", is_first.cast("int").alias("leads"))
    sets = sets_of(rows, members, width, n)
    return by_tile(dealt.join(sets, "node"), ["key", "part"], lambda own: [(own[1][0], own[0][0])] if similar(own[0][1], own[1][1], least) else [], "leads")


def band_links(rows: DataFrame, nodes: DataFrame, copies: DataFrame, width: int, least: float, n: int) -> DataFrame:
    """Edges of nodes that share a band, such that chains of them and of ``copies`` connect all similar nodes that share one.

    Groups whose members are all connected by ``copies`` have nothing to add. Groups of equal
    members count once. Groups beyond ``TILE`` shingles are dealt in parts, of which each pair is a tile.
    """
    of = copies.select(F.col("a").alias("of"), F.col("b").alias("first"))
    held = nodes.filter("size > 0").join(small(of), F.col("node") == F.col("of"), "left").select(F.col("first_id").alias("id"), "node", "size", "bands", F.xxhash64(F.coalesce("first", "node")).alias("class"))
    held = cut(held, n)
    keys = held.select(F.explode("bands").alias("key"), "class").groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    open_keys = cut(keys.filter("low <> high").select("key"), n)
    members = cut(held.select(F.explode("bands").alias("key"), "id", "node", "size").join(small(open_keys), "key"), n)
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in (1, 2)]
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *marks)
    groups = groups.groupBy("m1", "m2", "n").agg(F.min("key").alias("key"), F.max("total").alias("total")).select("key", "total")
    members = cut(members.join(small(cut(groups, n)), "key"), n)
    parts = F.ceil(F.col("total") / TILE)
    dealt = members.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    tile = ["key", "low", "high"]
    dealt = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node")
    sets = sets_of(rows, members, width, n)
    return by_tile(dealt.join(sets, "node"), tile, lambda own: [(own[i][0], own[j][0]) for i, j in linked([s for _, s in own], least)])


def groups(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and (node, root) of every node that is linked to another."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("node", node(F.col("text")))
    own = cut(map_texts(rows, "text", ["id", "node"], SIGNED, lambda: signer(width), kind="bytes"))
    n = own.count()
    nodes = cut(own.groupBy("node").agg(F.min("id").alias("first_id"), *(F.first(c).alias(c) for c in SIGNED.fieldNames())), n)
    copies = cut(close_copies(rows, nodes, width, least, n))
    links = band_links(rows, nodes, copies, width, least, n)
    return own.select("id", "node"), cut(stars(copies.union(links)), n)


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node, root, component_id of every row: the smallest id that chains of links reach from it, itself included.

    Texts link at a Jaccard similarity of ``least`` or more of their distinct shingles. Equal texts
    are one node, all texts without a word (null and empty ones too) are one, and all nodes of a
    component have one root. An id is null only where all of its component are. Repeated rows give
    equal rows, an empty table none; a text of any length is taken whole.
    """
    own, linked_nodes = groups(docs, width, least, id_col, text_col)
    held = own.join(small(linked_nodes.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    classes = held.groupBy("root").agg(F.min("id").alias("component_id"))
    return held.join(classes, "root").select("id", "node", "root", "component_id")


def without_repeats(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each component of ``near_duplicates``: that of the smallest id.

    A null id comes last, of several texts of that id the one of the smallest node counts, and of
    rows of equal id and node the least by all other columns. Whole texts stay where they are
    while the lists of what goes are small.
    """
    if clash := {"_node", "_of", "_id"} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(clash)}")
    own, linked_nodes = groups(docs, width, least, id_col, text_col)
    n = own.count()
    pairs = own.groupBy("id", "node").agg(F.count("*").alias("n"))
    held = pairs.join(small(linked_nodes.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left").select("id", "node", "n", F.coalesce("root", "node").alias("root"))
    held = cut(held, n)
    first = held.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"), F.count("*").alias("members"), F.sum("n").alias("rows"))
    first = cut(first.filter("rows > 1"), n)
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))
    extra = cut(held.join(small(first.filter("members > 1")), "root").filter(~is_first).select(F.col("id").alias("_id"), F.col("node").alias("_of")), n)
    again = cut(held.filter("n > 1").join(small(first), "root").filter(is_first).select(F.col("id").alias("_id"), F.col("node").alias("_of")), n)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_of"))
    rows = docs.withColumn("_node", node(F.col(text_col))).join(small(extra), same, "left_anti")
    if not again.limit(1).count():
        return rows.drop("_node")
    one = rows.join(small(again), same, "left_semi").groupBy(F.col(id_col).alias("_id"), F.col("_node").alias("_of")).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return rows.join(small(again), same, "left_anti").drop("_node").union(one)
