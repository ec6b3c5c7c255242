"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .arrow import map_texts
from ..plans.components import stars

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_LANES = np.zeros(256, np.uint64)
for _b in range(8):  # bit b of a byte counts in byte lane b
    _LANES |= (((np.arange(256) >> _b) & 1).astype(np.uint64)) << np.uint64(8 * _b)
RUN = 1 << 18


def hashes(text: bytes | None, width: int) -> Iterable[int]:
    """XXH64 (seed 42) of a text's shingles, repeats included; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(line, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners the number of set bits by place, 64 columns; owners are ascending."""
    total = np.zeros((n, 64), np.int64)
    if len(values):
        change = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        run = np.arange(len(values)) - np.repeat(change, np.diff(np.append(change, len(values))))
        firsts = np.flatnonzero(run % 255 == 0)  # a lane holds 255 at most
        lanes = np.add.reduceat(_LANES[values.view(np.uint8).reshape(-1, 8)], firsts, axis=0)
        np.add.at(total, owners[firsts], lanes.view(np.uint8).reshape(len(firsts), 64))
    return total


def fingerprints_of(hashed: Iterable[Iterable[int]]) -> np.ndarray:
    """The fingerprint of each text's shingle hashes, as signed numbers; at most about ``RUN`` hashes beyond one text's are held."""
    counts: list[np.ndarray] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    n_held = 0

    def flush() -> None:
        if held:
            lengths = [len(h) for h in held]
            counts.append(majority(np.concatenate(held), np.repeat(np.arange(len(held)), lengths), len(held)))
            sizes.extend(lengths)
        held.clear()

    for h in hashed:
        held.append(h if isinstance(h, np.ndarray) else np.array(h, np.uint64))
        n_held += len(held[-1])
        if n_held >= RUN:
            flush()
            n_held = 0
    flush()
    if not counts:
        return np.zeros(0, np.int64)
    above = 2 * np.concatenate(counts) > np.array(sizes)[:, None]
    return np.ascontiguousarray(np.packbits(above, axis=1, bitorder="little")).view("<u8").ravel().view("<i8")


def fingerprinter(width: int) -> Callable[[list[bytes | None]], list[np.ndarray]]:
    return lambda texts: [fingerprints_of(hashes(t, width) for t in texts)]


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fingerprint bits are those set in over half of the shingles' hashes; a text without words has 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", ["id"], T.StructType([T.StructField("fp", T.LongType())]), lambda: fingerprinter(width), kind="bytes")


# ---- trie self-join ----


def _permuted(values: np.ndarray, order: list[int]) -> np.ndarray:
    """The values with their bits in another order: order[0] becomes the highest."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    picked = np.ascontiguousarray(bits[:, order[::-1]])
    return np.ascontiguousarray(np.packbits(picked, axis=1, bitorder="little")).view("<u8").ravel()


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int, first_bit: int = 63, spent: int = 0, leaf: int = 64, most: int = 1 << 17) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in two ascending arrays of distinct 64-bit values at ``budget`` or fewer differing bits.

    A node of the trie is a run of values that share their high bits. Pairs of nodes go down
    together, each with the bits in which they differ so far; a pair that exceeds the budget is
    cut off, and a pair of small nodes is compared value by value. Pairs wait on a stack in groups
    of at most ``most``, so memory does not follow the number of pairs. Without ``right`` the array
    is joined with itself, each pair given once.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    stack = [(first_bit, *(np.array([v], np.int64) for v in (0, len(left), 0, len(right), spent)))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        small = ((ah - al) * (bh - bl) <= leaf) | (bit < 0)
        if small.any():
            a0, a1, b0, b1 = al[small], ah[small], bl[small], bh[small]
            width = b1 - b0
            size = (a1 - a0) * width
            ends = np.cumsum(size)
            for lo in range(0, len(size), max(1, most // leaf)):
                hi = min(len(size), lo + max(1, most // leaf))
                s = size[lo:hi]
                k = np.arange(s.sum()) - np.repeat(ends[lo:hi] - s - (ends[lo - 1] if lo else 0), s)
                w = np.repeat(width[lo:hi], s)
                i, j = np.repeat(a0[lo:hi], s) + k // w, np.repeat(b0[lo:hi], s) + k % w
                if own:
                    once = i < j
                    i, j = i[once], j[once]
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                if near.any():
                    yield i[near], j[near]
            rest = ~small
            al, ah, bl, bh, err = al[rest], ah[rest], bl[rest], bh[rest], err[rest]
            if not len(al):
                continue
        mask = np.uint64((1 << bit) - 1)
        one = np.uint64(1 << bit)
        am = np.searchsorted(left, (left[al] & ~mask) | one)
        bm = np.searchsorted(right, (right[bl] & ~mask) | one)
        am, bm = np.clip(am, al, ah), np.clip(bm, bl, bh)
        parts = []
        same = (al == bl) & (ah == bh) if own else None
        for a0, a1, b0, b1, cost in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)):
            keep = (a1 > a0) & (b1 > b0) & (err + cost <= budget)
            if own and cost and a0 is am:  # the mirror of (low, high) within one node
                keep &= ~same
            if keep.any():
                parts.append((a0[keep], a1[keep], b0[keep], b1[keep], err[keep] + cost))
        if parts:
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
            for lo in range(0, len(joined[0]), most):
                stack.append((bit - 1, *(x[lo : lo + most] for x in joined)))


def _forest(values: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: each linked value with the least value of its group."""
    parent = np.arange(len(values))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            high = parent[up]
            parent[x] = high
            x = high

    for i, j in pairs:
        while True:
            a, b = root(i), root(j)
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
    all_roots = root(np.arange(len(values)))
    linked = np.flatnonzero(all_roots != np.arange(len(values)))
    return values[linked], values[all_roots[linked]]


def _masks(bits: int, budget: int) -> list[int]:
    """All numbers of so many bits with at most ``budget`` ones."""
    return sorted(sum(1 << k for k in c) for n in range(budget + 1) for c in itertools.combinations(range(bits), n))


def _bits(value: Column, order: list[int]) -> Column:
    """The bits of a fingerprint at the places of ``order``, the first one highest."""
    own = (F.shiftleft(F.shiftrightunsigned(value, k).bitwiseAND(F.lit(1).cast("long")), len(order) - 1 - i) for i, k in enumerate(order))
    return sum(own, F.lit(0).cast("long"))


def links(distinct: DataFrame, budget: int, tile: int = 1 << 19) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (column fp) which chains of links connect.

    Bits go from the evenest down, so that the trie branches early. Fingerprints are dealt by their
    first bits; a tile holds two such prefixes at ``budget`` or fewer differing bits, and gives a
    spanning forest of its links. The number of prefixes follows the number of fingerprints, so
    that a tile stays near ``tile`` of them. A prefix with more than twice as many, as of pages from
    one template, is dealt by further bits in the same way; those that differ from the prefix of the
    other side use up the budget first.
    """
    ones = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1).cast("long"))) for k in range(64)]
    n, *set_bits = distinct.agg(F.count("*"), *ones).first()
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    order = sorted(range(64), key=lambda k: abs(2 * set_bits[k] - n))
    deep = max(6, math.ceil(math.log2(n / tile)))
    dealt = distinct.select("fp", _bits(F.col("fp"), order[:deep]).alias("p"))
    # at most n / (2 * tile) rows
    crowded = {r["p"]: min(20, math.ceil(math.log2(r["n"] / tile))) for r in dealt.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * tile).collect()}
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(deep, budget)))
    spread = dealt.select("fp", "p", F.explode(masks).alias("m"))
    other = F.col("p").bitwiseXOR(F.col("m"))
    sub = sub_other = F.lit(0).cast("long")
    if crowded:
        more = spread.sparkSession.createDataFrame(list(crowded.items()), "c long, more int")
        a, b = (F.broadcast(more.select(F.col("c").alias(f"c{k}"), F.col("more").alias(f"more{k}"))) for k in (0, 1))  # bounded as above
        spread = spread.join(a, F.col("p") == F.col("c0"), "left").join(b, other == F.col("c1"), "left")
        spread = spread.select("fp", "p", "m", F.coalesce(F.greatest("more0", "more1"), F.lit(0)).alias("more"))
        sizes = sorted(set(crowded.values()))
        own = F.lit(0).cast("long")
        within = F.array(F.lit(0).cast("long"))
        for k in sizes:
            own = F.when(F.col("more") == k, _bits(F.col("fp"), order[deep : deep + k])).otherwise(own)
            for left in range(budget + 1):
                some = F.array(*(F.lit(x).cast("long") for x in _masks(k, left)))
                within = F.when((F.col("more") == k) & (F.bit_count("m") == budget - left), some).otherwise(within)
        spread = spread.select("fp", "p", "m", own.alias("sub"), F.explode(within).alias("sub_m"))
        sub, sub_other = F.col("sub"), F.col("sub").bitwiseXOR(F.col("sub_m"))
    # of a pair of tiles' sides the lower (prefix, further bits) is first
    second = (F.col("p") > other) | ((F.col("p") == other) & (sub > sub_other))
    tiles = spread.select("fp", F.least("p", other).alias("low"), F.greatest("p", other).alias("high"), F.when(second, sub_other).otherwise(sub).alias("low_sub"), F.when(second, sub).otherwise(sub_other).alias("high_sub"), second.alias("second"))

    def join(table: pa.Table) -> pa.Table:
        values = table["fp"].to_numpy().view(np.uint64)
        keyed = _permuted(values, order)
        second = table["second"].to_numpy()
        low, high, low_sub, high_sub = (table[c][0].as_py() for c in ("low", "high", "low_sub", "high_sub"))
        if (low, low_sub) == (high, high_sub):
            at = np.argsort(keyed)
            a, b = _forest(values[at], trie_join(keyed[at], None, budget, 63 - deep))
        else:
            first, then = np.flatnonzero(~second), np.flatnonzero(second)
            first, then = first[np.argsort(keyed[first])], then[np.argsort(keyed[then])]
            both = np.concatenate((first, then))
            # the walk starts below the prefixes and meets the further bits again
            pairs = ((i, j + len(first)) for i, j in trie_join(keyed[first], keyed[then], budget, 63 - deep, (low ^ high).bit_count()))
            a, b = _forest(values[both], pairs)
        return pa.table([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return tiles.groupBy("low", "high", "low_sub", "high_sub").applyInArrow(join, "a long, b long")


def roots(distinct: DataFrame, budget: int, tile: int = 1 << 19) -> DataFrame:
    """(node, root) of every distinct fingerprint (column fp) that chains of links connect to another."""
    return stars(links(distinct, budget, tile))


def near_duplicates(docs: DataFrame, width: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id of every row: the smallest id that chains of links reach from it, itself included.

    Fingerprints link at ``budget`` or fewer differing bits, equal ones always; copies count once
    in the join, and links between different fingerprints are all kept. Null and empty texts have
    no words and fingerprint 0, which links like any other. Rows with a null id belong to their
    component, but an id is never null unless all of its component are. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, width, id_col, text_col))
    distinct = cut(own.groupBy("fp").agg(F.min("id").alias("least")))
    linked = roots(distinct, budget)
    held = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = held.groupBy("root").agg(F.min("least").alias("component_id"))
    named = held.select("fp", "root").join(classes, "root").select("fp", "component_id")
    return own.join(named, "fp").select("id", "fp", "component_id")
