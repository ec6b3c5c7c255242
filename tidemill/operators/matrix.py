"""Dense matrices as rows (row_id, values), and their products in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ceil_div

CELLS, KINDS = "i long, j long, v double", (pa.int64(), pa.int64(), pa.float64())


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, row_id, values): contiguous row ranges."""
    return rows.select(F.expr(f"row_id div {size}").alias("block"), "row_id", "values")


#: Rows and numbers in a pack, packs in a partition, and cells in an Arrow batch, about; cells of one row that a pack may have; numbers of whole rows that a task holds.
ROWS, NUMBERS, PACKS, BATCH, MOST_IN_ROW, WHOLE = 512, 1 << 15, 8, 1 << 18, 1 << 20, 1 << 23
#: Cells of a row that stand before their mirrored ones: longer runs escape Snappy's search, shorter ones cost more for i and j.
RUN = 32


def _pack(rows: DataFrame, n: int) -> DataFrame:
    """A row for each p of about n: p, and the other columns of its rows. Partitions are read again for each pair with another side's."""
    p, *own = rows.columns
    return rows.repartition(min(n, max(12, ceil_div(n, PACKS))), p).groupBy(p).agg(F.collect_list(F.struct(*own)).alias("pack"))


def _opened(batches: Iterator[pa.RecordBatch], form: Callable[[pa.Array], object]) -> Iterator[tuple]:
    """For each row (a, a_pack, b, b_pack) both packs as ``form`` makes them, and whether a is b; the left one stays for rows in a row."""
    last, x = (), None
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for r in range(batch.num_rows):
            a, b = columns["a"][r].as_py(), columns["b"][r].as_py()
            if last != (a,):
                last, x = (a,), form(columns["a_pack"].slice(r, 1))
            yield x, form(columns["b_pack"].slice(r, 1)), a == b


def _row_packs(rows: DataFrame, size: int, name: str, beside: DataFrame | None = None, most: int = ROWS) -> DataFrame:
    """(name, name_pack): whole blocks of rows as (block, row_id, values); with ``beside`` also its rows whose id is in these blocks.

    Packs are runs of blocks; ids far apart share packs by a hash.
    """
    held, width = rows.agg(F.count("*"), F.max(F.size("values"))).first()
    k = max(1, min(most, NUMBERS // max(1, width or 0)) // size)
    n = ceil_div(held, size * k)
    run = lambda c: F.expr(f"pmod({c} div {size} div {k} + pmod(xxhash64({c} div {size} div {k} div {n}), {n}), {n})").alias(name)
    own = _pack(blocks(rows, size).select(run("row_id"), "block", "row_id", "values"), n)
    if beside is not None:
        own = own.join(_pack(beside.select(run("id"), "*"), n).withColumnRenamed("pack", "cells"), name, "full_outer").select(name, F.struct("pack", "cells").alias("pack"))
    return own.withColumnRenamed("pack", f"{name}_pack")


class _Rows:
    """Rows (block, row_id, values) of a pack, as dense parts (block, ids, numbers)."""

    def __init__(self, block: pa.Array, ids: pa.Array, values: pa.Array):
        block, ids = block.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        if values.null_count or len(set(values.value_lengths().to_numpy())) > 1:
            raise ValueError("rows of a matrix have one length")
        order = np.lexsort((ids, block))
        dense = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))
        block, ids = block[order], ids[order]
        ends = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(ids)]
        self.parts = [(block[s], ids[s:e], dense[s:e]) for s, e in zip(ends, ends[1:]) if e > s]

    def ids(self) -> np.ndarray:
        return np.concatenate([ids for _, ids, _ in self.parts] or [np.zeros(0, np.int64)])


def _dense(x: _Rows, y: _Rows, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], mirrored: bool = False) -> np.ndarray:
    """The kernel's numbers of each pair of blocks, as one tile; ``mirrored``: x and y are the same rows, and of two blocks one order is computed."""
    found = np.empty([sum(len(ids) for _, ids, _ in side.parts) for side in (x, y)])
    s = 0
    for p, _, left in x.parts:
        e = 0
        for q, _, right in y.parts:
            if not (mirrored and p > q):
                found[s : s + len(left), e : e + len(right)] = kernel(left, right)
                if mirrored and p < q:
                    found[e : e + len(right), s : s + len(left)] = found[s : s + len(left), e : e + len(right)].T
            e += len(right)
        s += len(left)
    return found


Tile = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def _halved(ids: np.ndarray, v: np.ndarray) -> Iterator[Tile]:
    """A tile that has the same rows as columns, as tiles i, j, v and the numbers of their mirrored cells."""
    if len(ids) <= RUN:
        yield ids, ids, v, None
    else:
        h = ceil_div(len(ids), 2 * RUN) * RUN
        yield ids[:h], ids[h:], v[:h, h:], v[h:, :h].T
        yield from _halved(ids[:h], v[:h, :h])
        yield from _halved(ids[h:], v[h:, h:])


class _Cells:
    """Cells (id, k, v) of a pack, by k."""

    def __init__(self, ids: pa.Array, k: pa.Array, v: pa.Array):
        own, inner = ids.to_numpy(zero_copy_only=False), k.to_numpy(zero_copy_only=False)
        order = np.lexsort((own, inner))
        own, inner = own[order], inner[order]
        self.ids, self.at = np.unique(own, return_inverse=True)
        self.valid = np.asarray(v.is_valid())[order]
        self.v = v.fill_null(0.0).to_numpy(zero_copy_only=False)[order]
        self.k, start = np.unique(inner, return_index=True)
        self.start = np.append(start, len(inner))
        self.plain = bool(self.valid.all()) and not np.any((own[1:] == own[:-1]) & (inner[1:] == inner[:-1]))


def _summed(x: _Cells, y: _Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """i, j, v and a mask of nulls of cells that have a product: for each k its outer product, added up. As in SQL a null adds nothing."""
    shape = len(x.ids), len(y.ids)
    total, term, everywhere = np.zeros(shape), np.empty(shape), False
    hit, real = np.zeros(shape, bool), np.zeros(shape, bool)
    _, of_x, of_y = np.intersect1d(x.k, y.k, assume_unique=True, return_indices=True)
    with np.errstate(all="ignore"):
        for m, n in zip(of_x, of_y):
            s, t = slice(x.start[m], x.start[m + 1]), slice(y.start[n], y.start[n + 1])
            if x.plain and y.plain and (s.stop - s.start, t.stop - t.start) == shape:
                np.multiply(x.v[s, None], y.v[t], out=term)
                total += term
                everywhere = True
                continue
            hit[np.ix_(x.at[s], y.at[t])] = True
            own, other = x.valid[s], y.valid[t]
            at = np.ix_(x.at[s][own], y.at[t][other])
            np.add.at(total, at, np.multiply.outer(x.v[s][own], y.v[t][other]))
            real[at] = True
    if everywhere:
        return np.repeat(x.ids, shape[1]), np.tile(y.ids, shape[0]), total.ravel(), None
    i, j = np.nonzero(hit)
    return x.ids[i], y.ids[j], total[i, j], ~real[i, j]


def _sliced(i: np.ndarray, j: np.ndarray, v: np.ndarray, null: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(i), BATCH):
        part = slice(s, s + BATCH)
        yield pa.RecordBatch.from_arrays([pa.array(i[part]), pa.array(j[part]), pa.array(v[part], mask=None if null is None else null[part])], names=["i", "j", "v"])


def _runs(i: np.ndarray, j: np.ndarray, v: np.ndarray, w: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns i, j, v of a tile's cells and, by ``w``, of the mirrored ones.

    A run of a row's cells has its mirrored cells right behind it: where these are the same numbers
    again, they are within the reach of a file's compression, so that what is written of them is small.
    """
    if w is None:
        yield np.repeat(i, len(j)), np.tile(j, len(i)), v.ravel()
        return
    whole = len(j) - len(j) % RUN
    for s, e, width in ((0, whole, RUN), (whole, len(j), len(j) - whole)):
        if e > s:
            shape = (e - s) // width, len(i), 2, width
            one, two, number = np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape)
            one[:, :, 0], one[:, :, 1] = i[:, None], j[s:e].reshape(-1, 1, width)
            two[:, :, 0], two[:, :, 1] = one[:, :, 1], one[:, :, 0]
            for k, own in enumerate((v, w)):
                number[:, :, k] = own[:, s:e].reshape(len(i), -1, width).swapaxes(0, 1)
            yield one.ravel(), two.ravel(), number.ravel()


def _listed(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
    """Cells of tiles, in batches of about BATCH however large tiles are."""
    held, n = [], 0
    for i, j, v, w in tiles:
        step = max(1, BATCH // max(1, len(j)))
        for s in range(0, len(i), step):
            for run in _runs(i[s : s + step], j, v[s : s + step], None if w is None else w[s : s + step]):
                held.append(run)
                n += len(run[0])
            if n >= BATCH // 2:
                yield from _sliced(*(c[0] if len(c) == 1 else np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
    if held:
        yield from _sliced(*(np.concatenate(c) for c in zip(*held)))


def block_pairs(spark, parts: int) -> DataFrame:
    """All ordered pairs of blocks, equal ones too."""
    return spark.range(parts * parts).select(F.expr(f"id div {parts}").alias("a"), (F.col("id") % parts).alias("b"))


def block_product(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, mirrored: bool = False) -> DataFrame:
    """(i, j, v): kernel(A, B) of each block A of left rows and B of right rows, as cells.

    Each side is shuffled once, into packs of blocks, and a task reads a partition of packs of each side,
    so that no row is copied for the blocks it meets; only blocks that have rows are paired, whatever
    the ids. Of ``left`` with itself (the same table) a task makes both orders of two packs, and cells
    stand in runs beside their mirrored ones, so that files of a symmetric product take little more than
    one order. ``mirrored`` is for a kernel and sides that are symmetric: only one order is computed.
    """
    own = mirrored or right is left
    a, b = _row_packs(left, size, "a"), _row_packs(left if own else right, size, "b")
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("a") <= F.col("b")) if own else a.hint("shuffle_replicate_nl").crossJoin(b)

    def tiles(x: _Rows, y: _Rows, same: bool) -> Iterator[Tile]:
        i, j = x.ids(), y.ids()
        v = _dense(x, y, kernel, mirrored and same)
        if own and same:
            yield from _halved(i, v)
        else:
            yield i, j, v, None if not own else v if mirrored else _dense(y, x, kernel).T

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _listed(tile for x, y, same in _opened(batches, lambda pack: _Rows(*pack.flatten().flatten())) for tile in tiles(x, y, same))

    return pairs.mapInArrow(product, CELLS)


def gram(rows: DataFrame, size: int = 512) -> DataFrame:
    """Cells of A times its transpose."""
    return block_product(rows, rows, lambda a, b: a @ b.T, size, mirrored=True)


def product_rows(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = 512) -> DataFrame:
    """(row_id, values): the rows of ``block_product``, whole and in the order of right ids, without a shuffle of cells.

    Each task reads all packs of the right side for each of its packs of left rows, which has as few rows
    as keep its results at about ``WHOLE`` numbers; so a task holds the right side and these.
    """
    n, most = right.count(), max(1, size)
    size = max(1, min(most, WHOLE // max(1, n)))
    a = _row_packs(left, size, "a", most=size)
    b = _row_packs(right, most, "b").coalesce(1)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x, ids, found = None, None, [], []

        def whole() -> Iterator[pa.RecordBatch]:
            if not found:
                return
            order = np.argsort(np.concatenate(ids), kind="stable")
            own = np.concatenate([i for _, i, _ in x.parts])
            step = max(1, BATCH // len(order))
            for s in range(0, len(own), step):
                values = np.concatenate([f[s : s + step] for f in found], axis=1)[:, order]
                ends = pa.array(np.arange(0, values.size + 1, len(order)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(own[s : s + step]), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["row_id", "values"])

        for now, y, _ in _opened(batches, lambda pack: _Rows(*pack.flatten().flatten())):
            if now is not last:
                yield from whole()
                last = x = now
                ids, found = [], []
            for _, j, others in y.parts:
                ids.append(j)
                found.append(np.concatenate([np.asarray(kernel(rows, others), np.float64) for _, _, rows in x.parts]))
        yield from whole()

    return a.hint("shuffle_replicate_nl").crossJoin(b).mapInArrow(product, "row_id long, values array<double>")


def cells(rows: DataFrame) -> DataFrame:
    """Coordinates: (i, j, v)."""
    return rows.select(F.col("row_id").alias("i"), F.posexplode("values").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def gather_rows(own: DataFrame) -> DataFrame:
    return own.groupBy(F.col("i").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("values"))


def transpose(own: DataFrame) -> DataFrame:
    return own.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of A times B, from cells of both: the sum of products over the inner index.

    Where an inner index has many cells on both sides, cells are packed by rows of A and columns of B,
    and a task sums a pack of rows times one of columns, so that products are never shuffled.
    Otherwise, and for cells without a place or rows that no pack holds, it is a join and a sum. Both
    sides are read some times to count; ``cut`` them first where they are dear.
    """
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    joined = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    shapes = [side.groupBy(own).count().agg(F.count("*"), F.sum("count"), F.max("count"), F.count_if(F.col(own).isNull())).first() for side, own in ((left, "i"), (right, "j"))]
    if any(not n or most > MOST_IN_ROW or nulls for n, _, most, nulls in shapes):
        return joined
    n_packs = [max(ceil_div(ids, ROWS), ceil_div(held, NUMBERS)) for ids, held, _, _ in shapes]
    inner = left.groupBy("k").agg(F.count("*").alias("m")).join(right.groupBy("k").agg(F.count("*").alias("n")), "k")
    times = lambda x, y: F.coalesce(F.sum(x.cast("double") * y), F.lit(0.0))
    products, visits, *held = inner.agg(times(F.col("m"), F.col("n")), times(F.least("m", F.lit(n_packs[0])), F.least("n", F.lit(n_packs[1]))), F.sum("m"), F.sum("n")).first()
    if products < max(512 * visits, 4096 * n_packs[0] * n_packs[1]):
        return joined
    sides = []
    for side, own, value, (_, all_of, _, _), in_both in zip((left, right), "ij", "xy", shapes, held):
        side = side if in_both == all_of else side.join(inner.select("k"), "k", "left_semi")
        sides.append(lambda n, side=side, own=own, value=value: side.select(F.pmod(F.xxhash64(own), F.lit(n)).alias("p"), F.col(own).alias("id"), "k", F.col(value).alias("v")))
    if n_packs[0] == n_packs[1]:
        return _both_orders(*(side(n_packs[0]) for side in sides), n_packs[0])
    packs = [_pack(side(n), n).toDF(name, f"{name}_pack") for side, n, name in zip(sides, n_packs, "ab")]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, _ in _opened(batches, lambda pack: _Cells(*pack.flatten().flatten())):
            yield from _sliced(*_summed(x, y))

    return packs[0].hint("shuffle_replicate_nl").crossJoin(packs[1]).mapInArrow(product, CELLS)


def _both_orders(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Cells of the product of left and right cells (p, id, k, v), where both have n packs p.

    A pack has the rows of A and the columns of B whose ids it is for, and a task makes A times B of two
    packs in both orders, so that in a square product cells stand in runs beside their mirrored ones, as
    in ``block_product``.
    """
    held = _pack(left.withColumn("right", F.lit(False)).unionByName(right.withColumn("right", F.lit(True))), n)
    a, b = (held.toDF(name, f"{name}_pack") for name in "ab")

    def opened(pack: pa.Array) -> list[_Cells]:
        *columns, of_right = pack.flatten().flatten()
        return [_Cells(*(c.filter(at) for c in columns)) for at in (pc.invert(of_right), of_right)]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x, right_x), (y, right_y), same in _opened(batches, opened):
            found = [_summed(x, right_y)] if same else [_summed(x, right_y), _summed(y, right_x)]
            square = np.array_equal(x.ids, right_x.ids) and np.array_equal(y.ids, right_y.ids)
            if square and all(null is None and len(v) == len(x.ids) * len(y.ids) for _, _, v, null in found):
                v = found[0][2].reshape(len(x.ids), len(y.ids))
                yield from _listed(_halved(x.ids, v) if same else iter([(x.ids, y.ids, v, found[1][2].reshape(len(y.ids), len(x.ids)).T)]))
            else:
                for cells in found:
                    yield from _sliced(*cells)

    return a.hint("shuffle_replicate_nl").join(b, F.col("a") <= F.col("b")).mapInArrow(product, CELLS)


def side_by_side(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(i, j, left_v, right_v): cells of kernel's product of rows as in ``block_product`` beside those of ``multiply(a, b)``, with nulls where one side has none.

    Both are made tile by tile in the same task, each by its own method, so that the comparison of two
    large products shuffles no cell of either.
    """
    packs = []
    for rows, own, i, k, name in ((left, a, "i", "j", "a"), (right, b, "j", "i", "b")):
        packs.append(_row_packs(rows, size, name, own.select(F.col(i).alias("id"), F.col(k).alias("k"), "v")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x, own), (y, other), _ in _opened(batches, lambda pack: [form(*held.flatten().flatten()) for form, held in zip((_Rows, _Cells), pack.flatten())]):
            own_i, own_j, dense = x.ids(), y.ids(), _dense(x, y, kernel)
            one = [np.repeat(own_i, len(own_j)), np.tile(own_j, len(own_i)), dense.ravel()]
            *two, null = _summed(own, other)
            if np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]):
                both = pa.table([*one, pa.array(two[2], mask=null)], names=["i", "j", "left_v", "right_v"])
            else:
                one = pa.table([pa.array(c, kind) for c, kind in zip(one, KINDS)], names=["i", "j", "left_v"])
                two = pa.table([pa.array(two[0], KINDS[0]), pa.array(two[1], KINDS[1]), pa.array(two[2], KINDS[2], mask=null)], names=["i", "j", "right_v"])
                both = one.join(two, ["i", "j"], join_type="full outer").combine_chunks()
            yield from both.to_batches(max_chunksize=BATCH)

    return packs[0].hint("shuffle_replicate_nl").crossJoin(packs[1]).mapInArrow(compared, "i long, j long, left_v double, right_v double")


def cell(rows: DataFrame, i: int, j: int) -> float:
    """One cell; a place outside the matrix raises."""
    found = rows.filter(F.col("row_id") == i).select(F.try_element_at("values", F.lit(j + 1)).alias("v")).first() if j >= 0 else None
    if found is None or found["v"] is None:
        raise IndexError((i, j))
    return found["v"]
