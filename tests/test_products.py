"""Products whose cells stay in their task: against plain code, and without shuffles that grow with the result."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill import catalogue
from tidemill.operators import matrix

CELL = "i long, j long, v double"


def plain_product(a, b):
    found = {}
    for i, k, x in a:
        for l, j, y in b:
            if k == l:
                own = found.setdefault((i, j), [])
                if x is not None and y is not None:
                    own.append(x * y)
    return {at: sum(own) if own else None for at, own in found.items()}


def plan_of(df):
    """The plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.toString()


def test_dense_cells_are_multiplied_in_packs(spark):
    values = np.arange(60 * 16, dtype=float).reshape(60, 16) % 7 - 3
    own = matrix.cells(spark.createDataFrame([(i * 10**12, r.tolist()) for i, r in enumerate(values)], "row_id long, values array<double>"))
    got = matrix.multiply(own, matrix.transpose(own))
    want = values @ values.T
    assert {(r.i, r.j): r.v for r in got.collect()} == {(i * 10**12, j * 10**12): want[i, j] for i in range(60) for j in range(60)}
    assert "CartesianProduct" in plan_of(got) and "SortMergeJoin" not in plan_of(got)  # no product leaves its task


@pytest.mark.parametrize("rows, inner", [(40, 12), (700, 2)])
def test_cells_with_gaps_nulls_and_copies_as_in_sql(spark, rows, inner):
    chance = random.Random(rows)
    number = lambda: chance.choice([None, 0.0, 1.0, -2.0, 3.0])
    a = [(i, k, number()) for i in range(rows) for k in range(inner) if chance.random() < 0.8]
    b = [(k, j, number()) for k in range(1, inner + 1) for j in range(40) if chance.random() < 0.8]
    a += a[:25]
    got = matrix.multiply(spark.createDataFrame(a, CELL), spark.createDataFrame(b, CELL))
    assert "CartesianProduct" in plan_of(got)
    found = got.collect()
    assert len(found) == len({(r.i, r.j) for r in found}) and {(r.i, r.j): r.v for r in found} == plain_product(a, b)


def test_sparse_cells_stay_a_join(spark):
    a = [(i, i * 3 % 50, float(i)) for i in range(50)] + [(None, 3, 2.0)]
    b = [(i, i + 1, 1.0) for i in range(50)]
    got = matrix.multiply(spark.createDataFrame(a, CELL), spark.createDataFrame(b, CELL))
    assert {(r.i, r.j): r.v for r in got.collect()} == plain_product(a, b) and "CartesianProduct" not in plan_of(got)
    assert matrix.multiply(spark.createDataFrame([], CELL), spark.createDataFrame(b, CELL)).count() == 0


def test_rounding_is_that_of_sql(spark):
    v = [0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, -1 / 3, 0.0, -1e-9, 4e9 + 0.1234565, 1e300, -1e300, math.inf, None, math.nan]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", catalogue._six(F.col("v")).alias("own"), (F.round("v", 6) + 0.0).alias("want")).collect()
    assert all(r.own == r.want or r.want is not None and math.isnan(r.want) and math.isnan(r.own) for r in rows), rows


def test_two_products_side_by_side(spark):
    values = np.arange(90 * 8, dtype=float).reshape(90, 8) % 5 - 2
    ids = [i if i < 80 else i * 10**12 for i in range(90)]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, values)], "row_id long, values array<double>")
    own = matrix.cells(rows)
    lacking = own.filter("i <> 7").unionByName(spark.createDataFrame([(500, 0, 2.0)], CELL))
    both = matrix.side_by_side(rows, rows, lambda a, b: a @ b.T, lacking, matrix.transpose(own), 10)
    found = both.collect()
    got, dense = {(r.i, r.j): (r.left_v, r.right_v) for r in found}, values @ values.T
    want = {(i, j): (dense[m, n], None if i == 7 else dense[m, n]) for m, i in enumerate(ids) for n, j in enumerate(ids)} | {(500, j): (None, 2.0 * values[n, 0]) for n, j in enumerate(ids)}
    assert len(found) == len(got) and got == want


def test_matrix_equal_shuffles_no_cell(spark):
    rows = catalogue.QUERIES["matrix_equal"](spark, "/root/testdata/sf0.001")
    assert "CartesianProduct" in plan_of(rows) and "HashAggregate(keys=[i#" not in plan_of(rows)


def shuffled(spark, df):
    """Records that the exchanges of a plan wrote, once it ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
        if kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        metric = plan.metrics().get("shuffleRecordsWritten") if kind == "ShuffleExchangeExec" else None
        found += metric.get().value() if metric is not None and metric.isDefined() else 0
    return found


@pytest.mark.parametrize("size, mirrored", [(37, False), (100, True), (512, True)])
def test_blocks_shuffle_each_row_once_for_a_side(spark, size, mirrored):
    values = np.arange(600 * 4, dtype=float).reshape(600, 4) % 11 - 5
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(values)], "row_id long, values array<double>")
    got = matrix.block_product(rows, rows, lambda a, b: a @ b.T, size, mirrored)
    own = {(r.i, r.j): r.v for r in got.collect()}
    assert got.count() == 600 * 600 == len(own) and all(own[i, j] == v for (i, j), v in np.ndenumerate(values @ values.T))
    assert 0 < shuffled(spark, got) <= 2 * 600


def test_rows_of_different_lengths_raise(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0, 4.0])], "row_id long, values array<double>")
    with pytest.raises(Exception, match="one length"):
        matrix.gram(rows).collect()


def test_gram_upper_mirrored_shuffles_its_input(spark):
    got = catalogue.QUERIES["gram_upper_mirrored"](spark, "/root/testdata/sf0.001")
    assert 0 < shuffled(spark, got) <= 2 * 500


def test_gram_full_shuffles_its_input(spark):
    wide = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(1500)], "row_id long, values array<double>")
    got = catalogue._rounded(matrix.gram(wide))
    assert 0 < shuffled(spark, got) <= 2 * 1500


def bytes_a_cell(df, folder):
    """Of its Parquet files, which have Spark's own codec."""
    df.write.option("compression", "snappy").parquet(str(folder))
    files = [pq.ParquetFile(f).metadata for f in folder.glob("*.parquet")]
    return sum(m.row_group(k).column(c).total_compressed_size for m in files for k in range(m.num_row_groups) for c in range(3)) / sum(m.num_rows for m in files)


def test_gram_upper_mirrored_takes_little_more_than_one_order(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_upper_mirrored"](spark, "/root/testdata/sf0.1"), tmp_path / "cells") < 6


def test_gram_full_takes_little_more_than_one_order(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_full"](spark, "/root/testdata/sf0.1"), tmp_path / "cells") < 6


@pytest.mark.parametrize("rows, size", [(70, 33), (150, 100)])
def test_mirrored_runs_have_each_cell_once(spark, rows, size):
    values = np.arange(rows * 3, dtype=float).reshape(rows, 3) % 13 - 6
    got = matrix.block_product(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(values)], "row_id long, values array<double>").coalesce(1), None, lambda a, b: a @ b.T, size, mirrored=True)
    found = [(r.i, r.j, r.v) for r in got.collect()]
    assert sorted(found) == [(i, j, v) for (i, j), v in np.ndenumerate(values @ values.T)]


def test_whole_rows_shuffle_no_cell(spark, monkeypatch):
    values = np.arange(300 * 4, dtype=float).reshape(300, 4) % 11 - 5
    ids = [i if i < 290 else i * 10**12 for i in range(300)]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, values)], "row_id long, values array<double>")
    for whole, size in ((1 << 23, 512), (3000, 64)):  # all rows of a side at once, and 10
        monkeypatch.setattr(matrix, "WHOLE", whole)
        got = matrix.product_rows(rows, rows, lambda a, b: a @ b.T, size)
        found = got.collect()
        assert len(found) == 300 and {r.row_id: r["values"] for r in found} == dict(zip(ids, (values @ values.T).tolist()))
    assert 0 < shuffled(spark, catalogue.QUERIES["gram_rows"](spark, "/root/testdata/sf0.001")) <= 2 * 500


@pytest.mark.parametrize("share", [1, 0.8])
def test_products_by_coordinates_in_both_orders(spark, monkeypatch, share):
    monkeypatch.setattr(matrix, "ROWS", 100)
    chance = random.Random(5)
    a = [(i * 10**10, k, float(chance.randrange(-3, 4))) for i in range(330) for k in range(5) if chance.random() < share]
    b = [(k, i, chance.choice([v, -1.0, None] if share < 1 else [v, 2.0])) for i, k, v in a]
    got = matrix.multiply(spark.createDataFrame(a, CELL), spark.createDataFrame(b, CELL))
    assert "CartesianProduct" in plan_of(got)
    found = got.collect()
    want = plain_product(a, b)
    assert len(found) == len(want) and {(r.i, r.j): r.v for r in found} == want


def test_gram_coo_takes_little_more_than_one_order(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_coo"](spark, "/root/testdata/sf0.1"), tmp_path / "cells") < 6


def test_gram_coo_has_its_numbers_in_dictionaries(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_coo"](spark, "/root/testdata/sf0.1").coalesce(1), tmp_path / "cells") < 3


def test_sessions_keep_their_own_dictionaries(spark):
    other = spark.newSession()
    other.conf.set(catalogue.DICTIONARY, "4096")
    catalogue.QUERIES["gram_coo"](other, "/root/testdata/sf0.001")
    assert other.conf.get(catalogue.DICTIONARY) == "4096"


@pytest.mark.parametrize("size", [37, 512])
def test_a_table_with_itself_has_each_cell_once_without_symmetry(spark, size):
    values = np.arange(1100 * 3, dtype=float).reshape(1100, 3) % 13 - 6
    ids = [i if i < 1090 else i * 10**12 for i in range(1100)]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, values)], "row_id long, values array<double>")
    found = matrix.block_product(rows, rows, lambda a, b: a @ b.T + 1000 * a[:, :1] - b[:, 2], size).collect()
    want = values @ values.T + 1000 * values[:, :1] - values[:, 2]
    assert len(found) == want.size and {(r.i, r.j): r.v for r in found} == {(ids[m], ids[n]): v for (m, n), v in np.ndenumerate(want)}


def test_gram_ragged_blocks_takes_little_more_than_one_order(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_ragged_blocks"](spark, "/root/testdata/sf0.1"), tmp_path / "cells") < 6


def test_gram_ragged_blocks_has_its_numbers_in_dictionaries(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_ragged_blocks"](spark, "/root/testdata/sf0.1").coalesce(1), tmp_path / "cells") < 3


def test_gram_upper_mirrored_has_its_numbers_in_dictionaries(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_upper_mirrored"](spark, "/root/testdata/sf0.1").coalesce(1), tmp_path / "cells") < 3


def test_gram_full_has_its_numbers_in_dictionaries(spark, tmp_path):
    assert bytes_a_cell(catalogue.QUERIES["gram_full"](spark, "/root/testdata/sf0.1").coalesce(1), tmp_path / "cells") < 3
