"""Dense matrices as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import Stream


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, values) of a stream ``rows cols numbers...``; a wrong count of numbers raises, as does a token that is none."""
    stream = Stream.open(spark, path)
    if len(head := stream.head(2)) < 2:
        raise ValueError(f"{path} has no header")
    m, n = map(int, head)
    if (found := stream.total - 2) != m * n:
        raise ValueError(f"{path} names {m} x {n} numbers and has {found}")
    return stream.rows(max(1, n), 2)


def random_matrix(spark: SparkSession, m: int, n: int, seed: int = 0, low: int = 1, high: int = 100) -> DataFrame:
    cell = F.floor(F.rand(seed) * (high - low + 1)) + low
    cells = spark.range(m * n).select(F.expr(f"id div {n}").alias("row_id"), (F.col("id") % n).alias("j"), cell.cast("double").alias("v"))
    rows = cells.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    return rows.select("row_id", F.transform("c", lambda x: x["v"]).alias("values"))


def _number(x: Column, truncate: bool) -> Column:
    """Whole numbers without a point; ``truncate`` cuts decimals off."""
    return F.when(F.lit(truncate) | (x == F.floor(x)), x.cast("long").cast("string")).otherwise(x.cast("string"))


def to_lines(rows: DataFrame, truncate: bool = False) -> DataFrame:
    """(row_id, line): each row's numbers with single spaces."""
    return rows.select("row_id", F.concat_ws(" ", F.transform("values", lambda x: _number(x, truncate))).alias("line"))


def to_aligned_lines(rows: DataFrame, n_cols: int, truncate: bool = True) -> DataFrame:
    """(row_id, line): a heading of column numbers as row -1, and rows with their number, in columns as wide as the widest number and two places more."""
    texts = rows.select("row_id", F.transform("values", lambda x: _number(x, truncate)).alias("t"))
    width = (texts.agg(F.max(F.array_max(F.transform("t", F.length)))).first()[0] or 0) + 2
    pad = lambda x, n: F.lpad(x, F.greatest(F.lit(n), F.length(x)), " ")  # noqa: E731  wider ones stay whole
    line = F.concat(pad(F.col("row_id").cast("string"), width - 1), F.lit(": "), F.array_join(F.transform("t", lambda x: F.concat(pad(x, width), F.lit(" "))), ""))
    heading = " " * (width + 1) + "".join(f"{j:>{width - 1}}: " for j in range(n_cols))
    return rows.sparkSession.createDataFrame([(-1, heading)], "row_id long, line string").union(texts.select("row_id", line.alias("line")))


def write_matrix(rows: DataFrame, path: str, n_cols: int, truncate: bool = False, aligned: bool = False) -> None:
    """A header line and the rows in order, in one file, which takes one task, as the format has it; ``aligned`` as in ``to_aligned_lines``."""
    head = rows.sparkSession.createDataFrame([(-2, f"{rows.count()} {n_cols}")], "row_id long, line string")
    lines = to_aligned_lines(rows, n_cols, truncate) if aligned else to_lines(rows, truncate)
    head.union(lines).orderBy("row_id").coalesce(1).select("line").write.text(path)
