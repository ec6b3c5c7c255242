"""Session helpers: the shared folder, lineage cuts and file systems that only Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_A_FILE, LEAST_FILES = 50_000, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a checkpoint folder that was set by hand.

    Where there is none, a local master gets a folder of its own; on a cluster that is an error, since
    each executor would write to its own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not context.master.startswith("local") or context.master.startswith("local-cluster") and not named:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = named or "file://" + tempfile.mkdtemp(prefix="tidemill-")
        context.setCheckpointDir(named)
    return named or current.get()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, so that a lost executor loses nothing.

    Where there are known to be about ``rows`` narrow ones at most, they go to a file for each
    ``ROWS_A_FILE`` of them (and ``LEAST_FILES`` at least), however many partitions they come from.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(LEAST_FILES, ceil_div(rows, ROWS_A_FILE)))).checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder that Spark wrote, if it is there."""
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(context._jsc.hadoopConfiguration()).delete(own, True)


def forget(df: DataFrame) -> None:
    """Removes the files of a table that ``cut`` gave and that nothing will read again."""
    found = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if found.isDefined():
        delete(df.sparkSession, found.get())


BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that was cut, marked for a broadcast if it has at most so many rows; for narrow rows of a few numbers or ids.

    Beyond that a join shuffles, and Spark splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


HEAVY = 1_000_000


def lookup(rows: DataFrame, key: Column, table: DataFrame, table_key: str, n: str, most: int = 20_000, heavy: int | None = None) -> DataFrame:
    """Each row with the columns of its key's row in a table that was cut and has a row for each key, a null one too.

    A table of at most ``most`` rows goes to the rows. Of a larger one only keys of over ``heavy`` rows
    (column ``n`` has their number) do, of which there are at most as many as rows divided by it; the
    others are joined by shuffling, and no task gets a key of more rows than that. ``n`` isn't returned.
    """
    heavy = HEAVY if heavy is None else heavy
    same = key.eqNullSafe(F.col(table_key))
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table.drop(n)), same)
    large = F.broadcast(table.filter(F.col(n) > heavy).drop(n))
    light = rows.join(large, same, "left_anti").join(table.filter(F.col(n) <= heavy).drop(n).hint("shuffle_merge"), same)
    return rows.join(large, same).select(light.columns).union(light)


def ceil_div(n: int, size: int) -> int:
    return max(1, -(-int(n) // int(size)))
