"""Incremental degrees of a stream of edges, as a small addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over all edges so far, of a streaming or batch table with src and dst; write it in update or complete mode."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
