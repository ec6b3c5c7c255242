"""Edge lists and graphs built from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import PropertyGraph
from .streams import Stream

FAR_SUPPLIER = 1_000_000
# SQL of edges and vertices, the same in Spark and DuckDB.
EDGES = {
    "trade": "select o.o_custkey as src, l.l_suppkey + 1000000 as dst, cast(1.0 as double) as weight from orders o join lineitem l on o.o_orderkey = l.l_orderkey",
    "chain": "select src, dst, weight from (select o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst, o_totalprice as weight from orders) t where dst is not null",
    "users": "select src, dst, weight from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst, value as weight from events) t where dst is not null",
    "nation": "select cast(c.c_nationkey as bigint) as src, cast(s.s_nationkey as bigint) as dst, cast(1.0 as double) as weight from orders o join customer c on o.o_custkey = c.c_custkey join lineitem l on o.o_orderkey = l.l_orderkey join supplier s on l.l_suppkey = s.s_suppkey",
}
EDGES["trade2"] = f"select src, dst, weight from ({EDGES['trade']}) a union all select dst, src, weight from ({EDGES['trade']}) b"
VERTICES = {
    "trade": "select c_custkey as id from customer union all select s_suppkey + 1000000 as id from supplier",
    "chain": "select o_orderkey as id from orders",
    "users": "select distinct user_id as id from events",
    "nation": "select cast(n_nationkey as bigint) as id from nation",
}
VERTICES["trade2"] = VERTICES["trade"]
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


def from_tables(spark: SparkSession, sf_dir: str, name: str) -> PropertyGraph:
    """One of the named graphs over the tables of a folder."""
    for t in TABLES:
        if f" {t} " in f" {EDGES[name]} {VERTICES[name]} ":
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return PropertyGraph(spark.sql(VERTICES[name]), spark.sql(EDGES[name]))


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, num_vertices: int | None = None, on_bad_id: str = "fail") -> PropertyGraph:
    """A token stream ``V (src dst [weight])*``; the domain is 0..V-1, with isolated vertices.

    With ``num_vertices`` the stream has no leading V. An incomplete last edge is left out. Ids
    outside the domain raise, or are dropped with ``on_bad_id="drop"``; tokens that are no numbers raise.
    """
    if on_bad_id not in ("fail", "drop"):
        raise ValueError(f"on_bad_id is fail or drop, not {on_bad_id}")
    stream, skip = Stream.open(spark, path), 0 if num_vertices is not None else 1
    if num_vertices is None:
        if not (head := stream.head(1)):
            raise ValueError(f"{path} is empty")
        num_vertices = int(head[0])
    types = {"src": T.LongType(), "dst": T.LongType()} | ({"weight": T.DoubleType()} if weighted else {})
    rows = stream.records(types, skip)
    edges = rows if weighted else rows.withColumn("weight", F.lit(1.0))
    inside = F.col("src").between(0, num_vertices - 1) & F.col("dst").between(0, num_vertices - 1)
    if on_bad_id == "drop":
        edges = edges.filter(inside)
    else:
        edges = edges.filter(F.when(inside, True).otherwise(F.raise_error(F.lit(f"an edge has an id outside 0..{num_vertices - 1}")).cast("boolean")))
    return PropertyGraph(spark.range(num_vertices), edges)


def write_edge_list(graph: PropertyGraph, path: str, num_vertices: int, weighted: bool = False) -> None:
    """A folder of text files that ``read_edge_list`` reads: the number of vertices in the first, an edge a line in the others."""
    head = graph.edges.sparkSession.createDataFrame([(str(num_vertices),)], "value string").coalesce(1)
    columns = ["src", "dst", *(["weight"] if weighted else [])]
    head.union(graph.edges.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))).write.text(path)


def random_graph(spark: SparkSession, n: int, p: float = 0.5, seed: int = 0) -> PropertyGraph:
    """A directed graph in which each ordered pair of different vertices is an edge with chance p."""
    pairs = spark.range(n * n).select(F.expr(f"id div {n}").alias("src"), (F.col("id") % n).alias("dst"), F.rand(seed).alias("r"))
    return PropertyGraph(spark.range(n), pairs.filter(f"src <> dst and r < {p}").select("src", "dst", F.lit(1.0).alias("weight")))


def write_vertices(values: DataFrame, path: str, value: str, single: bool = False) -> None:
    """``id value`` lines in ascending id order; ``single`` makes one file, which takes one task, as the format has it."""
    lines = values.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), F.col(value).cast("string")).alias("value"))
    (lines.coalesce(1) if single else lines).write.text(path)
