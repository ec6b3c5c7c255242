"""Degrees, PageRank, components, shortest paths and breadth-first levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..runtime import BROADCAST_ROWS, cut, forget
from .components import stars
from .vertex import Message, VertexProgram

FAR = 1e9
DAMPING = 0.85


def degrees(graph: PropertyGraph) -> DataFrame:
    return graph.degrees()


def _shared(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Vertices with their out-degrees (null for none) and edges with parallel ones merged, weight their number; one scan of the edges."""
    merged = cut(graph.edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    outs = merged.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_degree"))
    return graph.vertices.join(outs, "id", "left"), merged


def pagerank(graph: PropertyGraph, iterations: int = 10) -> DataFrame:
    """(id, result): r = 0.15 + 0.85 * sum of r(u) / out_degree(u), from 1, without normalisation; what reaches a vertex without out-edges is lost.

    Parallel edges count as often as they are given.
    """
    vertices, edges = _shared(graph)
    program = VertexProgram(
        {"result": F.lit(1.0)},
        [Message("dst", F.col("src_result") / F.col("src_out_degree") * F.col("weight"))],
        {"result": F.lit(1 - DAMPING) + F.lit(DAMPING) * F.coalesce("acc", F.lit(0.0))},
        own_state=False,
    )
    return program.run(PropertyGraph(vertices, edges), iterations)


def pagerank_normalized(graph: PropertyGraph, iterations: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """(id, result): ranks that sum to 1; what reaches a vertex without out-edges goes to all alike.

    After ``iterations``, or with ``tol`` after the first that changes the ranks by less than
    ``tol`` times their number in all. Without vertices there are no ranks.
    """
    vertices, edges = _shared(graph)
    vertices = cut(vertices)
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(1.0).alias("result"))
    few = n <= BROADCAST_ROWS
    edges = (edges if few else edges.repartition("src")).persist()
    state = held = cut(vertices.withColumn("result", F.lit(1.0 / n)))
    try:
        for _ in range(iterations):
            lost = state.filter("out_degree is null").agg(F.sum("result")).first()[0] or 0.0  # one number
            own = state.select(F.col("id").alias("src"), (F.col("result") / F.col("out_degree")).alias("each"))
            got = edges.join(F.broadcast(own) if few else own, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("each") * F.col("weight")).alias("acc"))
            rank = F.lit((1 - DAMPING + DAMPING * lost) / n) + F.lit(DAMPING) * F.coalesce("acc", F.lit(0.0))
            now = cut(state.join(got, "id", "left").select("id", "out_degree", rank.alias("result"), F.col("result").alias("before")))
            moved = now.agg(F.sum(F.abs(F.col("result") - F.col("before")))).first()[0]
            forget(held)
            held, state = now, now.drop("before")
            if tol is not None and moved < n * tol:
                break
        return state.select("id", "result")
    finally:
        edges.unpersist()


def connected_components(graph: PropertyGraph, iterations: int | None = None) -> DataFrame:
    """(id, label): the smallest id within so many steps in either direction, or with None in the whole component.

    The whole component is found by star contraction, in rounds that grow with the logarithm of its size.
    """
    if iterations is None:
        roots = stars(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("id"), "root")
        return graph.vertices.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("label"))
    edges = graph.edges.filter("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct()
    program = VertexProgram(
        {"label": F.col("id")}, [Message("dst", F.col("src_label"), "min")],
        {"label": F.least("label", F.coalesce("acc", "label"))}, F.col("_label") < F.col("label"),
    )
    return program.run(PropertyGraph(graph.vertices, edges), iterations)


def shortest_path(graph: PropertyGraph, source: int = 0, iterations: int | None = None) -> DataFrame:
    """(id, distance) along edges, 1e9 where there is no way; with a number of iterations, over so many edges at most.

    A negative weight raises. Of parallel edges the lightest counts.
    """
    checked = F.when(F.col("weight") >= 0, F.col("weight")).otherwise(F.raise_error(F.lit("a weight is negative")).cast("double"))
    edges = graph.edges.groupBy("src", "dst").agg(F.min(checked).alias("weight"))
    program = VertexProgram(
        {"distance": F.when(F.col("id") == source, 0.0).otherwise(FAR)},
        [Message("dst", F.when(F.col("src_distance") < FAR, F.col("src_distance") + F.col("weight")), "min")],
        {"distance": F.least("distance", F.coalesce("acc", "distance"))}, F.col("_distance") < F.col("distance"),
    )
    return program.run(PropertyGraph(graph.vertices, edges), iterations)


def bfs(graph: PropertyGraph, source: int = 0, iterations: int | None = None) -> DataFrame:
    """(id, level): edges on the shortest way from the source, 1000000000 where there is none."""
    unit = PropertyGraph(graph.vertices, graph.edges.withColumn("weight", F.lit(1.0)))
    return shortest_path(unit, source, iterations).select("id", F.col("distance").cast("long").alias("level"))


#: Applications by name, of a graph, a number of iterations (None: to the fixpoint) and a source; all give id and one value.
APPLICATIONS = {
    "pagerank": lambda g, n, source: pagerank(g, 10 if n is None else n).select("id", F.col("result").alias("value")),
    "pagerank_normalized": lambda g, n, source: pagerank_normalized(g, 100 if n is None else n).select("id", F.col("result").alias("value")),
    "components": lambda g, n, source: connected_components(g, n).select("id", F.col("label").cast("double").alias("value")),
    "shortest_path": lambda g, n, source: shortest_path(g, source, n).select("id", F.col("distance").alias("value")),
    "bfs": lambda g, n, source: bfs(g, source, n).select("id", F.col("level").cast("double").alias("value")),
    "degree": lambda g, n, source: degrees(g).select("id", F.col("degree").cast("double").alias("value")),
}
