"""Declarative vertex programs: an initial state, messages along edges, and an apply step, iterated."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..runtime import BROADCAST_ROWS, cut, forget

CUT_EVERY = 2  # iterations of a program whose state is read twice in each, which doubles the plan
CUT_EVERY_LINEAR = 10
HEAVY = 1_000_000  # edges of one vertex from which they are dealt in parts


@dataclass
class Message:
    """What an edge sends to one of its ends (``to`` is src or dst), combined by ``agg``.

    ``value`` is a column over src, dst, weight and the states of the ends named in ``reads``, as
    ``src_<column>`` or ``dst_<column>``; ends that aren't read aren't joined. A null value is no message.
    """

    to: str
    value: Column
    agg: str = "sum"
    reads: tuple[str, ...] = ("src",)


@dataclass
class VertexProgram:
    """``init`` and ``apply`` give the state's columns; ``apply`` sees the state and ``acc``, null where nothing came.

    Columns of the vertices beside the id are fixed: all three see them. With ``own_state`` false,
    ``apply`` doesn't read the state. ``changed`` compares the old state with the new
    one, whose columns are ``_<column>``. Where a program has it and combines by min or max, only
    vertices that changed send.
    """

    init: dict[str, Column]
    messages: list[Message]
    apply: dict[str, Column]
    changed: Column | None = field(default=None)
    own_state: bool = True

    def run(self, graph: PropertyGraph, iterations: int | None = 10, limit: int = 10_000) -> DataFrame:
        """The state after so many iterations, or with None after the first that changes nothing (see ``changed``).

        States of at most ``BROADCAST_ROWS`` vertices, which are counted, go to the edges; beyond, edges
        are partitioned by the end that is read and stay so, those of heavy vertices in parts.
        """
        if iterations is None and self.changed is None:
            raise ValueError("a fixpoint needs the program's changed column")
        kinds = {m.agg for m in self.messages}
        if len(kinds) != 1:
            raise ValueError("the messages of a program share one aggregate")
        fixed = [c for c in graph.vertices.columns if c != "id"]
        vertices = cut(graph.vertices)
        few = vertices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        ends = {e for m in self.messages for e in m.reads}
        key = "src" if "src" in ends else "dst"
        edges, parts = (graph.edges.withColumn("_part", F.lit(0)), None) if few else dealt(graph.edges, key)
        edges = (edges if few else edges.repartition(key, "_part")).persist()
        state = vertices.select("id", *fixed, *(c.alias(n) for n, c in self.init.items()), F.lit(True).alias("_changed"))
        last = None
        every = CUT_EVERY if self.own_state else CUT_EVERY_LINEAR
        try:
            for turn in range(limit if iterations is None else iterations):
                state = self.step(state, edges, vertices, fixed, few, key, parts)
                if iterations is None or turn % every == every - 1:
                    state = cut(state)
                    if last is not None:
                        forget(last)
                    last = state
                if iterations is None and not state.filter("_changed").limit(1).count():
                    break
            else:
                if iterations is None:
                    raise RuntimeError(f"no fixpoint in {limit} iterations")
            return cut(state.select("id", *self.init))
        finally:
            edges.unpersist()

    def step(self, state: DataFrame, edges: DataFrame, vertices: DataFrame, fixed: list[str], few: bool, key: str, parts: DataFrame | None) -> DataFrame:
        mark = F.broadcast if few else lambda df: df  # the vertices are counted
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[self.messages[0].agg]
        senders = state.filter("_changed") if self.changed is not None and self.messages[0].agg in ("min", "max") else state
        sent = None
        for reads in dict.fromkeys(m.reads for m in self.messages):
            view = edges
            for end in reads:
                one_end = len(reads) == 1  # of two ends that are read, an unchanged one can matter to the other
                own = (senders if one_end else state).select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in [*fixed, *self.init]))
                if end == key and parts is not None:
                    own = own.join(parts, F.col(end) == F.col("_heavy"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_heavy", "_parts")
                    view = view.join(own, [end, "_part"])
                else:
                    view = view.join(mark(own), end)
            own = [F.struct(F.col(m.to).alias("id"), m.value.alias("m")) for m in self.messages if m.reads == reads]
            rows = view.select(F.explode(F.array(*own)).alias("s")).select("s.*") if len(own) > 1 else view.select(own[0].alias("s")).select("s.*")
            sent = rows if sent is None else sent.union(rows)
        got = sent.filter("m is not null").groupBy("id").agg(agg("m").alias("acc"))
        held = state.select("id", *fixed, *self.init) if self.own_state else vertices
        joined = held.join(mark(got), "id", "left")
        out = joined.select("*", *(c.alias(f"_{n}") for n, c in self.apply.items()))
        changed = self.changed if self.changed is not None else F.lit(True)
        return out.select("id", *fixed, *(F.col(f"_{n}").alias(n) for n in self.init), changed.alias("_changed"))


def dealt(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Edges with a part, 0 but for vertices of over ``HEAVY`` edges, and the numbers of parts of those.

    There are at most as many of them as edges divided by ``HEAVY``.
    """
    heavy = cut(edges.groupBy(F.col(key).alias("_heavy")).agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("_heavy", F.ceil(F.col("n") / HEAVY).cast("int").alias("_parts")))
    parts = F.broadcast(heavy)
    other = "dst" if key == "src" else "src"
    part = F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), F.lit(0)).cast("int")
    return edges.join(parts, F.col(key) == F.col("_heavy"), "left").withColumn("_part", part).drop("_heavy", "_parts"), parts


def fold(graph: PropertyGraph, state: DataFrame, gather, schema: str) -> DataFrame:
    """For gathers that no aggregate expresses: ``gather(pandas.DataFrame)`` over the triplets of each destination, in undefined order."""
    return graph.triplets(state).groupBy("dst").applyInPandas(gather, schema)
