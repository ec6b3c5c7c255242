"""Property graphs and their relational operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PropertyGraph:
    """vertices: id; edges: src, dst, weight. Edges repeat as often as they were given; vertices need no edge."""

    vertices: DataFrame
    edges: DataFrame

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))

    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree, degree of every vertex, from one pass over the edges; a self-loop counts once each way."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return self.vertices.join(sums, "id", "left").select("id", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("degree"))

    def counts(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(self.edges.agg(F.count("*").alias("n_edges")))  # one row each

    def bucket_grid(self, parts: int) -> DataFrame:
        """Edges for each ordered pair of vertex blocks (id modulo parts), empty pairs too."""
        block = lambda c: F.pmod(F.col(c), F.lit(parts)).cast("long")
        sizes = self.edges.groupBy(block("src").alias("src_block"), block("dst").alias("dst_block")).agg(F.count("*").alias("n_edges"))
        spark = self.edges.sparkSession
        grid = spark.range(parts * parts).select(F.expr(f"id div {parts}").alias("src_block"), (F.col("id") % parts).alias("dst_block"))
        return grid.join(sizes, ["src_block", "dst_block"], "left").select("src_block", "dst_block", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))

    def merged(self) -> DataFrame:
        """src, dst, n_edges, min_weight: parallel edges in one row."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("n_edges"), F.min("weight").alias("min_weight"))

    def transition(self) -> DataFrame:
        """src, dst, share: the part of a vertex's value that goes along its edges to another; both counts come from one exchange of the edges."""
        merged = self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
        outs = merged.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("out_degree"))
        return merged.join(outs, F.col("src") == F.col("id")).select("src", "dst", (F.col("n") / F.col("out_degree")).alias("share"))

    def triplets(self, state: DataFrame) -> DataFrame:
        """Edges with the state of both ends; state has id and value."""
        a, b = (state.select(F.col("id").alias(e), F.col("value").alias(f"{e}_value")) for e in ("src", "dst"))
        return self.edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", "src_value", "dst_value")

    def adjacency(self) -> DataFrame:
        """src and its targets in ascending order, repeats kept."""
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))

    def adjacency_cells(self) -> DataFrame:
        """src, dst, weight with one weight for each pair, the largest where edges are parallel."""
        return self.edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))

    def symmetric(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.union(self.edges.select(F.col("dst"), F.col("src"), "weight")))
