import random

import pytest
from pyspark.sql import types as T

from tidemill.plans import algorithms as A
from tidemill.plans import vertex
from tidemill.plans.components import stars
from tidemill.plans.vertex import fold
from tidemill.sources.graphs import random_graph, read_edge_list, write_vertices
from tidemill.sources.streams import Stream

STAR, CYCLE, DAG = "3\n0 1\n0 2", "3\n0 1\n1 2\n2 0\n", "6\n0 1\n0 2\n1 3\n2 3\n4 3\n5 3"


def graph(spark, tmp_path, text, **options):
    p = tmp_path / "g.txt"
    p.write_text(text)
    return read_edge_list(spark, str(p), **options)


def values(df):
    return [round(r[1], 6) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("text", "n", "want"), [
    (STAR, 1, [0.15, 0.575, 0.575]), (STAR, 10, [0.15, 0.21375, 0.21375]), (CYCLE, 2, [1, 1, 1]), (DAG, 0, [1] * 6),
    (DAG, 1, [0.15, 0.575, 0.575, 3.55, 0.15, 0.15]), (DAG, 10, [0.15, 0.21375, 0.21375, 0.768375, 0.15, 0.15]),
])
def test_pagerank(spark, tmp_path, text, n, want):
    assert values(A.pagerank(graph(spark, tmp_path, text), n)) == want


@pytest.mark.parametrize(("n", "want"), [(0, [0, 1, 2, 3, 4, 5]), (1, [0, 0, 0, 1, 3, 3]), (2, [0, 0, 0, 0, 1, 1]), (None, [0] * 6)])
def test_components(spark, tmp_path, n, want):
    assert values(A.connected_components(graph(spark, tmp_path, DAG), n)) == want


@pytest.mark.parametrize(("source", "want"), [(0, [0, 1, 1, 2, 1e9, 1e9]), (1, [1e9, 0, 1e9, 1, 1e9, 1e9])])
def test_shortest_path(spark, tmp_path, source, want):
    g = graph(spark, tmp_path, DAG)
    assert values(A.shortest_path(g, source)) == want
    assert values(A.bfs(g, source)) == want


def test_weights_repeats_loops_and_isolated_ids(spark, tmp_path):
    g = graph(spark, tmp_path, "5\t0 1 9  0 2 1\n2 1 2 0 0 5 0 1\n9", weighted=True)
    assert values(A.shortest_path(g, 0)) == [0, 3, 1, 1e9, 1e9]
    assert [tuple(r) for r in g.degrees().orderBy("id").collect()] == [(0, 1, 4, 5), (1, 3, 0, 3), (2, 1, 1, 2), (3, 0, 0, 0), (4, 0, 0, 0)]
    assert {(r.src_block, r.dst_block): r.n_edges for r in g.bucket_grid(2).collect()} == {(0, 0): 2, (0, 1): 3, (1, 0): 0, (1, 1): 0}


def test_bad_ids(spark, tmp_path):
    with pytest.raises(Exception, match="outside"):
        graph(spark, tmp_path, "2\n0 1\n0 5").edges.collect()
    assert graph(spark, tmp_path, "2\n0 1\n0 5", on_bad_id="drop").edges.count() == 1
    assert graph(spark, tmp_path, "0 1\n1 0", num_vertices=2).edges.count() == 2


def test_negative_weights_raise(spark, tmp_path):
    with pytest.raises(Exception, match="negative"):
        A.shortest_path(graph(spark, tmp_path, "2\n0 1 -1", weighted=True), 0)


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    g = random_graph(spark, 12, 0.3, 1)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(values(A.pagerank(g, 5))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_vertex_sink_and_fold(spark, tmp_path):
    g = graph(spark, tmp_path, DAG)
    write_vertices(A.bfs(g, 0), str(tmp_path / "out"), "level", single=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()][:3] == ["0 0", "1 1", "2 1"]
    state = g.vertices.selectExpr("id", "id as value")
    got = fold(g, state, lambda p: p.groupby("dst", as_index=False).agg(v=("src_value", "sum")), "dst long, v long")
    assert {r.dst: r.v for r in got.collect()} == {1: 0, 2: 0, 3: 12}


def test_streams_in_small_blocks(spark, tmp_path):
    """Any block size gives the same records and rows: those within blocks, and those across two or more."""
    (tmp_path / "w").mkdir()
    numbers = [str(i * 7 % 1000) for i in range(299)]
    text = "12 24\n" + "".join(n + (" " if i % 5 else "\n") + ("\t \n" if i % 31 == 0 else "") for i, n in enumerate(numbers[:288]))
    (tmp_path / "w" / "a.txt").write_text(text[:500])
    (tmp_path / "w" / "b.txt").write_text("\n")
    (tmp_path / "w" / "c.txt").write_text(text[500:])
    if not text[499].isspace() and not text[500].isspace():
        (tmp_path / "w" / "a.txt").write_text(text[: text.rindex(" ", 0, 500)])
        (tmp_path / "w" / "c.txt").write_text(text[text.rindex(" ", 0, 500) :])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = [int(x) for x in numbers[:288]]
    try:
        for size in ("10", "47", "200", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            for kept in (6, 9):
                own = Stream.open(spark, str(tmp_path / "w"), kept)
                assert own.total == 290 and own.head(2) == ["12", "24"]
                for width, skip in ((2, 2), (3, 2), (3, 1), (1, 0)):
                    all_of = [12, 24, *want][skip:]
                    rows = own.records({f"c{k}": T.LongType() for k in range(width)}, skip).collect()
                    assert sorted(map(tuple, rows)) == sorted(tuple(all_of[i : i + width]) for i in range(0, len(all_of) - width + 1, width)), (size, width, skip)
            got = {r.row_id: r["values"] for r in own.rows(24, 2).collect()}
            assert got == {i: want[24 * i : 24 * i + 24] for i in range(12)}, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with pytest.raises(Exception, match="Failed to parse|invalid"):
        graph(spark, tmp_path, "3\n0 x").edges.collect()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_plans_for_few_and_many_vertices_agree(spark, tmp_path, monkeypatch, few):
    """With shuffled states, and with heavy vertices in parts, results are those of a plain loop."""
    monkeypatch.setattr(vertex, "BROADCAST_ROWS", few)
    monkeypatch.setattr(vertex, "HEAVY", 3)
    rng = random.Random(4)
    edges = [(0, rng.randrange(12)) for _ in range(20)] + [(rng.randrange(12), rng.randrange(12)) for _ in range(15)]
    g = graph(spark, tmp_path, "14\n" + "\n".join(f"{a} {b}" for a, b in edges))
    rank = [1.0] * 14
    for _ in range(5):
        new = [0.15] * 14
        for a, b in edges:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in edges)
        rank = new
    assert values(A.pagerank(g, 5)) == [round(x, 6) for x in rank]
    level = [0] + [10**9] * 13
    for _ in range(14):
        for a, b in edges:
            level[b] = min(level[b], level[a] + 1 if level[a] < 10**9 else 10**9)
    assert values(A.bfs(g, 0)) == level
    for n in (1, 2, None):
        label = list(range(14))
        for _ in range(n or 14):
            old = list(label)
            for a, b in edges:
                label[a], label[b] = min(label[a], old[b]), min(label[b], old[a])
        assert values(A.connected_components(g, n)) == label


def test_normalized_pagerank_with_a_sink(spark, tmp_path):
    g = graph(spark, tmp_path, DAG)
    got = values(A.pagerank_normalized(g, 200, 1e-12))
    rank = [1 / 6] * 6
    for _ in range(200):
        lost = rank[3]
        new = [(0.15 + 0.85 * lost) / 6] * 6
        for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (4, 3), (5, 3)):
            new[b] += 0.85 * rank[a] / (2 if a == 0 else 1)
        rank = new
    assert got == [round(x, 6) for x in rank] and sum(rank) == pytest.approx(1)
    assert A.pagerank_normalized(graph(spark, tmp_path, "0"), 3).count() == 0


def test_stars(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in stars(chain).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert stars(chain.limit(0)).count() == 0
