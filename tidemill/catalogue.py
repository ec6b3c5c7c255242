"""All registered graph, matrix and table queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import block_of
from .operators import checks, matrix
from .plans import algorithms
from .runtime import shared_path
from .sources import matrices, texts
from .sources.graphs import EDGES, VERTICES, from_tables, read_edge_list, write_edge_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def graph_sql(name: str, rest: str) -> str:
    return f"with recursive e as materialized ({EDGES[name]}), v as materialized ({VERTICES[name]}){rest}"


# ---- graphs ----

register("edge_scan", EDGES["trade"])(lambda s, d: from_tables(s, d, "trade").edges)
register("vertex_range", "select range as id from range((select count(*) from nation))")(lambda s, d: s.range(s.read.parquet(f"{d}/nation.parquet").count()))
register("out_degree", graph_sql("trade", " select v.id, cast(count(e.src) as bigint) as out_degree from v left join e on e.src = v.id group by v.id"))(
    lambda s, d: from_tables(s, d, "trade").degrees().select("id", "out_degree"))
register("in_degree", graph_sql("trade", " select v.id, cast(count(e.dst) as bigint) as in_degree from v left join e on e.dst = v.id group by v.id"))(
    lambda s, d: from_tables(s, d, "trade").degrees().select("id", "in_degree"))
register("degree_total", graph_sql("users", ", o as (select src as id, count(*) as n from e group by src), i as (select dst as id, count(*) as n from e group by dst) select v.id, cast(coalesce(i.n, 0) as bigint) as in_degree, cast(coalesce(o.n, 0) as bigint) as out_degree, cast(coalesce(i.n, 0) + coalesce(o.n, 0) as bigint) as degree from v left join o using (id) left join i using (id)"))(
    lambda s, d: from_tables(s, d, "users").degrees())
register("edge_bucket_grid", graph_sql("trade", " select g.a as src_block, g.b as dst_block, cast(count(e.src) as bigint) as n_edges from (select x.range as a, y.range as b from range(8) x, range(8) y) g left join e on e.src % 8 = g.a and e.dst % 8 = g.b group by 1, 2"))(
    lambda s, d: from_tables(s, d, "trade").bucket_grid(8))
register("edge_dedup_weight", graph_sql("users", " select src, dst, count(*) as n_edges, min(weight) as min_weight from e group by src, dst"))(
    lambda s, d: from_tables(s, d, "users").merged())
register("adjacency_list_size", graph_sql("chain", " select src, cast(count(*) as bigint) as n_targets, string_agg(cast(dst as varchar), ',' order by dst) as targets from e group by src"))(
    lambda s, d: from_tables(s, d, "chain").adjacency().select("src", F.size("targets").cast("long").alias("n_targets"), F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets")))
register("adjacency_cells", graph_sql("nation", " select src, dst, max(weight) as weight from e group by src, dst"))(lambda s, d: from_tables(s, d, "nation").adjacency_cells())
for _g in EDGES:
    register(f"graph_counts_{_g}", graph_sql(_g, " select (select count(*) from v) as n_vertices, (select count(*) from e) as n_edges"))(
        lambda s, d, g=_g: from_tables(s, d, g).counts())


def _triplets(s: SparkSession, d: str) -> DataFrame:
    g = from_tables(s, d, "users")
    return g.triplets(g.vertices.select("id", (F.col("id") * 2).alias("value")))


register("triplets", graph_sql("users", " select src, dst, weight, a.id * 2 as src_value, b.id * 2 as dst_value from e join v a on a.id = src join v b on b.id = dst"))(_triplets)

_SHARES = ", o as (select src, count(*) as n from e group by src), t as materialized (select e.src, dst, count(*) * 1.0::double / any_value(o.n) as share from e join o on o.src = e.src group by e.src, dst)"


def _pagerank_sql(name: str, n: int, tail: str = "") -> str:
    steps = ", s0 as materialized (select id, 1.0::double as r from v)" + "".join(
        f", s{k} as materialized (select v.id, 0.15::double + 0.85::double * coalesce(m.a, 0) as r from v left join (select dst, sum(r * share) as a from t join s{k - 1} on id = src group by dst) m on m.dst = v.id)" for k in range(1, n + 1))
    return graph_sql(name, _SHARES + steps + (tail or f" select id, round(r, 6) as result from s{n}"))


for _g, _n in (("nation", 1), ("users", 10), ("nation", 30), ("users", 30), ("trade", 10), ("trade2", 10)):
    register(f"pagerank_{_n}_{_g}", _pagerank_sql(_g, _n))(
        lambda s, d, g=_g, n=_n: algorithms.pagerank(from_tables(s, d, g), n).select("id", F.round("result", 6).alias("result")))


def _gather_once(s: SparkSession, d: str) -> DataFrame:
    g = from_tables(s, d, "nation")
    return g.transition().groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("share"), 6).alias("acc"))


register("gather_sum_once", graph_sql("nation", _SHARES + " select dst as id, round(sum(share), 6) as acc from t group by dst"))(_gather_once)


def _cc_sql(name: str, n: int) -> str:
    steps = ", b as materialized (select src, dst from e union select dst, src from e), s0 as materialized (select id, id as r from v)" + "".join(
        f", s{k} as materialized (select p.id, least(p.r, coalesce(m.a, p.r)) as r from s{k - 1} p left join (select dst, min(r) as a from b join s{k - 1} on id = src group by dst) m on m.dst = p.id)" for k in range(1, n + 1))
    return graph_sql(name, steps + f" select id, r as label from s{n}")


register("cc_5_chain", _cc_sql("chain", 5))(lambda s, d: algorithms.connected_components(from_tables(s, d, "chain"), 5))
register("cc_fixpoint_chain", "select o_orderkey as id, min(o_orderkey) over (partition by o_custkey) as label from orders")(
    lambda s, d: algorithms.connected_components(from_tables(s, d, "chain")))
register("cc_fixpoint_trade", _cc_sql("trade", 12))(lambda s, d: algorithms.connected_components(from_tables(s, d, "trade")))
register("cc_component_sizes", "select min(o_orderkey) as label, count(*) as n_vertices from orders group by o_custkey")(
    lambda s, d: algorithms.connected_components(from_tables(s, d, "chain")).groupBy("label").agg(F.count("*").alias("n_vertices")))


def _sssp_sql(name: str, n: int, weight: str, last: str) -> str:
    steps = f", x as materialized (select src, dst, min({weight}) as w from e group by src, dst), s0 as materialized (select id, case when id = 0 then 0.0::double else 1e9::double end as r from v)" + "".join(
        f", s{k} as materialized (select p.id, least(p.r, coalesce(m.a, p.r)) as r from s{k - 1} p left join (select dst, min(r + w) as a from x join s{k - 1} on id = src where r < 1e9 group by dst) m on m.dst = p.id)" for k in range(1, n + 1))
    return graph_sql(name, steps + f" select id, {last} from s{n}")


register("sssp_weighted_12_users", _sssp_sql("users", 12, "weight", "r as distance"))(lambda s, d: algorithms.shortest_path(from_tables(s, d, "users"), 0, 12))
register("sssp_weighted_2_users", _sssp_sql("users", 2, "weight", "r as distance"))(lambda s, d: algorithms.shortest_path(from_tables(s, d, "users"), 0, 2))
register("bfs_levels_users", _sssp_sql("users", 10, "1.0::double", "cast(r as bigint) as level"))(lambda s, d: algorithms.bfs(from_tables(s, d, "users"), 0))
register("sssp_unit_fixpoint_chain", """
with r as (select o_orderkey as id, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders), z as (select o_custkey, n from r where id = 0)
select r.id, case when r.n >= z.n then cast(r.n - z.n as bigint) else 1000000000 end as level from r left join z on z.o_custkey = r.o_custkey""")(
    lambda s, d: algorithms.bfs(from_tables(s, d, "chain"), 0))

# ---- matrices ----


def embedding_rows(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def _six(v: Column) -> Column:
    """Rounded to 6 places, halves away from zero, by arithmetic that is exact for what it is used on: ``round`` makes a decimal of each number."""
    s = v * 1e6
    near = F.rint(s)
    near = F.when(F.abs(s - near) == 0.5, s + F.signum(s) * 0.5).otherwise(near)
    return F.when(F.abs(s) < 2.0**51, near / 1e6).otherwise(F.round(v, 6)) + 0.0


def _rounded(cells: DataFrame) -> DataFrame:
    return cells.select("i", "j", _six(F.col("v")).alias("v"))


DICTIONARY = "parquet.dictionary.page.size"


def _compact(cells: DataFrame) -> DataFrame:
    """Rounded cells; the session gets Parquet dictionaries of up to 16 MB, unless it sets these itself.

    That holds each number of 6 places from -1 to 1, so that files have its index of about 20 bits, where
    they had 8 bytes once 1 MB was full. Spark reads the setting when it writes.
    """
    s = cells.sparkSession
    if s.conf.get(DICTIONARY, None) is None and s.sparkContext._jsc.hadoopConfiguration().get(DICTIONARY) is None:
        s.conf.set(DICTIONARY, str(16 << 20))
    return _rounded(cells)


def _gram_sql() -> str:
    return """with m as (select vec_id as i, cast(embedding as double[]) as x from embeddings)
select a.i, b.i as j, round(list_dot_product(a.x, b.x), 6) + 0.0 as v from m a, m b"""


register("gram_full", _gram_sql())(lambda s, d: _compact(matrix.gram(embedding_rows(s, d))))
register("gram_upper_mirrored", _gram_sql())(lambda s, d: _compact(matrix.block_product(embedding_rows(s, d), embedding_rows(s, d), lambda a, b: a @ b.T, 100, mirrored=True)))


def _gram_ragged(s: SparkSession, d: str) -> DataFrame:
    own = embedding_rows(s, d)
    return _compact(matrix.block_product(own, own, lambda a, b: a @ b.T, 37))


register("gram_ragged_blocks", _gram_sql())(_gram_ragged)
_CELLS = "(select vec_id as i, unnest(range(0, len(embedding))) as j, cast(unnest(embedding) as double) as v from embeddings)"


def _gram_coo(s: SparkSession, d: str) -> DataFrame:
    own = matrix.cells(embedding_rows(s, d))
    return _compact(matrix.multiply(own, matrix.transpose(own)))


register("gram_coo", _gram_sql())(_gram_coo)


def _matmul(s: SparkSession, d: str) -> DataFrame:
    own = matrix.cells(embedding_rows(s, d))
    return _rounded(matrix.multiply(own, own))


register("matmul_ab", f"select a.i, b.j, round(sum(a.v * b.v), 6) + 0.0 as v from {_CELLS} a join {_CELLS} b on a.j = b.i group by a.i, b.j")(_matmul)
register("matrix_transpose", f"select j as i, i as j, v from {_CELLS}")(lambda s, d: matrix.transpose(matrix.cells(embedding_rows(s, d))))


def _assembled(s: SparkSession, d: str) -> DataFrame:
    own = embedding_rows(s, d)
    rows = matrix.product_rows(own, own, lambda a, b: a @ b.T)
    return rows.select("row_id", F.size("values").cast("long").alias("n"), _six(F.element_at("values", 1)).alias("first"), _six(F.element_at("values", -1)).alias("last"))


register("gram_rows", """with m as (select vec_id as i, cast(embedding as double[]) as x from embeddings), r as (select a.i as row_id, list(round(list_dot_product(a.x, b.x), 6) + 0.0 order by b.i) as v from m a, m b group by a.i)
select row_id, len(v) as n, v[1] as first, v[-1] as last from r""")(_assembled)
register("row_blocks", "select vec_id // 64 as block, count(*) as n_rows from embeddings group by 1")(
    lambda s, d: matrix.blocks(embedding_rows(s, d), 64).groupBy("block").agg(F.count("*").alias("n_rows")))
register("matrix_text", "select vec_id as row_id, array_to_string([cast(cast(trunc(x * 1000) as bigint) as varchar) for x in cast(embedding as double[])], ' ') as line from embeddings")(
    lambda s, d: matrices.to_lines(embedding_rows(s, d).select("row_id", F.transform("values", lambda x: x * 1000).alias("values")), truncate=True))
register("block_pairs", "select x.range as a, y.range as b from range(8) x, range(8) y")(lambda s, d: matrix.block_pairs(s, 8))

# ---- metrics, traces, comparison, schedules ----


def _summary(s: SparkSession, d: str) -> DataFrame:
    rows = checks.metric_summary(s.read.parquet(f"{d}/events.parquet"), "event_type", "value")
    return rows.select("event", "n", *(F.round(c, 9).alias(c) for c in rows.columns[2:]))


register("metric_summary", "with e as (select event_type, value / 1e6 as v from events) select event_type as event, count(v) as n, round(sum(v), 9) as sum_ms, round(min(v), 9) as min_ms, round(max(v), 9) as max_ms, round(avg(v), 9) as mean_ms, round(median(v), 9) as median_ms, round(stddev_pop(v), 9) as stddev_ms from e group by event_type")(_summary)


def _trace(s: SparkSession, d: str) -> DataFrame:
    """Each event is a line of a log, with a line that is none after it."""
    events = s.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.lit("x [Tracing] {'name': '"), F.col("event_type"), F.lit("', 'ph': 'X', 'tid': '"), F.col("user_id").cast("string"), F.lit("', 'ts': '"), F.col("event_id").cast("string"), F.lit("', 'dur': "), F.get_json_object("props", "$.k"), F.lit(", 'args': {'worker': 'w'}}"))
    lines = events.select(F.explode(F.array(line, F.concat(F.lit("no trace of "), F.col("event_type")))).alias("value"))
    return texts.trace_events(lines).select("name", "tid", "ts", F.col("dur").cast("long").alias("dur"), F.col("args.worker").alias("worker"))


register("trace_extract", "select event_type as name, cast(user_id as varchar) as tid, cast(event_id as varchar) as ts, cast(json_extract_string(props, '$.k') as bigint) as dur, 'w' as worker from events")(_trace)


def _compare(s: SparkSession, d: str) -> DataFrame:
    g = from_tables(s, d, "nation")
    a, b = (algorithms.pagerank(g, n).select("id", F.round("result", 6).alias("value")) for n in (2, 1))
    return checks.compare(a, b, 0.0005)


register("compare_tolerance", _pagerank_sql("nation", 2, " select s2.id, round(s2.r, 6) as actual, round(s1.r, 6) as expected from s2 join s1 using (id) where abs(round(s2.r, 6) - round(s1.r, 6)) > 0.0005"))(_compare)


def _equal(s: SparkSession, d: str) -> DataFrame:
    """Cells of the product in blocks against those by coordinates, of which the ones above 0.5 are moved by 1."""
    rows = embedding_rows(s, d)
    own = matrix.cells(rows)
    both = matrix.side_by_side(rows, rows, lambda a, b: a @ b.T, own, matrix.transpose(own), 100)
    both = both.select("i", "j", _six(F.col("left_v")).alias("left_v"), _six(F.col("right_v")).alias("right_v"))
    moved = F.when(F.col("right_v") > 0.5, F.col("right_v") + 1.0).otherwise(F.col("right_v"))
    return checks.unequal(both.withColumn("right_v", moved)).agg(F.count("*").alias("n_unequal"))


register("matrix_equal", f"with g as ({_gram_sql()}) select count(*) as n_unequal from g where v > 0.5")(_equal)
register("block_schedule_k4", """
select r.range as round, s.range as slot, least(a, b) as lo, greatest(a, b) as hi from range(7) r, range(4) s,
lateral (select case when s.range = 0 then 7 else (r.range + s.range) % 7 end as a, case when s.range = 0 then r.range else (r.range - s.range + 7) % 7 end as b)""")(
    lambda s, d: checks.block_schedule(s, 4))
_CIRCLE = """(select r.range as round, unnest(case when s.range = 0 then [207, r.range] else [(r.range + s.range) % 207, (r.range - s.range + 207) % 207] end) as block,
 least(case when s.range = 0 then 207 else (r.range + s.range) % 207 end, case when s.range = 0 then r.range else (r.range - s.range + 207) % 207 end) as lo,
 greatest(case when s.range = 0 then 207 else (r.range + s.range) % 207 end, case when s.range = 0 then r.range else (r.range - s.range + 207) % 207 end) as hi from range(207) r, range(104) s)"""
register("schedule_checks", f"""with c as {_CIRCLE}, n as (select round, count(distinct block) as k from c group by round)
select (select count(*) from n) as n_rounds, (select min(k) from n) as min_covered, (select max(k) from n) as max_covered, (select count(*) // 2 from c) as n_pairs, (select count(distinct (lo, hi)) from c) as n_distinct_pairs""")(
    lambda s, d: checks.schedule_checks(checks.block_schedule(s, 104)))
register("exchange_plan_checks", "select range as round, cast(32 as bigint) as n_blocks, cast(16 as bigint) as n_good, cast(16 as bigint) as n_new from range(30)")(
    lambda s, d: checks.plan_checks(checks.plan_table(s, 16), 16))
_LINES = ["app.name=pagerank", "# a comment", "", "app.input_dir=/a=b", "buffer.capacity=2", "alone", "servers=h1:1,h2:2,"]
_LINE_SQL = "(select unnest([" + ", ".join(f"'{x}'" for x in _LINES) + "]) as value)"
register("config_kv", f"select case when contains(value, '=') then split_part(value, '=', 1) else value end as key, case when contains(value, '=') then value[instr(value, '=') + 1:] else value end as value from {_LINE_SQL} where value <> '' and not starts_with(value, '#')")(
    lambda s, d: texts.pairs(s.createDataFrame([(x,) for x in _LINES], "value string")))
register("address_list", "select unnest(['h1:1', 'h2:2']) as address")(
    lambda s, d: s.createDataFrame([("h1:1,h2:2,",)], "value string").select(F.explode(texts.address_column(F.col("value"))).alias("address")))


def _union(s: SparkSession, d: str) -> DataFrame:
    own = from_tables(s, d, "trade").degrees().select("id", "degree")
    parts = [own.filter(block_of("id", 4) == k) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("rank_union", graph_sql("trade", ", x as (select src as id from e union all select dst from e) select v.id, cast(count(x.id) as bigint) as degree from v left join x on x.id = v.id group by v.id"))(_union)

# ---- text files: a table is written as one and read again ----


def _edge_text(name: str, weighted: bool):
    def query(s: SparkSession, d: str) -> DataFrame:
        g, path = from_tables(s, d, name), shared_path(s, "edges")
        top = g.vertices.agg(F.max("id")).first()[0]
        write_edge_list(g, path, 1 + (-1 if top is None else top), weighted)
        return read_edge_list(s, path, weighted).edges

    return query


register("edge_list_text", EDGES["trade"])(_edge_text("trade", False))
register("edge_list_weighted_text", EDGES["users"])(_edge_text("users", True))


def _text_degrees(s: SparkSession, d: str) -> DataFrame:
    g, path = from_tables(s, d, "nation"), shared_path(s, "edges")
    write_edge_list(g, path, 1 + g.vertices.agg(F.max("id")).first()[0])
    return read_edge_list(s, path).degrees()


register("edge_list_text_degrees", graph_sql("nation", ", x as (select range as id from range((select max(id) + 1 from v))), o as (select src as id, count(*) as n from e group by src), i as (select dst as id, count(*) as n from e group by dst) select x.id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) as degree from x left join o using (id) left join i using (id)"))(_text_degrees)


def _matrix_text(s: SparkSession, d: str) -> DataFrame:
    path = shared_path(s, "matrix")
    rows = embedding_rows(s, d)
    matrices.write_matrix(rows, path, 64)
    return matrix.cells(matrices.read_matrix(s, path))


register("matrix_text_read", f"select i, j, v from {_CELLS}")(_matrix_text)


def _normalized_sql(name: str, n: int) -> str:
    steps = ", n as (select cast(count(*) as double) as n from v), d as materialized (select v.id, o.n as outs from v left join o on o.src = v.id), s0 as materialized (select id, 1 / n as r from v, n)" + "".join(
        f", s{k} as materialized (select v.id, (0.15::double + 0.85::double * (select coalesce(sum(r), 0) from s{k - 1} join d using (id) where outs is null)) / n.n + 0.85::double * coalesce(m.a, 0) as r from v cross join n left join (select dst, sum(r * share) as a from t join s{k - 1} on id = src group by dst) m on m.dst = v.id)" for k in range(1, n + 1))
    return graph_sql(name, _SHARES + steps + f" select id, round(r, 9) as result from s{n}")


register("pagerank_normalized_10_trade", _normalized_sql("trade", 10))(
    lambda s, d: algorithms.pagerank_normalized(from_tables(s, d, "trade"), 10, None).select("id", F.round("result", 9).alias("result")))
