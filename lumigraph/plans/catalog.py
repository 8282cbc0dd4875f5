"""Registered queries of the graph operators, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import diffusion, edges, export, flows, hierarchy, permute, stats
from ..operators.edges import EdgeTest
from ..sources import graphs
from ..tables import settle
from . import sql
from .sql import RESTART, STEP, TARJAN, E, T, V

def _nation(spark, d):
    return graphs.nation_trade(spark, d), graphs.nations(spark, d)


def _threshold(e: DataFrame, q: float = 0.7) -> float:
    return e.agg(F.percentile("w", q)).first()[0]


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """component, nvertices of the walk over the nation trade graph, cut at its 0.7 quantile."""
    e, v = _nation(spark, d)
    walk = settle(diffusion.random_walk(diffusion.stepmatrix(e), v, RESTART).where("src <> dst"))
    merge = hierarchy.merge_table(walk)
    return hierarchy.cut(merge, v, _threshold(walk)).groupBy("component").agg(F.count("*").alias("nvertices"))


def _regions(v: DataFrame, k: int) -> DataFrame:
    return v.where(F.col("region") == k).select("vertex")


QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("import_digraph", "WITH raw AS (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), c AS (SELECT s, d, count(*)::DOUBLE AS w FROM raw WHERE d IS NOT NULL GROUP BY 1, 2), n AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT s AS label FROM c UNION SELECT d FROM c)) SELECT a.id AS src, b.id AS dst, w, a.label AS src_label FROM c JOIN n a ON s = a.label JOIN n b ON d = b.label")
def _import(spark, d):
    e, nodes = edges.import_digraph(graphs.event_transitions(spark, d), "src_label", "dst_label")
    return e.join(nodes.select(F.col("vertex").alias("src"), F.col("label").alias("src_label")), "src").select("src", "dst", "w", "src_label")


@query("tarjan_graph", f"WITH {TARJAN} SELECT * FROM g")
def _tarjan(spark, d):
    return graphs.tarjan_graph(spark)


@query("example_graph", "WITH v AS (SELECT range AS i FROM range(1, 9)), h AS (SELECT a.i AS src, b.i AS dst FROM v a JOIN v b ON a.i < b.i UNION ALL SELECT i + 8, i % 8 + 9 FROM v UNION ALL SELECT i + 8, (i + 1) % 8 + 9 FROM v UNION ALL SELECT i + 16, i % 8 + 17 FROM v UNION ALL SELECT 25, unnest([1, 9, 17])) SELECT src, dst, 1.0::DOUBLE AS w FROM h UNION ALL SELECT dst, src, 1.0 FROM h")
def _example(spark, d):
    return graphs.example_graph(spark)


@query("outedges", f"WITH {E}, {T} SELECT dst, w FROM e, t WHERE src = (SELECT arg_max(src, w) FROM e) AND w <> 0 AND w >= t")
def _out(spark, d):
    e = graphs.nation_trade(spark, d)
    busiest = e.agg(F.max_by("src", "w")).first()[0]
    return edges.outedges(e, busiest, EdgeTest(_threshold(e)))


@query("outedges_sparse", "SELECT l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem WHERE l_suppkey = 3 GROUP BY 1 HAVING sum(l_quantity) >= 40")
def _out_sparse(spark, d):
    return edges.outedges_sparse(graphs.supplier_parts(spark, d), 3, EdgeTest(40.0))


@query("edge_filter", "WITH s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) SELECT * FROM s WHERE w >= 60")
def _edge_filter(spark, d):
    return graphs.supplier_parts(spark, d).where(EdgeTest(60.0).valid(F.col("w")))


@query("isindexed", f"WITH {E}, {T} SELECT src, dst, w FROM e, t WHERE w <> 0 AND w <= t")
def _indexed(spark, d):
    e = graphs.nation_trade(spark, d)
    return e.where(EdgeTest(_threshold(e)).indexed(F.col("w")))


@query("isweaker", f"WITH {E} SELECT a.src, a.dst, a.w < b.w AS weaker, a.w > b.w AS weaker_rev FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src")
def _weaker(spark, d):
    e = graphs.nation_trade(spark, d)
    b = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("b"))
    return e.join(b, ["src", "dst"]).select("src", "dst", edges.isweaker(F.col("w"), F.col("b")).alias("weaker"), edges.isweaker(F.col("w"), F.col("b"), True).alias("weaker_rev"))


@query("induced_subgraph", f"WITH {E}, {V} SELECT src, dst, w FROM e WHERE src IN (SELECT vertex FROM v WHERE region < 2) AND dst IN (SELECT vertex FROM v WHERE region < 2)")
def _induced(spark, d):
    e, v = _nation(spark, d)
    return edges.induced_subgraph(e, v.where("region < 2"))


@query("sorted_values", "SELECT DISTINCT sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY l_suppkey, l_partkey")
def _sorted(spark, d):
    return edges.sorted_values(graphs.supplier_parts(spark, d))


@query("index_values", "WITH s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) SELECT src, dst, w, dense_rank() OVER (ORDER BY w)::INT AS rank FROM s")
def _index(spark, d):
    return edges.index_values(graphs.supplier_parts(spark, d))


@query("condense", "WITH s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) SELECT s_nationkey::BIGINT AS src_part, p_brand AS dst_part, max(w) AS w FROM s JOIN supplier ON src = s_suppkey JOIN part ON dst = p_partkey GROUP BY 1, 2")
def _condense(spark, d):
    parts = graphs.table(spark, d, "part").select(F.col("p_partkey").alias("vertex"), F.col("p_brand").alias("part"))
    sups = graphs.table(spark, d, "supplier").select(F.col("s_suppkey").alias("vertex"), F.col("s_nationkey").cast("long").alias("part"))
    return edges.condense(graphs.supplier_parts(spark, d), parts, sups)


@query("neighborhood_weights", f"WITH {E}, {V}, {T} SELECT vertex, round(coalesce(x, 0), 2) AS weight FROM v LEFT JOIN (SELECT src, sum(w) AS x FROM e, t WHERE w >= t GROUP BY 1) ON vertex = src")
def _neighbors(spark, d):
    e, v = _nation(spark, d)
    return _round(edges.neighborhood_weights(e, e.where(F.col("w") >= _threshold(e)), v), "weight", digits=2)


@query("diedge_stats_full", f"WITH {TARJAN} SELECT (s.range - 1) * 7 + t.range AS diedge, s.range AS src, t.range AS dest, coalesce(w, 0) AS w FROM range(1, 8) s CROSS JOIN range(1, 8) t LEFT JOIN g ON src = s.range AND dst = t.range")
def _full(spark, d):
    return edges.all_pairs(graphs.tarjan_graph(spark), 7)


@query("stepmatrix", f"WITH {E}, {V}, f AS (SELECT src, dst, e.w * v.weight AS w FROM e JOIN v ON dst = vertex) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS w FROM f")
def _step(spark, d):
    e, v = _nation(spark, d)
    return _round(diffusion.stepmatrix(e, v), "w")


_WALK = f"WITH {E}, {V}, {STEP}, {sql.walk()}"


@query("random_walk", f"{_WALK} SELECT src, dst, round(w, 9) AS w FROM x{sql.ROUNDS}")
def _walk(spark, d):
    e, v = _nation(spark, d)
    return _round(diffusion.random_walk(diffusion.stepmatrix(e), v, RESTART), "w")


@query("diffused_weights", f"{_WALK} SELECT dst AS vertex, round(sum(x.w * v.weight), 2) AS weight FROM x{sql.ROUNDS} x JOIN v ON x.src = v.vertex GROUP BY 1")
def _diffused(spark, d):
    e, v = _nation(spark, d)
    return _round(diffusion.diffuse(diffusion.stepmatrix(e), v.select("vertex", "weight"), RESTART), "weight", digits=2)


@query("similarity", f"{_WALK} SELECT x.src, x.dst, round(x.w * v.weight, 2) AS w FROM x{sql.ROUNDS} x JOIN v ON x.src = v.vertex")
def _similar(spark, d):
    e, v = _nation(spark, d)
    return _round(diffusion.similarity(diffusion.random_walk(diffusion.stepmatrix(e), v, RESTART), v), "w", digits=2)


@query("stabilized_step", f"""{_WALK}, wx AS (SELECT dst AS vertex, sum(x.w * v.weight) AS x FROM x{sql.ROUNDS} x JOIN v ON x.src = v.vertex GROUP BY 1), k AS (SELECT (SELECT sum(weight) FROM v) / (SELECT sum(x) FROM wx) AS k)
SELECT src, dst, round(sum(w), 2) AS w FROM (SELECT st.src, st.dst, st.w * wx.x * k.k * {1 - RESTART} AS w FROM st JOIN wx ON st.src = wx.vertex, k UNION ALL SELECT vertex, vertex, weight * {RESTART} FROM v) GROUP BY 1, 2""")
def _stabilized(spark, d):
    e, v = _nation(spark, d)
    return _round(diffusion.stabilized_step(settle(diffusion.stepmatrix(e)), v.select("vertex", "weight"), RESTART), "w", digits=2)


@query("scc", f"WITH RECURSIVE {E}, {V}, {T}, r(s, d) AS (SELECT vertex, vertex FROM v UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.d JOIN t ON e.w >= t.t) SELECT min(a.d) AS component, a.s AS vertex FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY a.s")
def _scc(spark, d):
    e, v = _nation(spark, d)
    return hierarchy.scc(e, v, EdgeTest(_threshold(e)))


def _tree_query(e: DataFrame, v: DataFrame, rev: bool = False) -> DataFrame:
    nodes = hierarchy.tree(hierarchy.merge_table(e, EdgeTest(rev=rev)), v, rev)
    return nodes.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("children", "vertices")})


def _strong(rev: bool = False) -> str:
    return f"WITH RECURSIVE {E}, {V}, {sql.strong(rev=rev)}"


@query("scc_thresholds", f"{_strong()} SELECT t AS threshold FROM tt")
def _thresholds(spark, d):
    return hierarchy.thresholds(hierarchy.merge_table(graphs.nation_trade(spark, d)))


@query("cut", f"{_strong()} SELECT t AS threshold, component, vertex FROM lab WHERE t IN (SELECT t FROM tt)")
def _cut(spark, d):
    e, v = _nation(spark, d)
    merge = hierarchy.merge_table(e)
    return hierarchy.cuts(merge, v, hierarchy.thresholds(merge))


@query("cut_minsize", f"{_strong()} SELECT t AS threshold, component, vertex FROM lab WHERE t IN (SELECT t FROM tt) QUALIFY count(*) OVER (PARTITION BY t, component) >= 3")
def _cut_minsize(spark, d):
    e, v = _nation(spark, d)
    merge = hierarchy.merge_table(e)
    return hierarchy.cuts(merge, v, hierarchy.thresholds(merge), minsize=3)


@query("cut_rev", f"{_strong(True)} SELECT t AS threshold, component, vertex FROM lab WHERE t IN (SELECT t FROM tt)")
def _cut_rev(spark, d):
    e, v = _nation(spark, d)
    merge = hierarchy.merge_table(e, EdgeTest(rev=True))
    return hierarchy.cuts(merge, v, hierarchy.thresholds(merge, True), True)


@query("scc_tree", f"{_strong()}, {sql.tree()} {sql.TREE_ROWS}")
def _tree(spark, d):
    return _tree_query(*_nation(spark, d))


@query("scc_tree_rev", f"{_strong(True)}, {sql.tree(rev=True)} {sql.TREE_ROWS}")
def _tree_rev(spark, d):
    return _tree_query(*_nation(spark, d), True)


_BRANDS = "pn AS (SELECT p_brand, s_nationkey, sum(l_quantity)::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT 100 + substr(p_brand, 7)::BIGINT AS src, s_nationkey::BIGINT AS dst, w FROM pn), v AS (SELECT DISTINCT src AS vertex FROM e UNION SELECT dst FROM e)"


@query("scc_tree_unconnected", f"WITH RECURSIVE {_BRANDS}, {sql.strong()}, {sql.tree()} {sql.TREE_ROWS}")
def _tree_unconnected(spark, d):
    """Brands sell to nations, never back: no component at any threshold, so the root alone."""
    read = lambda name: graphs.table(spark, d, name)
    rows = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = settle(rows.groupBy((F.substring("p_brand", 7, 9).cast("long") + 100).alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("l_quantity").cast("double").alias("w")))
    return _tree_query(e, e.select(F.col("src").alias("vertex")).union(e.select("dst")).distinct())


@query("tree_vertices", f"{_strong()}, {sql.tree()} SELECT node, unnest(vs) AS vertex FROM k")
def _tree_vertices(spark, d):
    e, v = _nation(spark, d)
    return hierarchy.tree_vertices(hierarchy.tree(hierarchy.merge_table(e), v))


@query("supplier_part_cuts", """WITH s AS (SELECT l_suppkey AS a, 10000000 + l_partkey AS b, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT unnest([60.0, 90.0, 120.0])::DOUBLE AS threshold),
h AS (SELECT threshold, a, b FROM s, t WHERE w >= threshold) SELECT threshold, count(DISTINCT b)::BIGINT AS parts, count(DISTINCT a)::BIGINT AS suppliers FROM h GROUP BY 1""")
def _supplier_part_cuts(spark, d):
    """The whole hierarchy of the supplier and part graph, edges in both directions, cut at three thresholds: how many parts and suppliers have company there."""
    # Suppliers are even vertices and parts odd ones, so that no key is taken for one of the other table.
    s = settle(graphs.supplier_parts(spark, d).select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"), "w"))
    at = spark.createDataFrame([(60.0,), (90.0,), (120.0,)], "threshold double")
    v = s.select(F.col("src").alias("vertex")).union(s.select("dst")).distinct()
    cut = hierarchy.cuts(hierarchy.merge_table(s, both=True), v, at, minsize=2)
    is_part = F.col("vertex") % 2 != 0
    return cut.groupBy("threshold").agg(F.sum(is_part.cast("long")).alias("parts"), F.sum((~is_part).cast("long")).alias("suppliers"))


_CUTSTATS = """z AS (SELECT t, component, count(*) AS size, count(*) FILTER (region = 0) AS a, count(*) FILTER (region = 1) AS b FROM lab JOIN v USING (vertex) WHERE t IN (SELECT t FROM tt) GROUP BY 1, 2), kk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY size DESC, component) AS rn FROM z),
ts AS (SELECT t AS threshold, count(*) AS ncomponents, count(*) FILTER (size > 1) AS ncomponents_nontrivial, max(size) AS maxcomponent_size, sum(size) FILTER (rn <= 5)::BIGINT AS topn_components_sizesum, count(*) FILTER (a > 0) AS ncompsources, sum(a) FILTER (rn <= 5)::BIGINT AS topn_nsources,
  count(*) FILTER (b > 0) AS ncompsinks, sum(b) FILTER (rn <= 5)::BIGINT AS topn_nsinks, round(log10(max(size)), 9) AS log10_maxcomponent_size, round(log10(sum(size) FILTER (rn <= 5)), 9) AS log10_topn_components_sizesum FROM kk GROUP BY 1)"""
_LOGS = ("log10_maxcomponent_size", "log10_topn_components_sizesum")


@query("treecut_stats", f"{_strong()}, {_CUTSTATS} SELECT * FROM ts")
def _treecut(spark, d):
    e, v = _nation(spark, d)
    return _round(stats.treecut_stats(hierarchy.merge_table(e), v, sources=_regions(v, 0), sinks=_regions(v, 1)), *_LOGS)


@query("topn_components", f"{_strong()}, z AS (SELECT t AS threshold, component, count(*) AS size FROM lab WHERE t IN (SELECT t FROM tt) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY size DESC, component)::INT AS rank FROM z QUALIFY rank <= 3")
def _topn(spark, d):
    e, v = _nation(spark, d)
    merge = hierarchy.merge_table(e)
    sizes = hierarchy.cuts(merge, v, hierarchy.thresholds(merge)).groupBy("threshold", "component").agg(F.count("*").alias("size"))
    return stats.topn_components(sizes, 3)


def _flow_input(spark, d):
    e, v = _nation(spark, d)
    merge = hierarchy.merge_table(e)
    return e, v, merge, settle(hierarchy.cuts(merge, v, hierarchy.thresholds(merge))), _regions(v, 0), _regions(v, 1)


_FLOWS = f"WITH RECURSIVE {sql.flows()}"


@query("component_flows", f"{_FLOWS} SELECT * FROM flows")
def _component_flows(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    return flows.component_flows(cut, e, a, b)


@query("vertex_flows", f"{_FLOWS}, {sql.VERTEX_FLOWS} SELECT * FROM vf")
def _vertex_flows(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    return flows.vertex_flows(cut, flows.component_flows(cut, e, a, b), a, b)


@query("flow_subgraph", f"{_FLOWS}, {sql.SUBGRAPH} SELECT * FROM sub")
def _subgraph(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    return flows.flow_subgraph(cut, e, a, b)


#: Sums over flows: f has the flows, with their pairs' weights as pw.
_PAIR_WEIGHTS = "f AS (SELECT *, coalesce((SELECT sum(e.w) FROM c ca JOIN v a ON a.vertex = ca.vertex AND a.region = 0 JOIN e ON e.src = a.vertex JOIN c cb ON cb.t = ca.t AND cb.vertex = e.dst JOIN v b ON b.vertex = e.dst AND b.region = 1 WHERE ca.t = flows.threshold AND ca.component = flows.src_comp AND cb.component = flows.dst_comp), 0) AS pw, n_src * n_dst AS n2, len + 1.0::DOUBLE AS hops FROM flows)"
_FLOWSUMS = "sum(n2)::BIGINT AS nflows, count(*) AS ncompflows, sum(len * n2)::BIGINT AS flowlen_sum, sum(n2 / hops) AS flowinvlen_sum, sum(len)::BIGINT AS compflowlen_sum, sum(1 / hops) AS compflowinvlen_sum, max(len) AS compflowlen_max, sum(pw) AS floweight_sum, sum(pw / n2) AS compfloweight_sum, sum(pw / hops) AS flowavghopweight_sum, sum(pw / n2 / hops) AS compflowavghopweight_sum"
_ENDS = "ends AS (SELECT t AS threshold, count(DISTINCT component) FILTER (region = 0) AS ncompsources, count(DISTINCT component) FILTER (region = 1) AS ncompsinks FROM c JOIN v USING (vertex) GROUP BY 1)"


@query("flowstats", f"{_FLOWS}, {_PAIR_WEIGHTS}, {_ENDS}, g AS (SELECT threshold, {_FLOWSUMS}, sum(minweight * n2) AS flow_minedgeweight_sum, sum(minweight) AS compflow_minedgeweight_sum FROM f GROUP BY 1) SELECT threshold, ncompsources, ncompsinks, coalesce(nflows, 0) AS nflows, coalesce(ncompflows, 0) AS ncompflows, coalesce(flowlen_sum, 0) AS flowlen_sum, round(coalesce(flowinvlen_sum, 0), 9) AS flowinvlen_sum, coalesce(compflowlen_sum, 0) AS compflowlen_sum, round(coalesce(compflowinvlen_sum, 0), 9) AS compflowinvlen_sum, coalesce(compflowlen_max, 0) AS compflowlen_max, round(coalesce(floweight_sum, 0), 4) AS floweight_sum, round(coalesce(compfloweight_sum, 0), 4) AS compfloweight_sum, round(coalesce(flowavghopweight_sum, 0), 4) AS flowavghopweight_sum, round(coalesce(compflowavghopweight_sum, 0), 4) AS compflowavghopweight_sum, round(coalesce(flow_minedgeweight_sum, 0), 4) AS flow_minedgeweight_sum, round(coalesce(compflow_minedgeweight_sum, 0), 4) AS compflow_minedgeweight_sum FROM ends LEFT JOIN g USING (threshold)")
def _flowstats(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    out = flows.flowstats(cut, flows.component_flows(cut, e, a, b), a, b, e)
    money = ["floweight_sum", "compfloweight_sum", "flowavghopweight_sum", "compflowavghopweight_sum", "flow_minedgeweight_sum", "compflow_minedgeweight_sum"]
    return _round(_round(out, "flowinvlen_sum", "compflowinvlen_sum"), *money, digits=4)


_TREECUT_FLOWS = f"""{_FLOWS}, {_CUTSTATS}, {_PAIR_WEIGHTS}, f2 AS (SELECT *, CASE WHEN len = 0 THEN greatest(minweight, threshold) ELSE minweight END AS mw FROM f), g AS (SELECT threshold, {_FLOWSUMS}, sum(mw * n2) AS fm, sum(mw) AS cm FROM f2 GROUP BY 1),
q AS (SELECT ts.*, coalesce(nflows, 0) AS nflows, coalesce(ncompflows, 0) AS ncompflows, g.* EXCLUDE (threshold, nflows, ncompflows), ((SELECT count(*) FROM v WHERE region = 0) * (SELECT count(*) FROM v WHERE region = 1))::DOUBLE AS nv, (ncompsources * ncompsinks)::DOUBLE AS nc FROM ts LEFT JOIN g USING (threshold))
SELECT threshold, ncomponents, ncomponents_nontrivial, maxcomponent_size, topn_components_sizesum, ncompsources, topn_nsources, ncompsinks, topn_nsinks, log10_maxcomponent_size, log10_topn_components_sizesum, nflows, ncompflows,
  round(CASE WHEN nflows = 0 THEN 'nan'::DOUBLE ELSE flowlen_sum / nflows END, 9) AS flow_avglen, round(coalesce(flowinvlen_sum, 0) / nv, 9) AS flow_avginvlen, round(CASE WHEN ncompflows = 0 THEN 'nan'::DOUBLE ELSE compflowlen_sum / ncompflows END, 9) AS compflow_avglen, round(coalesce(compflowinvlen_sum, 0) / nc, 9) AS compflow_avginvlen,
  round(coalesce(floweight_sum, 0) / nv, 6) AS flow_avgweight, round(coalesce(flowavghopweight_sum, 0) / nv, 6) AS flow_avghopweight, round(coalesce(compfloweight_sum, 0) / nc, 6) AS compflow_avgweight, round(coalesce(fm, 0) / nv, 6) AS flow_avgminedgeweight, round(coalesce(cm, 0) / nc, 6) AS compflow_avgminedgeweight,
  round(((nv - nflows) * (ncomponents + 1) + coalesce(flowlen_sum, 0)) / nv, 9) AS flow_distance, round(((nc - ncompflows) * (ncomponents + 1) + coalesce(compflowlen_sum, 0)) / nc, 9) AS compflow_distance FROM q"""


@query("treecut_flow_stats", _TREECUT_FLOWS)
def _treecut_flows(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    out = stats.treecut_stats(merge, v, e, a, b, e)
    out = _round(out, *_LOGS, "flow_avglen", "flow_avginvlen", "compflow_avglen", "compflow_avginvlen", "flow_distance", "compflow_distance")
    return _round(out, "flow_avgweight", "flow_avghopweight", "compflow_avgweight", "flow_avgminedgeweight", "compflow_avgminedgeweight", digits=6)


@query("flows_all_thresholds", f"{_FLOWS} SELECT threshold, count(*) AS n, max(len) AS longest FROM flows GROUP BY 1")
def _all_flows(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    return flows.component_flows(cut, e, a, b).groupBy("threshold").agg(F.count("*").alias("n"), F.max("len").alias("longest"))


#: One threshold that is a weight of the graph.
_AT = "tq AS (SELECT quantile_disc(w, 0.7) AS t FROM e),"


def _at(e: DataFrame) -> float:
    return e.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY w)")).first()[0]


@query("flowgraph", f"""WITH RECURSIVE {sql.flows("t = (SELECT t FROM tq)", _AT)}, {sql.VERTEX_FLOWS}, {sql.SUBGRAPH}, big AS (SELECT component FROM c GROUP BY 1 HAVING count(*) >= 2), i2 AS (SELECT * FROM sub WHERE src_comp IN (SELECT component FROM big) AND dst_comp IN (SELECT component FROM big)),
used AS (SELECT src_comp AS x FROM i2 WHERE src_comp <> dst_comp UNION SELECT dst_comp FROM i2 WHERE src_comp <> dst_comp UNION SELECT component FROM c JOIN v USING (vertex) WHERE component IN (SELECT component FROM big) GROUP BY 1 HAVING bool_or(region = 0) AND bool_or(region = 1))
SELECT 'edge' AS kind, source, target, src_comp, dst_comp, NULL::INT AS len, walkweight AS weight FROM i2 WHERE src_comp IN (SELECT x FROM used)
UNION ALL SELECT 'flow', source, target, src_comp, dst_comp, len, minweight FROM vf WHERE src_comp IN (SELECT component FROM big) AND dst_comp IN (SELECT component FROM big)""")
def _flowgraph(spark, d):
    e, v = _nation(spark, d)
    _, sub, found = flows.flowgraph(hierarchy.merge_table(e), e, v, _regions(v, 0), _regions(v, 1), EdgeTest(_at(e)), mincompsize=2)
    edge = sub.select(F.lit("edge").alias("kind"), "source", "target", "src_comp", "dst_comp", F.lit(None).cast("int").alias("len"), F.col("walkweight").alias("weight"))
    return edge.union(found.select(F.lit("flow"), "source", "target", "src_comp", "dst_comp", "len", "minweight"))


@query("used_ends", f"{_FLOWS}, {sql.VERTEX_FLOWS} SELECT DISTINCT threshold, 'source' AS kind, source AS vertex FROM vf UNION ALL SELECT DISTINCT threshold, 'sink', target FROM vf")
def _used_ends(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    sources, sinks = flows.used_ends(flows.vertex_flows(cut, flows.component_flows(cut, e, a, b), a, b))
    return sources.select("threshold", F.lit("source").alias("kind"), "vertex").union(sinks.select("threshold", F.lit("sink"), "vertex"))


@query("traceflows", f"WITH {E}, {V}, {T}, s AS (SELECT src, dst FROM e, t WHERE w >= t), p AS (SELECT src AS source, dst AS target, '' AS path FROM s UNION ALL SELECT a.src, b.dst, a.dst::VARCHAR FROM s a JOIN s b ON a.dst = b.src AND b.dst <> a.src) SELECT source, target, path FROM p JOIN s ON source = src AND target = dst JOIN v x ON x.vertex = source AND x.region = 0 JOIN v y ON y.vertex = target AND y.region = 1")
def _trace(spark, d):
    e, v = _nation(spark, d)
    test = EdgeTest(_threshold(e))
    return flows.trace_flows(e, e, _regions(v, 0), _regions(v, 1), test, test).select("source", "target", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("vertexbins_sort", f"WITH {E}, {V}, g AS (SELECT vertex, coalesce((SELECT sum(w) FROM e WHERE src = vertex), 0) AS o FROM v) SELECT vertex, (floor((row_number() OVER (ORDER BY o DESC, vertex) - 1) / 5) + 1)::INT AS bin FROM g")
def _bins(spark, d):
    e, v = _nation(spark, d)
    return permute.vertexbins_sort(e, v, "out", 5)


_HILBERT = "hb(i, j, place) AS (VALUES (1, 1, 1), (1, 2, 2), (1, 3, 15), (1, 4, 16), (2, 1, 4), (2, 2, 3), (2, 3, 14), (2, 4, 13), (3, 1, 5), (3, 2, 8), (3, 3, 9), (3, 4, 12), (4, 1, 6), (4, 2, 7), (4, 3, 10), (4, 4, 11))"
_SORTED = "g AS (SELECT vertex, coalesce((SELECT sum(w) FROM e WHERE src = vertex), 0) AS o, coalesce((SELECT sum(w) FROM e WHERE dst = vertex), 0) AS n FROM v)"


@query("vertexbins_hilbert", f"WITH {E}, {V}, {_HILBERT}, {_SORTED}, ij AS (SELECT vertex, (row_number() OVER (ORDER BY o DESC, vertex) - 1) // 7 + 1 AS i, (row_number() OVER (ORDER BY n DESC, vertex) - 1) // 7 + 1 AS j FROM g) SELECT vertex, ((row_number() OVER (ORDER BY place, vertex) - 1) // 5 + 1)::INT AS bin FROM ij JOIN hb USING (i, j)")
def _bins_both(spark, d):
    e, v = _nation(spark, d)
    return permute.vertexbins(e, v, "outXin", "sort", 5)


@query("vertexbins_tree")
def _bins_tree(spark, d):
    e, v = _nation(spark, d)
    return permute.vertexbins(e, v, "outXin", "tree", 5)


@query("randpermgroups", f"WITH {E}, {V}, {_SORTED}, b AS (SELECT vertex, (row_number() OVER (ORDER BY o DESC, vertex) - 1) // 5 + 1 AS bin FROM g), r AS (SELECT range AS perm, bin, vertex FROM b, range(1, 21)), x AS (SELECT perm, bin, vertex, row_number() OVER (PARTITION BY perm, bin ORDER BY vertex) AS k FROM r), y AS (SELECT perm, bin, vertex, row_number() OVER (PARTITION BY perm, bin ORDER BY md5('1:' || perm || ':' || vertex)) AS k FROM r) SELECT x.perm::INT AS perm, x.vertex, y.vertex AS from_vertex FROM x JOIN y USING (perm, bin, k)")
def _perm(spark, d):
    e, v = _nation(spark, d)
    return permute.randpermgroups(permute.vertexbins_sort(e, v, "out", 5), 20)


@query("permuted_weights", f"WITH {E}, {V}, {_SORTED}, b AS (SELECT vertex, (row_number() OVER (ORDER BY o DESC, vertex) - 1) // 5 + 1 AS bin FROM g WHERE vertex % 5 <> 2), r AS (SELECT range AS perm, bin, vertex FROM b, range(1, 4)), x AS (SELECT perm, bin, vertex, row_number() OVER (PARTITION BY perm, bin ORDER BY vertex) AS k FROM r), y AS (SELECT perm, bin, vertex, row_number() OVER (PARTITION BY perm, bin ORDER BY md5('7:' || perm || ':' || vertex)) AS k FROM r) SELECT x.perm::INT AS perm, x.vertex, v.weight FROM x JOIN y USING (perm, bin, k) JOIN v ON v.vertex = y.vertex UNION ALL SELECT range::INT, vertex, weight FROM v, range(1, 4) WHERE vertex % 5 = 2")
def _permuted(spark, d):
    e, v = _nation(spark, d)
    bins = permute.vertexbins_sort(e, v.where("vertex % 5 <> 2"), "out", 4)
    return permute.permuted_weights(v.select("vertex", "weight"), bins, 3, seed=7)


def _perms(spark, d):
    """Order months stand for permutations of a nation's weight."""
    o = graphs.table(spark, d, "orders").join(graphs.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return settle(o.groupBy(F.month("o_orderdate").alias("perm"), F.col("c_nationkey").cast("long").alias("vertex")).agg(F.round(F.sum("o_totalprice") * 12, 2).alias("weight")))


def _perm_sql(value: str, real: str = "v", key: str = "vertex", perms: str = "p") -> str:
    """Statistics of perms (key, p) by key, for the column ``value`` of real."""
    name = "walkpermweight" if value == "walkweight" else f"perm{value}"
    return f"SELECT {key}, round(avg(p), 2) AS {name}_mean, round(stddev_samp(p), 2) AS {name}_std, round(any_value(mid), 2) AS {name}_median, round(median(abs(p - mid)) * 1.4826, 2) AS {name}_mad, count(*) FILTER (p > {value}) AS nless_{value}, count(*) FILTER (p < {value}) AS ngreater_{value}, round(any_value({value}) - any_value(mid), 2) AS {value}_delta FROM {perms} JOIN {real} USING ({key}) JOIN (SELECT {key}, median(p) AS mid FROM {perms} GROUP BY ALL) USING ({key}) GROUP BY ALL"


def _rounded(df: DataFrame, *values: str) -> DataFrame:
    names = [f"{'walkpermweight' if x == 'walkweight' else 'perm' + x}_{s}" for x in values for s in ("mean", "std", "median", "mad")] + [f"{x}_delta" for x in values]
    return _round(df, *names, digits=2)


@query("permweight_stats", f"WITH {V}, {sql.P}, q AS ({_perm_sql('weight')}) SELECT vertex, weight, q.* EXCLUDE (vertex) FROM v JOIN q USING (vertex)")
def _permweight(spark, d):
    return _rounded(stats.permweight_stats(graphs.nations(spark, d), _perms(spark, d), ["vertex"]), "weight")


@query("vertex_stats", f"WITH {V}, {sql.P}, x AS (SELECT vertex, weight, weight * 2 AS walkweight FROM v), p2 AS (SELECT perm, vertex, p * 2 + perm AS p FROM p), q AS ({_perm_sql('weight', 'x')}), r AS ({_perm_sql('walkweight', 'x', perms='p2')}) SELECT x.*, q.* EXCLUDE (vertex), r.* EXCLUDE (vertex) FROM x LEFT JOIN q USING (vertex) LEFT JOIN r USING (vertex)")
def _vertex_stats(spark, d):
    v, perms = graphs.nations(spark, d), _perms(spark, d)
    walk = v.select("vertex", (F.col("weight") * 2).alias("walkweight"))
    return _rounded(stats.vertex_stats(v, walk, perms, perms.select("perm", "vertex", (F.col("weight") * 2 + F.col("perm")).alias("walkweight"))), "weight", "walkweight")


_MONTHS = "m AS (SELECT month(l_shipdate) AS perm, s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dest, round(sum(l_extendedprice) * 12, 2) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"


def _months(spark, d):
    """Ship months stand for permutations of the trade between two nations."""
    read = lambda name: graphs.table(spark, d, name)
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy(F.month("l_shipdate").alias("perm"), F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dest"))
    return settle(sums.agg(F.round(F.sum("l_extendedprice") * 12, 2).alias("weight")))


_DIEDGES = f"x AS (SELECT src, dst AS dest, w AS weight, w * 3 AS walkweight FROM e), m3 AS (SELECT src, dest, p * 3 AS p FROM m), q AS ({_perm_sql('weight', 'x', 'src, dest', 'm')}), r AS ({_perm_sql('walkweight', 'x', 'src, dest', 'm3')})"


def _diedges(spark, d):
    e, perms = graphs.nation_trade(spark, d), _months(spark, d)
    real = e.select("src", F.col("dst").alias("dest"), F.col("w").alias("weight"), (F.col("w") * 3).alias("walkweight"))
    return real, perms, perms.select("perm", "src", "dest", (F.col("weight") * 3).alias("walkweight"))


@query("diedge_stats", f"WITH {E}, {_MONTHS}, {_DIEDGES} SELECT x.*, q.* EXCLUDE (src, dest), r.* EXCLUDE (src, dest) FROM x LEFT JOIN q USING (src, dest) LEFT JOIN r USING (src, dest)")
def _diedge(spark, d):
    return _rounded(stats.diedge_stats(*_diedges(spark, d)), "weight", "walkweight")


@query("diedge_index", f"WITH {E}, {_MONTHS}, {_DIEDGES} SELECT x.*, q.* EXCLUDE (src, dest), r.* EXCLUDE (src, dest) FROM x LEFT JOIN q USING (src, dest) LEFT JOIN r USING (src, dest)")
def _diedge_index(spark, d):
    """Pairs of nations by number: vertices from 1, so keys are moved by one."""
    number = (F.col("src") * 25 + F.col("dest") + 1).alias("diedge")
    real, perms, walk = _diedges(spark, d)
    out = stats.indexed_diedge_stats(25, real.select(number, "weight", "walkweight"), perms.select("perm", number, "weight"), walk.select("perm", number, "walkweight"))
    return _rounded(out.withColumns({"src": F.col("src") - 1, "dest": F.col("dest") - 1}), "weight", "walkweight")


def _component_input(spark, d):
    v = graphs.nations(spark, d)
    cut = v.select(F.col("region").cast("long").alias("component"), "vertex")
    rows = v.select("vertex", "weight", (F.col("weight") * 2).alias("walkweight"), (F.col("weight") >= F.lit(_threshold(v.withColumnRenamed("weight", "w")))).alias("is_hit"))
    return cut, rows, _perms(spark, d).select("perm", "vertex", "weight", (F.col("weight") * 2 + F.col("perm")).alias("walkweight"))


_HITS = "x AS (SELECT vertex, region::BIGINT AS component, weight, weight * 2 AS walkweight, weight >= (SELECT quantile_cont(weight, 0.7) FROM v) AS is_hit FROM v)"


def _means(prefix: str = "") -> str:
    return ", ".join(f"round({f}({c}), 2) AS {n}_{m}" for c, n in (("weight", f"{prefix}weight"), ("walkweight", f"walk{prefix}weight" if prefix else "walkweight")) for f, m in (("median", "median"), ("avg", "mean")))


_COMPONENTS = f"""{V}, {sql.P}, {_HITS}, s AS (SELECT component, count(*) AS nvertices, count(*) FILTER (is_hit) AS nhits, {_means()} FROM x GROUP BY 1), tot AS (SELECT count(*) FILTER (is_hit) AS h, count(*) AS n FROM x),
pp AS (SELECT component, p AS weight, p * 2 + perm AS walkweight FROM p JOIN x USING (vertex)), ps AS (SELECT component, {_means('perm')} FROM pp GROUP BY 1)"""


@query("component_stats", f"WITH {_COMPONENTS} SELECT s.*, ps.* EXCLUDE (component), round({sql.fisher('nhits', 'nvertices', 'tot.h', 'tot.n')}, 9) AS pvalue_walkweight_fisher FROM s JOIN ps USING (component), tot")
def _component_stats(spark, d):
    out = stats.component_stats(*_component_input(spark, d))
    return _round(_round(out, "pvalue_walkweight_fisher"), *[c for c in out.columns if c.endswith(("_mean", "_median"))], digits=2)


def _mw_sql(rows: str, keys: str) -> str:
    """keys, u and z of rows (keys, x, real)."""
    return f"""SELECT {keys}, u, (u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM (SELECT {keys}, sum(rank) FILTER (real) - n1 * (n1 + 1) / 2 AS u, n1, n, n - n1 AS n2, ties FROM (
SELECT {keys}, real, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0::DOUBLE AS rank FROM {rows}) JOIN (SELECT {keys}, sum(r)::DOUBLE AS n1, sum(nt)::DOUBLE AS n, sum(nt ** 3 - nt) AS ties FROM (SELECT {keys}, x, count(*) AS nt, count(*) FILTER (real) AS r FROM {rows} GROUP BY ALL) GROUP BY ALL) USING ({keys}) GROUP BY {keys}, n1, n, ties)"""


@query("component_pvalues", f"WITH {_COMPONENTS}, rw AS (SELECT component, weight AS x, true AS real FROM x UNION ALL SELECT component, weight, false FROM pp), rk AS (SELECT component, walkweight AS x, true AS real FROM x UNION ALL SELECT component, walkweight, false FROM pp), a AS ({_mw_sql('rw', 'component')}), b AS ({_mw_sql('rk', 'component')}) SELECT s.component, nvertices, nhits, round({sql.fisher('nhits', 'nvertices', 'tot.h', 'tot.n')}, 9) AS pvalue_walkweight_fisher, round({sql.tail('a.z')}, 9) AS pvalue_weight_mw, round({sql.tail('b.z')}, 9) AS pvalue_walkweight_mw FROM s JOIN a USING (component) JOIN b USING (component), tot")
def _component_pvalues(spark, d):
    out = stats.component_stats(*_component_input(spark, d), average=False, weight_tests=True, mannwhitney_tests=True)
    return _round(out, "pvalue_walkweight_fisher", "pvalue_weight_mw", "pvalue_walkweight_mw")


@query("treecut_compstats", f"WITH RECURSIVE {E}, {V}, {sql.strong()}, {sql.P}, {_HITS}, tot AS (SELECT count(*) FILTER (is_hit) AS h, count(*) AS n FROM x), c AS (SELECT t, lab.component, lab.vertex FROM lab WHERE t IN (SELECT t FROM tt)), s AS (SELECT t, c.component, count(*) AS size, count(*) FILTER (is_hit) AS hits FROM c JOIN x USING (vertex) GROUP BY 1, 2 HAVING count(*) > 1), rr2 AS (SELECT c.t, c.component, walkweight AS x, true AS real FROM c JOIN x USING (vertex) UNION ALL SELECT c.t, c.component, p * 2 + perm + 1000 * range, false FROM c JOIN p USING (vertex), range(0, 3)), mw AS ({_mw_sql('rr2', 't, component')}), pv AS (SELECT s.*, {sql.fisher('hits', 'size', 'tot.h', 'tot.n')} AS f, {sql.tail('mw.z')} AS m FROM s JOIN mw USING (t, component), tot) SELECT tt.t AS threshold, count(*) FILTER (f <= 0.5) AS ncomponents_signif_fisher, coalesce(sum(size) FILTER (f <= 0.5), 0)::BIGINT AS components_signif_sizesum_fisher, count(*) FILTER (m <= 0.6) AS ncomponents_signif_mw, coalesce(sum(size) FILTER (m <= 0.6), 0)::BIGINT AS components_signif_sizesum_mw FROM tt LEFT JOIN pv USING (t) GROUP BY 1")
def _compstats(spark, d):
    e, v, merge, cut, a, b = _flow_input(spark, d)
    _, rows, perms = _component_input(spark, d)
    perms = perms.select("perm", "vertex", "weight", F.explode(F.array(*[F.col("walkweight") + 1000 * k for k in range(3)])).alias("walkweight"))  # more than 50 values in any component
    return stats.treecut_compstats(cut, rows, perms, mannwhitney_tests=True, pvalue_mw_max=0.6, pvalue_fisher_max=0.5)


def _binned(spark, d):
    """Months as replicas: thresholds are a customer's order prices, metrics their counts and values by month."""
    o = graphs.table(spark, d, "orders").select(F.month("o_orderdate").alias("perm"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("threshold"), "o_totalprice")
    rows = o.groupBy("perm", "threshold").agg(F.count("*").alias("ncomponents"), F.round(F.max("o_totalprice"), 2).alias("maxcomponent_size"))
    return settle(rows)


_ROWS = "r AS (SELECT month(o_orderdate) AS perm, floor(o_totalprice / 1000)::DOUBLE AS threshold, count(*) AS ncomponents, round(max(o_totalprice), 2) AS maxcomponent_size FROM orders GROUP BY 1, 2)"


def _bounds_sql(rows: str, nbins: int, name: str = "bd") -> str:
    """name(bound), the greedy boundaries over the thresholds of rows."""
    return f"""{name}_i AS (SELECT threshold, row_number() OVER (ORDER BY threshold) AS i, count(*) OVER () AS n FROM {rows}),
{name}_w(bound, place) AS (SELECT threshold, i FROM {name}_i WHERE i = 1 UNION ALL SELECT arg_min(threshold, i), min(i) FROM {name}_w JOIN {name}_i ON threshold > bound AND ((i + 1 - place) * {nbins} >= n OR i = n) GROUP BY bound, place), {name} AS (SELECT list_sort(list(bound)) AS b FROM {name}_w)"""


_BIN = "len(list_filter(bd.b, lambda x: x <= threshold))::INT AS threshold_bin"
_ENDS_OF = "CASE WHEN threshold_bin > 0 AND threshold_bin < len(bd.b) THEN bd.b[threshold_bin] END AS threshold_binmin, CASE WHEN threshold_bin > 0 AND threshold_bin < len(bd.b) THEN bd.b[threshold_bin + 1] END AS threshold_binmax"
_BINNED = f"g AS (SELECT perm, {_BIN}, ncomponents, maxcomponent_size FROM src_rows, bd), bn AS (SELECT perm, threshold_bin, median(ncomponents) AS ncomponents, median(maxcomponent_size) AS maxcomponent_size FROM g GROUP BY 1, 2), bins AS (SELECT bn.*, {_ENDS_OF}, (threshold_binmin + threshold_binmax) / 2 AS threshold_binmid FROM bn, bd)"


@query("threshold_bins", f"WITH RECURSIVE {_ROWS}, {_bounds_sql('r', 20)} SELECT unnest(b) AS bound FROM bd")
def _threshold_bins(spark, d):
    return spark.createDataFrame([(b,) for b in stats.threshold_bins(_binned(spark, d), 20)], "bound double")


@query("bin_treecut_stats", f"WITH RECURSIVE {_ROWS}, {_bounds_sql('r', 20)}, src_rows AS (SELECT * FROM r), {_BINNED} SELECT * FROM bins")
def _bin(spark, d):
    return stats.bin_treecut_stats(_binned(spark, d), ["perm"], 20)


@query("add_bins", "WITH r AS (SELECT month(o_orderdate) AS perm, floor(o_totalprice / 1000)::DOUBLE AS threshold, count(*) AS n FROM orders GROUP BY 1, 2) SELECT perm, threshold, n, len(list_filter([50, 100, 200, 400], lambda b: b <= threshold))::INT AS threshold_bin FROM r")
def _add_bins(spark, d):
    return stats.add_bins(_binned(spark, d).select("perm", "threshold", F.col("ncomponents").alias("n")), [50, 100, 200, 400])


_QUANTILES = [0.025, 0.25, 0.5, 0.75, 0.975]
_AGGREGATED = f"qa AS (SELECT threshold_bin, any_value(threshold_binmid) AS threshold_binmid, quantile_cont(ncomponents, {_QUANTILES}) AS a, quantile_cont(maxcomponent_size, {_QUANTILES}) AS m FROM bins GROUP BY 1), agg AS (SELECT threshold_bin, threshold_binmid, unnest({_QUANTILES})::DOUBLE AS quantile, unnest(a) AS ncomponents, unnest(m) AS maxcomponent_size FROM qa)"


@query("aggregate_binstats", f"WITH RECURSIVE {_ROWS}, {_bounds_sql('r', 20)}, src_rows AS (SELECT * FROM r), {_BINNED}, {_AGGREGATED} SELECT threshold_bin, threshold_binmid, quantile, round(ncomponents, 9) AS ncomponents, round(maxcomponent_size, 6) AS maxcomponent_size FROM agg")
def _aggregate(spark, d):
    out = stats.aggregate_binstats(stats.bin_treecut_stats(_binned(spark, d), ["perm"], 20))
    return _round(_round(out, "ncomponents"), "maxcomponent_size", digits=6)


def _extreme_sql() -> str:
    metrics = ("ncomponents", "maxcomponent_size")
    near = lambda k, tag: f"SELECT quantile, threshold_bin + {k} AS threshold_bin, threshold_binmid AS mid_{tag}, ncomponents AS ncomponents_{tag}, maxcomponent_size AS maxcomponent_size_{tag} FROM agg"
    end = lambda c: f"CASE WHEN threshold < mid_own THEN coalesce({c}_prev, {c}_own) ELSE coalesce({c}_next, {c}_own) END"
    at = lambda c: f"{c}_own * (1 - k) + {end(c)} * k"
    long = " UNION ALL ".join(f"SELECT quantile, threshold, threshold_bin, '{c}' AS metric, {c}::DOUBLE AS value, {at(c)} AS permuted_value FROM kk" for c in metrics)
    parts = []
    for stat, sign in (("min", 1), ("max", -1)):
        rows = f"(SELECT *, CASE WHEN delta IS NULL OR isnan(delta) THEN 'infinity'::DOUBLE ELSE {sign} * delta END AS s FROM lg)"
        tail = f"(SELECT *, quantile_cont(s, 0.25) OVER (PARTITION BY quantile, metric) AS limit_ FROM {rows})"
        for kind, order, where in (("opt", "s, threshold", "true"), ("small", "threshold DESC", "s <= limit_"), ("big", "threshold", "s <= limit_")):
            parts.append(f"SELECT quantile, metric, '{stat}' AS stat, '{kind}' AS value_type, value, permuted_value, delta, threshold, threshold_bin FROM {tail} WHERE {where} QUALIFY row_number() OVER (PARTITION BY quantile, metric ORDER BY {order}) = 1")
    return f"""WITH RECURSIVE {_ROWS}, {_bounds_sql('r', 20)}, src_rows AS (SELECT * FROM r WHERE perm > 1), {_BINNED}, {_AGGREGATED}, real AS (SELECT threshold, {_BIN}, ncomponents, maxcomponent_size FROM r, bd WHERE perm = 1),
b3 AS (SELECT * FROM ({near(0, 'own')}) LEFT JOIN ({near(-1, 'next')}) USING (quantile, threshold_bin) LEFT JOIN ({near(1, 'prev')}) USING (quantile, threshold_bin)),
j AS (SELECT real.*, b3.* EXCLUDE (threshold_bin) FROM real LEFT JOIN b3 USING (threshold_bin)), gap AS (SELECT *, mid_own - ({end('mid')}) AS gap FROM j), kk AS (SELECT *, CASE WHEN gap <> 0 THEN (mid_own - threshold) / gap END AS k FROM gap),
lg AS (SELECT *, value - permuted_value AS delta FROM ({long})), found AS ({" UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)})
SELECT quantile, metric, stat, value_type, round(value, 2) AS value, round(permuted_value, 6) AS permuted_value, round(delta, 6) AS delta, threshold, threshold_bin FROM found"""


@query("extreme_treecut_stats", _extreme_sql())
def _extreme(spark, d):
    rows = _binned(spark, d)
    bounds = stats.threshold_bins(rows, 20)
    replicas = stats.add_bins(rows.where("perm > 1"), bounds)
    medians = replicas.groupBy("perm", "threshold_bin").agg(F.median("ncomponents").alias("ncomponents"), F.median("maxcomponent_size").alias("maxcomponent_size"))
    agg = settle(stats.aggregate_binstats(stats.with_bin_ends(medians, bounds)))
    out = stats.extreme_treecut_stats(stats.add_bins(rows.where("perm = 1"), bounds).drop("perm"), agg)
    return _round(_round(out, "permuted_value", "delta", digits=6), "value", digits=2)


@query("value_group_sizes", "SELECT r.range AS value, count(l_orderkey) AS n FROM range(1, 101) r LEFT JOIN lineitem ON l_quantity::BIGINT = r.range GROUP BY 1")
def _sizes(spark, d):
    return scalar.value_group_sizes(graphs.table(spark, d, "lineitem"), "l_quantity", 100)


@query("value_groups", "SELECT r.range AS value, coalesce(string_agg(n_nationkey, ',' ORDER BY n_nationkey), '') AS places FROM range(1, 8) r LEFT JOIN nation ON n_regionkey = r.range GROUP BY 1")
def _groups(spark, d):
    out = scalar.value_groups(graphs.table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("long")), "n_regionkey", "k", 7)
    return out.select("value", F.array_join("places", ",").alias("places"))


def _parts(spark, d):
    n = graphs.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("int"))).alias("part"))
    return n.select(F.floor(F.col("n_regionkey") / 3).cast("int").alias("g"), "part").groupBy("g").agg(F.array_sort(F.collect_list("part")).alias("parts"))


_PARTS = "n AS (SELECT n_regionkey, list_sort(list(n_nationkey::INT)) AS part FROM nation GROUP BY 1), q AS (SELECT (n_regionkey // 3)::INT AS g, list_sort(list(part)) AS parts FROM n GROUP BY 1)"


_STARTS = "list_transform(range(0, len(parts) + 1), lambda k: 1 + coalesce(list_sum(list_transform(parts[1:k], lambda p: len(p))), 0)::INT)"


@query("partition_ops", f"WITH {_PARTS} SELECT g, len(parts)::INT AS nparts, len(flatten(parts))::INT AS nelems, array_to_string(list_transform(parts, lambda p: len(p)), ',') AS lengths, array_to_string(flatten(parts), ',') AS elems, array_to_string({_STARTS}, ',') AS starts, array_to_string(list_append(flatten(parts), 99), ',') AS pushed, (len(parts[len(parts)]) + 1)::INT AS last_length FROM q")
def _partition(spark, d):
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    p = _parts(spark, d).withColumn("more", scalar.push_element(F.col("parts"), F.lit(99)))
    return p.select("g", F.size("parts").alias("nparts"), F.size(F.flatten("parts")).alias("nelems"), text(scalar.part_lengths(F.col("parts"))).alias("lengths"), text(F.flatten("parts")).alias("elems"), text(scalar.part_starts(F.col("parts"))).alias("starts"), text(F.flatten("more")).alias("pushed"), F.size(F.element_at("more", -1)).alias("last_length"))


@query("partition_repeat", f"WITH {_PARTS} SELECT g, (len(parts) * 3)::INT AS nparts, array_to_string(flatten(list_concat(parts, parts, parts)), ',') AS elems FROM q")
def _repeat(spark, d):
    p = _parts(spark, d).withColumn("r", scalar.repeat_parts(F.col("parts"), 3))
    return p.select("g", F.size("r").alias("nparts"), F.array_join(F.flatten("r").cast("array<string>"), ",").alias("elems"))


@query("partition_reset", "SELECT n_regionkey AS k, array_to_string(range(1, n_nationkey + 1), ',') AS elems, n_nationkey::INT AS nparts, 1 AS whole_parts, array_to_string(range(1, n_nationkey + 1), ',') AS whole FROM nation")
def _reset(spark, d):
    n = graphs.table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("int").alias("n"))
    text = lambda x: F.array_join(F.flatten(x).cast("array<string>"), ",")
    alone, whole = scalar.reset_parts(F.col("n")), scalar.reset_parts(F.col("n"), 1)
    return n.select("k", text(alone).alias("elems"), F.size(alone).alias("nparts"), F.size(whole).alias("whole_parts"), text(whole).alias("whole"))


@query("filter_parts", f"WITH {_PARTS} SELECT g, len(list_filter(parts, lambda p: list_sum(p) > 55))::INT AS kept FROM q")
def _filter_parts(spark, d):
    return _parts(spark, d).select("g", F.size(scalar.filter_parts(F.col("parts"), lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x) > 55)).alias("kept"))


@query("insert_sorted", f"WITH {_PARTS} SELECT g, array_to_string(list_sort(list_append(flatten(parts), 7)), ',') AS xs, len(list_distinct(list_append(flatten(parts), 7)))::INT AS n FROM q")
def _insert(spark, d):
    x = F.flatten("parts")
    return _parts(spark, d).select("g", F.array_join(scalar.insert_sorted(x, F.lit(7)).cast("array<string>"), ",").alias("xs"), F.size(scalar.insert_sorted(x, F.lit(7), True)).alias("n"))


@query("hilbert_order", "SELECT * FROM (VALUES (1, 1, 1), (1, 2, 2), (1, 3, 15), (1, 4, 16), (2, 1, 4), (2, 2, 3), (2, 3, 14), (2, 4, 13), (3, 1, 5), (3, 2, 8), (3, 3, 9), (3, 4, 12), (4, 1, 6), (4, 2, 7), (4, 3, 10), (4, 4, 11)) t(i, j, place)")
def _hilbert(spark, d):
    grid = spark.range(16).select((F.col("id") / 4 + 1).cast("int").alias("i"), (F.col("id") % 4 + 1).cast("int").alias("j"))
    return grid.select("i", "j", scalar.hilbert_order(F.col("i"), F.col("j"), 4).alias("place"))


@query("quantile_suffix", "SELECT * FROM (VALUES (0.025::DOUBLE, '025'), (0.25, '25'), (0.5, '50'), (0.75, '75'), (0.975, '975')) t(q, suffix)")
def _suffix(spark, d):
    return spark.createDataFrame([(q,) for q in (0.025, 0.25, 0.5, 0.75, 0.975)], "q double").select("q", scalar.quantile_suffix(F.col("q")).alias("suffix"))


@query("ecdf", "WITH s AS (SELECT l_returnflag, l_quantity::DOUBLE AS value, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, value, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY value) / sum(w) OVER (PARTITION BY l_returnflag), 9) AS cdf FROM s")
def _ecdf(spark, d):
    rows = graphs.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"))
    return _round(scalar.ecdf(rows, "x", by=["l_returnflag"]).select("l_returnflag", "value", "cdf"), "cdf")


_QUANTITIES = "s AS (SELECT l_quantity::DOUBLE AS value, sum(l_extendedprice) AS w FROM lineitem GROUP BY 1), f AS (SELECT value, sum(w) OVER (ORDER BY value) / sum(w) OVER () AS cdf FROM s), l AS (SELECT *, lead(value) OVER (ORDER BY value) AS nv, lead(cdf) OVER (ORDER BY value) AS nc FROM f)"


@query("ecdf_at", f"WITH {_QUANTITIES}, x AS (SELECT DISTINCT round(o_totalprice / 9000, 1) AS x FROM orders) SELECT x.x, round(coalesce(CASE WHEN nv IS NULL THEN cdf ELSE cdf + (x.x - value) / (nv - value) * (nc - cdf) END, 0), 9) AS f FROM x LEFT JOIN l ON x.x >= value AND (nv IS NULL OR x.x < nv)")
def _ecdf_at(spark, d):
    steps = scalar.ecdf(graphs.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("p")), "x", "p")
    points = graphs.table(spark, d, "orders").select(F.round(F.col("o_totalprice") / 9000, 1).alias("x")).distinct()
    return _round(scalar.ecdf_at(steps, points, interpolate=True).select("x", "f"), "f")


@query("ecdf_range", "SELECT l_returnflag, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY 1")
def _ecdf_range(spark, d):
    rows = graphs.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"))
    return scalar.ecdf_range(scalar.ecdf(rows, "x", by=["l_returnflag"]), ["l_returnflag"])


#: At one threshold: tq, the vertices of used components (used), traced steps, flows and all directed edges (di).
_EXPORT = f"""WITH RECURSIVE {sql.flows("t = (SELECT t FROM tq)", _AT)}, {sql.VERTEX_FLOWS}, {sql.SUBGRAPH}, uc AS (SELECT src_comp AS component FROM sub UNION SELECT dst_comp FROM sub), used AS (SELECT c.vertex, c.component FROM c JOIN uc USING (component)),
st AS (SELECT src, dst FROM e, tq WHERE w >= 0.75 * tq.t), kept AS (SELECT src, dst FROM e, tq WHERE w >= tq.t AND src IN (SELECT vertex FROM used) AND dst IN (SELECT vertex FROM used)),
hops AS (SELECT k.src, k.dst FROM kept k JOIN st ON st.src = k.src AND st.dst = k.dst UNION SELECT a.src, a.dst FROM kept k JOIN st a ON a.src = k.src JOIN st b ON b.src = a.dst AND b.dst = k.dst AND a.dst <> k.src AND a.dst <> k.dst UNION SELECT b.src, b.dst FROM kept k JOIN st a ON a.src = k.src JOIN st b ON b.src = a.dst AND b.dst = k.dst AND a.dst <> k.src AND a.dst <> k.dst),
shown AS (SELECT vf.*, CASE WHEN src_comp = dst_comp THEN 'loop' ELSE 'flow' END AS flow FROM vf WHERE target IN (SELECT vertex FROM used)),
og AS (SELECT src AS source, dst AS target, w AS weight, CASE WHEN src < dst THEN 'up' ELSE 'down' END AS diedge_type FROM e WHERE (src + 2 * dst) % 3 <> 0),
d0 AS (SELECT source, target, walkweight, coalesce((SELECT w FROM e WHERE e.src = sub.target AND e.dst = sub.source), 0) AS walkweight_rev, NULL::VARCHAR AS flow, NULL::INT AS flowlen, NULL::DOUBLE AS floweight FROM sub
  UNION ALL SELECT src, dst, NULL, NULL, 'trace', NULL, NULL FROM hops WHERE (src, dst) NOT IN (SELECT (source, target) FROM sub) UNION ALL SELECT source, target, tq.t, tq.t, flow, len, minweight FROM shown, tq),
di AS (SELECT d0.*, weight, diedge_type, weight IS NOT NULL AS is_original FROM d0 LEFT JOIN og USING (source, target))"""
_EXPORT_SQL = {
    "components": "SELECT component, component AS component0, count(*) AS nvertices, component IN (SELECT component FROM uc) AS is_used FROM c GROUP BY 1",
    "vertices": """, touched AS (SELECT source AS vertex FROM di UNION SELECT target FROM di), fto AS (SELECT source AS vertex, string_agg(DISTINCT target || ':' || len, ';' ORDER BY target || ':' || len) AS flows_to, count(DISTINCT (target, len)) AS nflows_to, string_agg(DISTINCT target, ',' ORDER BY target) FILTER (flow = 'loop') AS loops_through, count(DISTINCT target) FILTER (flow = 'loop') AS nloops_through FROM shown GROUP BY 1),
fro AS (SELECT target AS vertex, string_agg(DISTINCT source || ':' || len, ';' ORDER BY source || ':' || len) AS flows_from, count(DISTINCT (source, len)) AS nflows_from FROM shown GROUP BY 1)
SELECT vertex, coalesce(used.component, 0) AS component, used.component IS NULL AS is_steptrace, region = 0 AS is_source, region = 1 AS is_sink, v.weight, flows_to, nflows_to, loops_through, nloops_through, flows_from, nflows_from FROM touched JOIN v USING (vertex) LEFT JOIN used USING (vertex) LEFT JOIN fto USING (vertex) LEFT JOIN fro USING (vertex)""",
    "diedges": "SELECT * FROM di",
    "edges": """, o AS (SELECT *, coalesce(walkweight, 0) < coalesce(walkweight_rev, 0) AS r, CASE WHEN r THEN target ELSE source END AS s, CASE WHEN r THEN source ELSE target END AS t FROM di)
SELECT s AS source, t AS target, bool_or(flowlen IS NOT NULL) AS has_flow, bool_and(coalesce(flow, '') = 'trace') AS has_trace, bool_or(flowlen IS NULL) AS has_walk, max(walkweight) FILTER (flowlen IS NULL AND NOT r) AS walkweight, max(walkweight) FILTER (flowlen IS NULL AND r) AS walkweight_rev, bool_or(is_original AND NOT r) AS has_original, bool_or(is_original AND r) AS has_original_rev,
  any_value(diedge_type) FILTER (is_original AND NOT r) AS original_type, any_value(diedge_type) FILTER (is_original AND r) AS original_type_rev, any_value(weight) FILTER (is_original AND NOT r) AS weight, any_value(weight) FILTER (is_original AND r) AS weight_rev FROM o GROUP BY 1, 2 HAVING bool_or(flowlen IS NULL)""",
}


def _exported(name: str):
    def run(spark, d):
        e, v = _nation(spark, d)
        orig = e.where("(src + 2 * dst) % 3 <> 0").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("weight"), F.when(F.col("src") < F.col("dst"), "up").otherwise("down").alias("diedge_type"))
        out = export.export_flowgraph(hierarchy.merge_table(e), e, v, _regions(v, 0), _regions(v, 1), _at(e), orig=orig, steps=e, flowpaths="stepedges", vertex_stats=v.select("vertex", "weight"))[name]
        if name != "vertices":
            return out
        pairs = lambda c: F.array_join(F.array_sort(F.transform(c, lambda p: F.concat(p["vertex"], F.lit(":"), p["flowlen"]))), ";")
        loops = F.array_join(F.transform("loops_through", lambda x: x.cast("string")), ",")
        return out.withColumns({"flows_to": pairs("flows_to"), "flows_from": pairs("flows_from"), "loops_through": loops})

    return run


for _name, _text in _EXPORT_SQL.items():
    query(f"export_{_name}", f"{_EXPORT} {_text}")(_exported(_name))


@query("export_flowpaths", f"""{_EXPORT}, pth AS (SELECT k.src AS source, k.dst AS target, '' AS path FROM kept k JOIN st ON st.src = k.src AND st.dst = k.dst UNION SELECT k.src, k.dst, a.dst::VARCHAR FROM kept k JOIN st a ON a.src = k.src JOIN st b ON b.src = a.dst AND b.dst = k.dst AND a.dst <> k.src AND a.dst <> k.dst)
SELECT source, target, (SELECT string_agg(path, ';' ORDER BY path) FROM pth WHERE pth.source = sub.source AND pth.target = sub.target) AS flowpaths FROM sub""")
def _flowpaths(spark, d):
    e, v = _nation(spark, d)
    out = export.export_flowgraph(hierarchy.merge_table(e), e, v, _regions(v, 0), _regions(v, 1), _at(e), steps=e, flowpaths="flowattr")["diedges"]
    text = F.array_join(F.array_sort(F.transform("flowpaths", lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ","))), ";")
    return out.where("flow is null").select("source", "target", text.alias("flowpaths"))


@query("missing_stats", f"WITH {E}, {V} SELECT src AS source, dst AS target, w FROM e WHERE (src, dst) NOT IN (SELECT (s_nationkey, c_nationkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50)")
def _missing(spark, d):
    """Trade between nations without an order of the largest quantity."""
    read = lambda name: graphs.table(spark, d, name)
    big = read("lineitem").where("l_quantity >= 50").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    have = big.select(F.col("s_nationkey").cast("long").alias("source"), F.col("c_nationkey").cast("long").alias("target")).distinct()
    rows = graphs.nation_trade(spark, d).select(F.col("src").alias("source"), F.col("dst").alias("target"), "w")
    return export.missing_stats(rows, have, ["source", "target"])


@query("flagship", f"""WITH RECURSIVE {E}, {V}, {STEP}, {sql.walk()}, wk AS (SELECT src, dst, w FROM x{sql.ROUNDS} WHERE src <> dst), t AS (SELECT quantile_cont(w, 0.7) AS t FROM wk), k AS (SELECT src, dst FROM wk, t WHERE w >= t.t), r(s, d) AS (SELECT vertex, vertex FROM v UNION SELECT r.s, k.dst FROM r JOIN k ON k.src = r.d),
lab AS (SELECT min(a.d) AS component, a.s AS vertex FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY a.s) SELECT component, count(*) AS nvertices FROM lab GROUP BY 1""")
def _flagship(spark, d):
    return flagship(spark, d)


@query("fisher_pvalue", f"WITH x AS (SELECT n_regionkey, count(*) AS n, count(*) FILTER (n_nationkey < 12) AS hits FROM nation GROUP BY 1) SELECT n_regionkey, round({sql.fisher('hits', 'n', '12', '25')}, 9) AS p FROM x")
def _fisher(spark, d):
    rows = graphs.table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum((F.col("n_nationkey") < 12).cast("int")).alias("hits"))
    return rows.select("n_regionkey", F.round(scalar.fisher_pvalue(F.col("hits"), F.col("n"), F.lit(12), F.lit(25)), 9).alias("p"))


@query("mannwhitney", f"WITH x AS (SELECT l_returnflag, l_quantity AS x, l_linestatus = 'O' AS real FROM lineitem WHERE l_linenumber < 4 OR l_quantity < 20), m AS ({_mw_sql('x', 'l_returnflag')}) SELECT l_returnflag, u, round({sql.tail('z')}, 9) AS pvalue FROM m")
def _mw(spark, d):
    rows = graphs.table(spark, d, "lineitem").where("l_linenumber < 4 or l_quantity < 20").select("l_returnflag", "l_quantity", (F.col("l_linestatus") == "O").alias("real"))
    return _round(scalar.mannwhitney(rows, ["l_returnflag"], "l_quantity", "real"), "pvalue")


@query("mannwhitney_exact", """WITH c AS (SELECT c_nationkey AS k, count(*) % 4 AS x FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) % 4 AS x FROM supplier GROUP BY 1), r AS (SELECT n_regionkey, coalesce(c.x, 0) AS x, true AS real, n_nationkey AS i FROM nation LEFT JOIN c ON c.k = n_nationkey UNION ALL SELECT n_regionkey, coalesce(s.x, 0), false, n_nationkey FROM nation LEFT JOIN s ON s.k = n_nationkey),
k AS (SELECT *, 2 * rank() OVER (PARTITION BY n_regionkey ORDER BY x) + count(*) OVER (PARTITION BY n_regionkey, x) - 1 AS r2, row_number() OVER (PARTITION BY n_regionkey ORDER BY real, i) - 1 AS bit FROM r), o AS (SELECT n_regionkey, sum(r2) FILTER (real) AS got FROM k GROUP BY 1),
m AS (SELECT n_regionkey, range AS mask, sum(r2) AS s FROM k, range(0, 1024) WHERE bit_count(range) = 5 AND (range >> bit) & 1 = 1 GROUP BY 1, 2) SELECT n_regionkey, any_value(got) / 2 - 15.0::DOUBLE AS u, round(count(*) FILTER (s >= got) / count(*), 9) AS pvalue FROM m JOIN o USING (n_regionkey) GROUP BY 1""")
def _mw_exact(spark, d):
    """Five nations of a region, customers against suppliers, counted modulo 4 for ties: ten values, so the test is exact."""
    n = graphs.table(spark, d, "nation")
    counts = lambda name, key: graphs.table(spark, d, name).groupBy(F.col(key).alias("k")).agg((F.count("*") % 4).alias("x"))
    one = lambda name, key, real: n.join(counts(name, key), F.col("n_nationkey") == F.col("k"), "left").select("n_regionkey", F.coalesce("x", F.lit(0)).alias("x"), F.lit(real).alias("real"))
    return _round(scalar.mannwhitney(one("customer", "c_nationkey", True).union(one("supplier", "s_nationkey", False)), ["n_regionkey"], "x", "real"), "pvalue")


@query("index_values_rev", "WITH s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) SELECT src, dst, w, dense_rank() OVER (ORDER BY w DESC)::INT AS rank FROM s WHERE w >= 40")
def _index_rev(spark, d):
    return edges.index_values(graphs.supplier_parts(spark, d), EdgeTest(40.0, rev=True))


@query("condense_rev", "WITH s AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) SELECT s_nationkey::BIGINT AS src_part, (dst % 25)::BIGINT AS dst_part, min(w) AS w FROM s JOIN supplier ON src = s_suppkey WHERE s_nationkey <> dst % 25 GROUP BY 1, 2")
def _condense_rev(spark, d):
    parts = graphs.table(spark, d, "part").select(F.col("p_partkey").alias("vertex"), (F.col("p_partkey") % 25).alias("part"))
    sups = graphs.table(spark, d, "supplier").select(F.col("s_suppkey").alias("vertex"), F.col("s_nationkey").cast("long").alias("part"))
    return edges.condense(graphs.supplier_parts(spark, d), parts, sups, EdgeTest(rev=True), zerodiag=True)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
