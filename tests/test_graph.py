"""Known answers on small graphs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.functions import scalar
from lumigraph.operators import connect, diffusion, edges, export, flows, hierarchy, permute, ranks, stats
from lumigraph.operators.edges import EdgeTest
from lumigraph.plans import catalog
from lumigraph.sources import graphs
from lumigraph.tables import settle


def vertices(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("vertex"))


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.vertex)
    return {frozenset(x) for x in out.values()}


def parts(*groups):
    return {frozenset(g) for g in groups}


@pytest.fixture(scope="module")
def merges(spark):
    g = graphs.tarjan_graph(spark)
    return hierarchy.merge_table(g), hierarchy.merge_table(g, EdgeTest(rev=True))


def test_thresholds(merges):
    assert [r.threshold for r in hierarchy.thresholds(merges[0]).collect()] == [8, 12, 13, 30]
    assert [r.threshold for r in hierarchy.thresholds(merges[1], True).collect()] == [50, 45, 35, 16, 12]


def forests(table):
    return {(r.u, r.v, r.m) for r in table.collect()}


def test_bisection_of_random_graphs():
    """Components at every threshold against reachability by matrix products; the forest has fewer rows than there are vertices."""
    r = np.random.default_rng(0)
    for _ in range(200):
        n, m = int(r.integers(2, 12)), int(r.integers(1, 40))
        a, b, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(1, 8, m).astype(float)
        kept = a != b
        a, b, w = a[kept], b[kept], w[kept]
        if not len(a):
            continue
        u, v, t = hierarchy.bisect(a, b, w)
        assert len(u) < n
        for x in np.unique(w):
            reach = np.eye(n, dtype=bool)
            reach[a[w >= x], b[w >= x]] = True
            for _ in range(4):
                reach = reach @ reach
            assert (connect.label_min(n, u[t >= x], v[t >= x]) == (reach & reach.T).argmax(1)).all()


def test_bisection_by_joins(spark, merges):
    """Parts too large for a task are halved with joins and give the same components."""
    g, v = graphs.tarjan_graph(spark), vertices(spark, 7)
    far = hierarchy.merge_table(g, local=1)
    assert [r.threshold for r in hierarchy.thresholds(far).collect()] == [8, 12, 13, 30] and far.count() == 6
    for t in (8, 12, 13, 30):
        assert sets(hierarchy.cut(far, v, t)) == sets(hierarchy.cut(merges[0], v, t))
    with pytest.raises(ValueError):
        hierarchy.merge_table(g, method="other")


def same_cuts(n, a, b):
    """Whether two forests of merges (u, v, m) of vertices 0..n-1 have the same components at every threshold."""
    return all((connect.label_min(n, a[0][a[2] >= t], a[1][a[2] >= t]) == connect.label_min(n, b[0][b[2] >= t], b[1][b[2] >= t])).all() for t in np.union1d(a[2], b[2]))


def merge_arrays(table):
    pdf = table.toPandas()
    return pdf.u.to_numpy(), pdf.v.to_numpy(), pdf.m.to_numpy()


def test_spanning_forests_of_random_graphs():
    """Of edges in both directions, a strongest spanning forest has the components that the bisection finds."""
    r = np.random.default_rng(1)
    for _ in range(200):
        n, m = int(r.integers(2, 12)), int(r.integers(0, 40))
        a, b, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(1, 8, m).astype(float)
        at = hierarchy.spanning(a, b, w)
        forest = a[at], b[at], w[at]
        assert len(at) == n - len(np.unique(connect.label_min(n, a, b)))
        assert same_cuts(n, forest, hierarchy.bisect(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])))


@pytest.mark.parametrize("local, rounds", [(1 << 20, 0), (300, 1)])
def test_merges_in_both_directions(spark, monkeypatch, local, rounds):
    """Shares that a task thins, and contraction where they leave too much, give the forest of one task."""
    r = np.random.default_rng(2)
    a = np.concatenate([r.integers(0, 40, 4000), r.integers(500, 1000, 700)])  # few ids with many others, and a sparse part
    b = np.concatenate([r.integers(40, 500, 4000), r.integers(500, 1000, 700)])
    w = r.integers(1, 30, len(a)).astype(float)
    e = settle(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), w.tolist())), "src long, dst long, w double"))
    own = a != b
    a, b, w = a[own], b[own], w[own]
    want = hierarchy.bisect(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]))
    contract, calls = hierarchy._contract, []
    monkeypatch.setattr(hierarchy, "_contract", lambda *x: calls.append(1) or contract(*x))
    got = merge_arrays(hierarchy.merge_table(e, local=local, both=True))
    assert len(calls) >= rounds and (rounds or not calls)
    assert len(got[0]) == len(want[0]) and same_cuts(1000, got, want)
    back = merge_arrays(hierarchy.merge_table(e, EdgeTest(rev=True), local=local, both=True))
    want = hierarchy.bisect(np.concatenate([a, b]), np.concatenate([b, a]), -np.concatenate([w, w]))
    assert same_cuts(1000, (back[0], back[1], -back[2]), want)


def test_no_edges_in_both_directions(spark):
    none = graphs.edges(spark, [])
    assert hierarchy.merge_table(none, both=True).isEmpty() and hierarchy.merge_table(graphs.edges(spark, [(1, 1, 2.0)]), local=0, both=True).isEmpty()


def test_supplier_part_cuts(spark, tmp_path, monkeypatch):
    """Against the SQL, where supplier keys reach those of the parts; the hierarchy is found without the depth-first search."""
    import duckdb

    rows = [(10_000_005, 5, 40.0), (10_000_005, 5, 30.0), (7, 6, 95.0), (7, 5, 20.0), (8, 6, 130.0), (20_000_000, 9, 61.0), (10_000_006, 10_000_006, 90.0), (9, 1, 59.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")

    def refuse(*_):
        raise AssertionError("bisection of edges that count in both directions")

    monkeypatch.setattr(hierarchy, "_merges", refuse)
    got = sorted(tuple(r) for r in catalog.QUERIES["supplier_part_cuts"](spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(catalog.ORACLES["supplier_part_cuts"]).fetchall())


def test_components_of_many_graphs(spark):
    rows = [("x", 1, 2), ("x", 3, 2), ("x", 5, 5), ("y", 1, 2), ("y", 2, 1), ("y", 2, 3), ("y", 3, 4), ("y", 4, 3), ("z", 9, 8)]
    e = spark.createDataFrame(rows, "key string, a long, b long")
    weak = {("x", 1): 1, ("x", 2): 1, ("x", 3): 1, ("x", 5): 5, ("y", 1): 1, ("y", 2): 1, ("y", 3): 1, ("y", 4): 1, ("z", 8): 8, ("z", 9): 8}
    strong = {("x", 1): 1, ("x", 2): 2, ("x", 3): 3, ("x", 5): 5, ("y", 1): 1, ("y", 2): 1, ("y", 3): 3, ("y", 4): 3, ("z", 8): 8, ("z", 9): 9}
    for local in (100, 2, 0):
        assert {(r.key, r.id): r.component for r in connect.components(e, local).collect()} == weak
        assert {(r.key, r.id): r.component for r in connect.strong_components(e, local).collect()} == strong


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.lit(2.0).alias("w")).repartition(5)
    assert all(r.k == r.x + 1 for r in ranks.numbered(df, ["x"], "k").collect())
    assert all(r.s == 2 * r.x + 2 for r in ranks.running(df, ["x"], "w", "s").collect())
    assert ranks.numbered(df.limit(0), ["x"], "k").isEmpty()


@pytest.mark.parametrize("t, groups", [(0, [range(1, 8)]), (12, [[1, 2, 3, 4, 5, 7], [6]]), (13, [[2, 3, 4, 5, 7], [1], [6]]), (30, [[2, 3, 7], [4], [5], [1], [6]]), (31, [[k] for k in range(1, 8)])])
def test_cut(spark, merges, t, groups):
    assert sets(hierarchy.cut(merges[0], vertices(spark, 7), t)) == parts(*groups)


@pytest.mark.parametrize("t, groups", [(0, [[k] for k in range(1, 8)]), (35, [[1, 2, 7], [4, 5], [3], [6]]), (45, [[1, 2, 3, 7], [4, 5], [6]]), (50, [range(1, 8)])])
def test_reversed_cut(spark, merges, t, groups):
    assert sets(hierarchy.cut(merges[1], vertices(spark, 7), t, rev=True)) == parts(*groups)


def test_minsize_and_scc(spark, merges):
    assert sets(hierarchy.cut(merges[0], vertices(spark, 7), 10, minsize=2)) == parts([1, 2, 3, 4, 5, 7])
    assert hierarchy.cut(merges[0], vertices(spark, 7), 100, minsize=2).isEmpty()
    assert sets(hierarchy.scc(graphs.tarjan_graph(spark), vertices(spark, 7), EdgeTest(20.0))) == parts([2, 3, 7], [1], [4], [5], [6])


def test_tree_of_unconnected_cycles(spark):
    g = graphs.edges(spark, [(1, 2, 10), (2, 1, 12), (3, 4, 11), (4, 3, 12)])
    rows = hierarchy.tree(hierarchy.merge_table(g), vertices(spark, 4)).orderBy("node").collect()
    assert [(r.threshold, r.parent, r.children, r.vertices, r.nvertices) for r in rows] == [(None, None, [2, 3], [], 4), (10, 1, [], [1, 2], 2), (11, 1, [], [3, 4], 2)]
    nodes = hierarchy.tree(hierarchy.merge_table(g), vertices(spark, 5))
    assert nodes.where("node = 1").first().vertices == [5] and hierarchy.same_tree(nodes, nodes) and not hierarchy.same_tree(nodes, nodes.where("node > 1"))
    assert {(r.node, r.vertex) for r in hierarchy.tree_vertices(nodes).collect()} == {(1, k) for k in range(1, 6)} | {(2, 1), (2, 2), (3, 3), (3, 4)}
    back = hierarchy.tree(hierarchy.merge_table(g, EdgeTest(rev=True)), vertices(spark, 4), True).orderBy("node").collect()
    assert [(r.threshold, r.vertices) for r in back] == [(None, []), (12, [1, 2]), (12, [3, 4])]
    none = graphs.edges(spark, [])
    assert hierarchy.tree(hierarchy.merge_table(none), vertices(spark, 0)).isEmpty()
    assert [r.vertices for r in hierarchy.tree(hierarchy.merge_table(none), vertices(spark, 1)).collect()] == [[1]]


def test_flows(spark):
    """With edges swapped, at 20."""
    g = settle(graphs.tarjan_graph(spark).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    v, a, b = vertices(spark, 7), *(spark.createDataFrame([(k,) for k in x], "vertex long") for x in ([1, 4, 5, 7], [2, 4, 6]))
    cut = settle(hierarchy.cuts(hierarchy.merge_table(g), v, spark.createDataFrame([(20.0,)], "threshold double")))
    cf = settle(flows.component_flows(cut, g, a, b))
    got = {(r.source, r.target, r.len, r.minweight) for r in flows.vertex_flows(cut, cf, a, b).collect()}
    assert got == {(1, 6, 1, 26), (4, 4, 0, 0), (5, 2, 1, 50), (5, 6, 2, 20), (7, 2, 0, 45), (7, 6, 1, 20)}
    assert {(r.source, r.target) for r in flows.flow_subgraph(cut, g, a, b).collect()} == {(1, 6), (2, 7), (3, 2), (3, 7), (5, 7), (7, 3), (7, 6)}
    ce = flows.component_edges(cut, g)
    start = cut.join(a, "vertex").select("threshold", F.col("component").alias("src_comp")).distinct()
    assert sorted(flows._reach_local(ce, start).collect()) == sorted(flows._reach_joins(settle(ce), start).collect())
    used = [sorted(r.vertex for r in x.collect()) for x in flows.used_ends(flows.vertex_flows(cut, cf, a, b))]
    assert used == [[1, 4, 5, 7], [2, 4, 6]]
    only = flows.vertex_flows(cut, cf, a, b, mincompsize=2)
    assert {(r.source, r.target) for r in only.collect()} == {(7, 2)}
    _, sub, found = flows.flowgraph(hierarchy.merge_table(g), g, v, a, b, EdgeTest(20.0), mincompsize=2)
    assert {(r.source, r.target) for r in sub.collect()} == {(2, 7), (3, 2), (3, 7), (7, 3)} and {(r.source, r.target) for r in found.collect()} == {(7, 2)}
    s = flows.flowstats(cut, cf, a, b, g).first()
    assert (s.nflows, s.ncompflows, s.flowlen_sum, s.compflowlen_max, s.ncompsources, s.ncompsinks) == (6, 6, 5, 2, 4, 3)
    assert s.flowinvlen_sum == pytest.approx(23 / 6) and s.floweight_sum == 46 and s.flowavghopweight_sum == 23 and s.flow_minedgeweight_sum == 161
    with pytest.raises(ValueError):
        flows.component_flows(cut, g, a, b, EdgeTest(rev=True))


def test_walk_stats(spark):
    v = vertices(spark, 7)
    step = graphs.tarjan_graph(spark).withColumn("w", F.col("w") / 50)
    weights = v.select("vertex", F.when(F.col("vertex").isin(2, 4, 7), 1.0).otherwise(0.0).alias("weight"))
    walk = settle(diffusion.similarity(diffusion.random_walk(step, v, 0.5), weights).where("w <> 0"))
    a, b = (spark.createDataFrame([(k,) for k in x], "vertex long") for x in ([2, 4, 7], [1, 2, 3]))
    t1, t2 = stats.treecut_stats(hierarchy.merge_table(walk), v, walk, a, b, walk).orderBy("threshold").collect()
    expected = {
        "ncomponents": (5, 6), "ncomponents_nontrivial": (1, 1), "maxcomponent_size": (3, 2), "topn_components_sizesum": (7, 6), "nflows": (9, 6), "ncompflows": (3, 4), "flow_avglen": (2 / 3, 5 / 6), "flow_avginvlen": (2 / 3, 23 / 54),
        "ncompsources": (1, 2), "topn_nsources": (3, 3), "ncompsinks": (3, 3), "topn_nsinks": (3, 3), "flow_avgweight": (0.14953506817016599, 0.13783585159418063), "flow_avgminedgeweight": (0.29045570649885494, 0.202407025164512),
        "flow_avghopweight": (0.11877205756069342, 0.10962421163253283), "compflow_avgweight": (0.14953506817016599, 0.11196100516905659), "compflow_avgminedgeweight": (0.29045570649885494, 0.16933645546777068), "flow_distance": (2 / 3, 26 / 9),
    }
    for name, (x, y) in expected.items():
        assert t1[name] == pytest.approx(x) and t2[name] == pytest.approx(y), name


@pytest.mark.parametrize("r", [0, 0.75, 1])
def test_walks_agree(spark, r):
    v = vertices(spark, 9)  # 8 and 9 have no edge
    step = settle(diffusion.stepmatrix(graphs.tarjan_graph(spark)))
    exact, rounds = ({(x.src, x.dst): x.w for x in diffusion.random_walk(step, v, r, 1e-3, dense).collect()} for dense in (100, 0))
    assert exact.keys() == rounds.keys() and all(math.isclose(exact[k], rounds[k], abs_tol=1e-2) for k in exact)
    assert len(exact) == {0: 0, 0.75: 51, 1: 9}[r]
    x = v.select("vertex", (F.col("vertex") * 1.5).alias("weight"))
    want = {k: sum(w * 1.5 * s for (s, t), w in exact.items() if t == k) for k in range(1, 10)}
    for dense in (100, 0):
        got = {y.vertex: y.weight for y in diffusion.diffuse(step, x, r, 1e-3, dense).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=0.2) for k in want)


def test_walk_limits(spark):
    v, step = vertices(spark, 7), settle(diffusion.stepmatrix(graphs.tarjan_graph(spark)))
    with pytest.raises(ValueError):
        diffusion.random_walk(step, v, 1.5)
    with pytest.raises(ValueError):  # weights of 6 to 50 are no steps
        diffusion.random_walk(graphs.tarjan_graph(spark), v, 0.1, dense=0)
    both = spark.createDataFrame([(p, k, float(k * p)) for p in (1, 2) for k in range(1, 8)], "perm int, vertex long, weight double")
    got = {(r.perm, r.vertex): r.weight for r in diffusion.diffuse(step, both, 0.5).collect()}
    assert len(got) == 14 and all(math.isclose(got[2, k], 2 * got[1, k]) for k in range(1, 8))


def test_bins_and_permutations(spark):
    g, v = graphs.example_graph(spark), vertices(spark, 25)
    for bins in (permute.vertexbins_sort(g, v, "out", 5), permute.vertexbins_sort(g, v, "outXin", 5), permute.vertexbins_tree(g, v, "outXin", 5)):
        rows = bins.collect()
        assert sorted(r.vertex for r in rows) == list(range(1, 26)) and len({r.bin for r in rows}) <= 5
    bins = permute.vertexbins_sort(g, v, "out", 5)
    of = {r.vertex: r.bin for r in bins.collect()}
    rows = permute.randpermgroups(bins, 3).collect()
    assert len(rows) == 75 and all(of[r.vertex] == of[r.from_vertex] for r in rows)
    assert all(sorted(r.from_vertex for r in rows if r.perm == p) == list(range(1, 26)) for p in (1, 2, 3))


def test_trace(spark):
    s, w = graphs.edges(spark, [(1, 2, 1), (2, 3, 1)]), graphs.edges(spark, [(1, 3, 1)])
    v, t = vertices(spark, 3), EdgeTest(0.5)
    paths = lambda steps, n=2: sorted(r.path for r in flows.trace_flows(steps, w, v, v, t, t, n).collect())
    assert paths(s) == [[2]] and paths(s.union(graphs.edges(spark, [(1, 3, 1)]))) == [[], [2]] and paths(s, 0) == []


def test_condense_index_hilbert(spark):
    e = graphs.edges(spark, [(2, 1, 2), (3, 1, 3), (1, 2, 1), (3, 2, 2), (1, 3, 2), (2, 3, 4)])
    g = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "vertex long, part long")
    assert {(r.dst_part, r.src_part): r.w for r in edges.condense(e, g).collect()} == {(1, 2): 3, (2, 1): 2, (2, 2): 4}
    assert {(r.src, r.dst): r.rank for r in edges.index_values(graphs.edges(spark, [(2, 1, 3), (1, 2, 2)])).collect()} == {(2, 1): 2, (1, 2): 1}
    grid = spark.range(256).select((F.floor(F.col("id") / 16) + 1).cast("int").alias("i"), (F.col("id") % 16 + 1).cast("int").alias("j"))
    assert sorted(r[0] for r in grid.select(scalar.hilbert_order(F.col("i"), F.col("j"), 16)).collect()) == list(range(1, 257))
    with pytest.raises(ValueError):
        edges.outedges_sparse(e, 1, EdgeTest(0.0))


def test_ecdf_and_bins(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "x double")
    at = {r.x: r.f for r in scalar.ecdf_at(scalar.ecdf(x, "x"), spark.createDataFrame([(0.0,), (1.0,), (3.0,), (9.0,)], "x double"), interpolate=True).collect()}
    assert at == {0.0: 0.0, 1.0: 0.25, 3.0: 0.875, 9.0: 1.0}
    bounds = lambda values, n, **more: stats.threshold_bins(spark.createDataFrame([(float(x),) for x in values], "threshold double"), n, **more)
    assert bounds([1, 2, 3, 4, 5, 6], 3) == [1, 2, 3, 4, 5, 6] and bounds([1, 2, 3, 4, 5, 6], 2) == [1, 3, 5, 6]
    assert bounds([1, 1, 1, 1, 2, 3], 2) == [1, 2, 3] and bounds([1, 2, 9, 10], 1, maxwidth=5) == [1, 9, 10] and bounds([0, 1, 2, 9], 1, threshold_range=(1, 2)) == [1, 2] and bounds([], 3) == []
    r = random.Random(3)
    values = sorted(float(r.randrange(60)) for _ in range(200))
    for n, width in ((7, None), (3, 4.0), (50, None), (1, 2.0)):
        want, last = [], 0
        for i, t in enumerate(values, 1):
            if not want or (want[-1] < t and ((i + 1 - last) * n >= len(values) or i == len(values))) or (width is not None and t - want[-1] >= width):
                want.append(t)
                last = i
        assert bounds(values, n, maxwidth=width) == want
    with pytest.raises(ValueError):
        scalar.ecdf(spark.createDataFrame([(float("nan"),)], "x double"), "x")


@pytest.mark.parametrize("mode", ["skip", "stepedges", "flowattr"])
def test_export(spark, mode):
    g, v = graphs.example_graph(spark), vertices(spark, 25)
    step = settle(diffusion.stepmatrix(g))
    walk = settle(diffusion.random_walk(step, v, 0.2).where("src <> dst"))
    a, b = (spark.createDataFrame([(k,) for k in x], "vertex long") for x in ([1, 2], [3, 4]))
    out = export.export_flowgraph(hierarchy.merge_table(walk), walk, v, a, b, 0.05, steps=step, flowpaths=mode)
    assert out["components"].agg(F.sum("nvertices")).first()[0] == 25
    assert out["vertices"].where("is_source").count() == 2 and not out["edges"].isEmpty()


def test_significance_metrics_reach_the_extremes(spark):
    names = [f"{n}_{t}" for n in ("ncomponents_signif", "components_signif_sizesum") for t in ("mw", "fisher")]
    rows = spark.createDataFrame([(p, float(t), *[(k + 2) * t * p for k in range(4)]) for p in (1, 2, 3) for t in range(1, 9)], ["perm", "threshold", *names])
    binned = stats.bin_treecut_stats(rows.where("perm > 1"), ["perm"], 4)
    agg = stats.aggregate_binstats(binned)
    assert set(names) <= set(binned.columns) and set(names) <= set(agg.columns)
    bounds = stats.threshold_bins(rows, 4)
    out = stats.extreme_treecut_stats(stats.add_bins(rows.where("perm = 1"), bounds).drop("perm"), settle(agg))
    assert {r.metric for r in out.select("metric").distinct().collect()} == set(names)


def test_export_carries_columns(spark):
    d = spark.createDataFrame(
        [(5, 2, 0.9, 0.4, None, None, 0.3, [[7]], 8.0, "up", "was", True), (2, 5, 0.4, 0.9, None, None, 0.6, [[]], 3.0, "down", "xx", True), (5, 2, 0.1, 0.1, "loop", 0, 9.0, [[1]], 8.0, "up", "was", True), (1, 3, 0.5, 0.2, None, None, 0.7, None, 4.0, "solo", "hint", True), (8, 9, 0.1, 0.1, "flow", 1, None, None, None, None, None, False)],
        "source long, target long, walkweight double, walkweight_rev double, flow string, flowlen int, walkpermweight_mean double, flowpaths array<array<long>>, weight double, diedge_type string, diedge_type_rev string, is_original boolean",
    )
    got = {(r.source, r.target): r for r in export.combine_diedges(d, original=["source", "target", "weight", "diedge_type", "diedge_type_rev"]).collect()}
    r, s = got[5, 2], got[1, 3]
    assert set(got) == {(5, 2), (1, 3)} and (r.has_flow, r.has_trace, r.walkweight, r.walkweight_rev, r.walkpermweight_mean, r.walkpermweight_mean_rev) == (True, False, 0.9, 0.4, 0.3, 0.6)
    assert (r.has_original, r.has_original_rev, r.weight, r.weight_rev, r.original_type, r.original_type_rev, r.flowpaths, r.flowpaths_rev) == (True, True, 8.0, 3.0, "up", "down", [[7]], [[]])
    assert (s.has_original, s.has_original_rev, s.weight, s.weight_rev, s.original_type, s.original_type_rev, s.flowpaths, s.walkweight_rev) == (True, False, 4.0, None, "solo", "hint", None, None)


def test_export_original_edges_and_loops(spark):
    g, v = graphs.example_graph(spark), vertices(spark, 25)
    step = settle(diffusion.stepmatrix(g))
    walk = settle(diffusion.random_walk(step, v, 0.2).where("src <> dst"))
    a, b = (spark.createDataFrame([(k,) for k in x], "vertex long") for x in ([1, 2], [1, 2, 3, 4]))
    orig = walk.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("weight"), F.lit("x").alias("diedge_type"), F.col("src").alias("mark"))
    more = walk.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(0.5).alias("walkpermweight_median"))
    out = export.export_flowgraph(hierarchy.merge_table(walk), walk, v, a, b, 0.02, orig=orig, steps=step, flowpaths="flowattr", diedge_stats=more)
    names = ("has_original", "original_type", "weight", "mark", "flowpaths", "walkpermweight_median", "walkweight")
    assert {n + end for n in names for end in ("", "_rev")} <= set(out["edges"].columns)
    assert {r.original_type for r in out["edges"].collect()} == {"x"} and out["diedges"].where("flow is null and mark <> source").isEmpty()
    loops = {r.vertex: (r.loops_through or [], r.nloops_through) for r in out["vertices"].where("is_source").collect()}
    comp = {r.vertex: r.component for r in out["vertices"].collect()}
    assert loops and all(x == ([t for t in (1, 2, 3, 4) if comp.get(t) == comp[s]], len(x[0])) for s, x in loops.items()) and any(n for _, n in loops.values())


def test_export_by_hand(spark):
    """A graph with a loop inside a component, an edge with its reverse, a tie of both directions and a traced vertex outside."""
    w = graphs.edges(spark, [(1, 2, 9), (2, 1, 5), (2, 3, 6), (3, 2, 2), (4, 5, 7), (5, 4, 7), (1, 9, 3), (9, 3, 4)])
    v, a, b = vertices(spark, 9), *(spark.createDataFrame([(k,) for k in x], "vertex long") for x in ([1, 4], [2, 3, 5]))
    steps = graphs.edges(spark, [(2, 8, 9), (8, 3, 9), (2, 3, 1)])
    merge = hierarchy.merge_table(w)
    out = export.export_flowgraph(merge, w, v, a, b, 5.0, steps=steps, flowpaths="stepedges")
    assert {(r.component, r.component0, r.nvertices, r.is_used) for r in out["components"].collect()} == {(1, 1, 2, True), (3, 3, 1, True), (4, 4, 2, True), *((k, k, 1, False) for k in (6, 7, 8, 9))}
    d = {(r.source, r.target, r.flow): (r.walkweight, r.walkweight_rev, r.flowlen, r.floweight) for r in out["diedges"].collect()}
    assert d == {
        (1, 2, None): (9, 5, None, None), (2, 1, None): (5, 9, None, None), (2, 3, None): (6, 2, None, None), (4, 5, None): (7, 7, None, None), (5, 4, None): (7, 7, None, None), (2, 8, "trace"): (None,) * 4, (8, 3, "trace"): (None,) * 4,
        (1, 2, "loop"): (5, 5, 0, 9), (1, 3, "flow"): (5, 5, 1, 6), (4, 5, "loop"): (5, 5, 0, 7),
    }
    e = {(r.source, r.target): (r.has_flow, r.has_trace, r.has_walk, r.walkweight, r.walkweight_rev) for r in out["edges"].collect()}
    assert e == {(1, 2): (True, False, True, 9, 5), (2, 3): (False, False, True, 6, None), (4, 5): (True, False, True, 7, None), (5, 4): (False, False, True, 7, None), (2, 8): (False, True, True, None, None), (8, 3): (False, True, True, None, None)}
    x = {r.vertex: r for r in out["vertices"].collect()}
    assert sorted(x) == [1, 2, 3, 4, 5, 8] and [k for k in x if x[k].is_steptrace] == [8] and x[8].component == 0 and x[3].component == 3
    assert [(p.vertex, p.flowlen) for p in x[1].flows_to] == [(2, 0), (3, 1)] and x[1].nflows_to == 2 and x[1].loops_through == [2] and x[1].nloops_through == 1 and x[2].flows_to is None and x[3].nflows_from == 1
    with_flows = export.export_flowgraph(merge, w, v, a, b, 5.0, flow_edges=True, exported_sinks=spark.createDataFrame([(3,)], "vertex long"))
    assert {(r.source, r.target) for r in with_flows["edges"].where("not has_walk").collect()} == {(1, 3)} and {r.vertex for r in with_flows["vertices"].where("is_sink").collect()} == {3}
    assert with_flows["diedges"].where("flow = 'loop'").isEmpty()
    few = export.export_flowgraph(merge, w, v, a, b, 5.0, steps=steps, flowpaths="stepedges", step_sources=a, step_sinks=b)
    assert few["diedges"].where("flow = 'trace'").isEmpty()  # no source has a traced way
    with pytest.raises(ValueError):
        export.export_flowgraph(merge, w, v, a, b, 5.0, flowpaths="stepedges")


def test_exact_tail():
    r = random.Random(5)
    for _ in range(30):
        x = [r.randrange(6) for _ in range(8)]
        twice = [2 * sum(y < v for y in x) + sum(y == v for y in x) + 1 for v in x]
        got = sum(twice[:3])
        want = sum(sum(c) >= got for c in itertools.combinations(twice, 3)) / math.comb(8, 3)
        kinds = sorted(set(twice))
        assert scalar.exact_tail(kinds, [twice.count(k) for k in kinds], 3, got) == pytest.approx(want)


def test_extremes_without_permutations(spark):
    """Thresholds of bins that the permutations lack stay, with a null quantile."""
    rows = spark.createDataFrame([(1.0, 1, 5.0), (2.0, 2, 7.0)], "threshold double, threshold_bin int, nflows double")
    agg = spark.createDataFrame([(1, 1.5, 0.5, 4.0)], "threshold_bin int, threshold_binmid double, quantile double, nflows double")
    out = {(r.quantile, r.stat, r.value_type): r for r in stats.extreme_treecut_stats(rows, agg).collect()}
    assert {q for q, *_ in out} == {None, 0.5} and out[None, "min", "opt"].threshold == 2.0 and out[None, "min", "opt"].permuted_value is None


def test_component_stats_of_permutations(spark):
    cut = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "component long, vertex long")
    v = spark.createDataFrame([(1, 1.0, 2.0, True), (2, 3.0, 4.0, False), (3, 5.0, 6.0, True)], "vertex long, weight double, walkweight double, is_hit boolean")
    p = spark.createDataFrame([(k, i, float(i * k), float(i + k)) for k in (1, 2, 3) for i in (1, 2, 3)], "perm int, vertex long, weight double, walkweight double")
    r = {x.component: x for x in stats.component_stats(cut, v, p, weight_tests=True, mannwhitney_tests=True).collect()}
    assert (r[1].weight_mean, r[1].weight_median, r[1].permweight_mean, r[1].permweight_median, r[1].walkpermweight_mean, r[1].nhits) == (2, 2, 3, 2.5, 3.5, 1)
    assert r[1].pvalue_walkweight_fisher == pytest.approx(1.0) and r[3].pvalue_walkweight_fisher == pytest.approx(2 / 3) and r[3].pvalue_weight_mw == pytest.approx(0.75)


def test_refused_arguments(spark):
    e, v = graphs.tarjan_graph(spark), vertices(spark, 5)
    with pytest.raises(ValueError):
        edges.check_vertices(e, v)
    with pytest.raises(ValueError):
        edges.condense(e, v.withColumn("part", F.lit(1)), check=True)
    with pytest.raises(ValueError):
        scalar.reset_parts(F.lit(3), 2)
    with pytest.raises(ValueError):
        permute.vertexbins(e, v, method="other")
    with pytest.raises(ValueError):
        flows.trace_flows(e, e, v, v, EdgeTest(), EdgeTest(), -1)
    assert edges.empty_edges(spark).isEmpty() and EdgeTest(skipval=None, rev=True).default == math.inf and EdgeTest().default == 0
    assert {(r.src, r.dest) for r in spark.range(1, 10).select(*(c.alias(n) for c, n in zip(edges.diedge_ends(F.col("id"), 3), ("src", "dest"), strict=True))).collect()} == set(itertools.product((1, 2, 3), repeat=2))


def test_shared_folder(spark, monkeypatch):
    from lumigraph import tables

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        tables.shared_dir(Far)
