"""Flows from sources to sinks through the graph of components, for all thresholds at once: the threshold is a column.

Edges are not reversible here: a reversed test raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle
from .edges import EdgeTest
from .hierarchy import cuts as cuts_at

#: Component edges of a threshold that one task searches.
LOCAL = 1 << 20


def component_edges(cuts: DataFrame, e: DataFrame) -> DataFrame:
    """threshold, a, b, w: the strongest edge between components that is valid, and the strongest inside each."""
    s = cuts.select("threshold", F.col("component").alias("a"), F.col("vertex").alias("src"))
    d = cuts.select("threshold", F.col("component").alias("b"), F.col("vertex").alias("dst"))
    return e.join(s, "src").join(d, ["threshold", "dst"]).where(((F.col("w") >= F.col("threshold")) | (F.col("a") == F.col("b"))) & (F.col("w") != 0)).groupBy("threshold", "a", "b").agg(F.max("w").alias("w"))


def _within(cuts: DataFrame, vertices: DataFrame, name: str) -> DataFrame:
    return cuts.join(vertices.select("vertex"), "vertex", "left_semi").groupBy("threshold", F.col("component").alias(name)).agg(F.count("*").alias(f"n_{name}"))


def reach(cuts: DataFrame, e: DataFrame, sources: DataFrame, local: int = LOCAL) -> DataFrame:
    """threshold, src_comp, node, len, minweight: breadth first from every component with a source; of the shortest paths the best bottleneck.

    Thresholds whose component graph has at most ``local`` edges are searched each in one task, larger ones level by level with joins.
    """
    ce = settle(component_edges(cuts, e))
    start = settle(_within(cuts, sources, "src_comp").select("threshold", "src_comp"))
    most = ce.groupBy("threshold").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return settle(_reach_local(ce, start) if most <= local else _reach_joins(ce, start))


def _reach_local(ce: DataFrame, start: DataFrame) -> DataFrame:
    rows = ce.select("threshold", "a", "b", "w").union(start.select("threshold", "src_comp", F.lit(None).cast("long"), F.lit(0.0)))

    def search(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        edges = pdf[pdf.b.notna()]
        own, to = {}, {}
        for a, b, w in zip(edges.a.tolist(), edges.b.astype("int64").tolist(), edges.w.tolist(), strict=True):
            if a == b:
                own[a] = w
            else:
                to.setdefault(a, []).append((b, w))
        for s in pdf[pdf.b.isna()].a.tolist():
            seen = {s: (0, own.get(s, 0.0))}
            front = [s]
            while front:
                new: dict = {}
                for a in front:
                    n, least = seen[a]
                    for b, w in to.get(a, ()):
                        if b not in seen:
                            got = min(least, w) if n else w
                            if b not in new or new[b][1] < got:
                                new[b] = (n + 1, got)
                seen.update(new)
                front = list(new)
            yield pd.DataFrame({"threshold": pdf.threshold.iloc[0], "src_comp": s, "node": list(seen), "len": [x[0] for x in seen.values()], "minweight": [float(x[1]) for x in seen.values()]})

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from search(pd.concat(pdfs, ignore_index=True))

    return rows.groupBy("threshold").applyInPandas(run, "threshold double, src_comp long, node long, len int, minweight double")


def _reach_joins(ce: DataFrame, start: DataFrame) -> DataFrame:
    inner = ce.where("a = b").select("threshold", F.col("a").alias("src_comp"), F.col("w").alias("own"))
    start = start.join(inner, ["threshold", "src_comp"], "left")
    front = settle(start.select("threshold", "src_comp", F.col("src_comp").alias("node"), F.lit(0).alias("len"), F.coalesce("own", F.lit(0.0)).alias("minweight")))
    seen, steps = front, ce.where("a <> b")
    while not front.isEmpty():
        best = F.max(F.when(F.col("len") > 0, F.least("minweight", "w")).otherwise(F.col("w"))).alias("minweight")
        moved = front.join(steps.withColumnRenamed("threshold", "t"), (F.col("threshold") == F.col("t")) & (F.col("node") == F.col("a")))
        new = moved.groupBy("threshold", "src_comp", F.col("b").alias("node")).agg((F.first("len") + 1).alias("len"), best)
        front = settle(new.join(seen, ["threshold", "src_comp", "node"], "left_anti").select(seen.columns))
        seen = settle(seen.union(front))
    return seen


def component_flows(cuts: DataFrame, e: DataFrame, sources: DataFrame, sinks: DataFrame, test: EdgeTest = EdgeTest(), reached: DataFrame | None = None) -> DataFrame:
    """threshold, src_comp, dst_comp, len, minweight, n_src, n_dst (sources and sinks inside). reached: the result of ``reach``, if it is known."""
    if test.rev:
        raise ValueError("flows of reversed weights are not defined")
    to = _within(cuts, sinks, "dst_comp")
    reached = reach(cuts, e, sources) if reached is None else reached
    found = reached.withColumnRenamed("node", "dst_comp").join(to, ["threshold", "dst_comp"]).join(_within(cuts, sources, "src_comp"), ["threshold", "src_comp"])
    return found.select("threshold", "src_comp", "dst_comp", "len", "minweight", F.col("n_src_comp").alias("n_src"), F.col("n_dst_comp").alias("n_dst"))


def vertex_flows(cuts: DataFrame, flows: DataFrame, sources: DataFrame, sinks: DataFrame, mincompsize: int = 1) -> DataFrame:
    """threshold, source, target, src_comp, dst_comp, len, minweight: every source and sink of the components of a flow."""
    flows = flows.select("threshold", "src_comp", "dst_comp", "len", "minweight")
    size = cuts.groupBy("threshold", "component").agg(F.count("*").alias("n"))
    ends = lambda name, comp, v: cuts.join(v.select("vertex"), "vertex", "left_semi").join(size.where(F.col("n") >= mincompsize), ["threshold", "component"]).select("threshold", F.col("component").alias(comp), F.col("vertex").alias(name))
    return flows.join(ends("source", "src_comp", sources), ["threshold", "src_comp"]).join(ends("target", "dst_comp", sinks), ["threshold", "dst_comp"]).select("threshold", "source", "target", "src_comp", "dst_comp", "len", "minweight")


def flow_subgraph(cuts: DataFrame, e: DataFrame, sources: DataFrame, sinks: DataFrame, mincompsize: int = 1, reached: DataFrame | None = None) -> DataFrame:
    """threshold, source, target, src_comp, dst_comp, walkweight: valid edges between components on the way from a source to a sink, and inside every used one.

    Components on such a way are used if an edge to or from another of them counts, or if they hold a source and a sink; edges of components smaller than mincompsize don't count.
    """
    forth = (reach(cuts, e, sources) if reached is None else reached).select("threshold", F.col("node").alias("component")).distinct()
    back = reach(cuts, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), sinks).select("threshold", F.col("node").alias("component")).distinct()
    size = cuts.groupBy("threshold", "component").agg(F.count("*").alias("n")).where(F.col("n") >= mincompsize).drop("n")
    on_way = settle(forth.join(back, ["threshold", "component"]).join(size, ["threshold", "component"]))
    a = cuts.join(on_way, ["threshold", "component"]).select("threshold", F.col("component").alias("src_comp"), F.col("vertex").alias("source"))
    b = a.select("threshold", F.col("src_comp").alias("dst_comp"), F.col("source").alias("target"))
    valid = e.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("walkweight"))
    inside = settle(valid.join(a, "source").join(b, ["threshold", "target"]).where("walkweight >= threshold and walkweight <> 0").select("threshold", "source", "target", "src_comp", "dst_comp", "walkweight"))
    if mincompsize == 1:
        return inside  # a component on the way has an edge of the way, or holds both ends
    between = inside.where("src_comp <> dst_comp")
    both = _within(cuts, sources, "component").join(_within(cuts, sinks, "component").select("threshold", "component"), ["threshold", "component"]).select("threshold", "component")
    used = between.select("threshold", F.col("src_comp").alias("component")).union(between.select("threshold", "dst_comp")).union(both).distinct()
    return inside.join(used.withColumnRenamed("component", "src_comp"), ["threshold", "src_comp"], "left_semi").select(inside.columns)


def flowgraph(merge: DataFrame, e: DataFrame, vertices: DataFrame, sources: DataFrame, sinks: DataFrame, test: EdgeTest, mincompsize: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cut at the test's threshold (component, vertex), the subgraph and the vertex flows there."""
    if test.rev:
        raise ValueError("flows of reversed weights are not defined")
    at = merge.sparkSession.createDataFrame([(float(test.threshold),)], "threshold double")
    cut = settle(cuts_at(merge, vertices, at))
    reached = reach(cut, e, sources)
    flows = vertex_flows(cut, component_flows(cut, e, sources, sinks, test, reached), sources, sinks, mincompsize)
    return cut, flow_subgraph(cut, e, sources, sinks, mincompsize, reached), flows


def flowstats(cuts: DataFrame, flows: DataFrame, sources: DataFrame, sinks: DataFrame, weights: DataFrame | None = None, maxweight: float | None = None, zero_as_threshold: bool = False) -> DataFrame:
    """Sums over flows for each threshold. weights: (src, dst, w) between sources and sinks. zero_as_threshold: flows inside a component without a valid edge have the threshold as minweight."""
    if zero_as_threshold:
        flows = flows.withColumn("minweight", F.when(F.col("len") == 0, F.greatest("minweight", "threshold")).otherwise(F.col("minweight")))
    both = F.col("n_src") * F.col("n_dst")
    hops = F.col("len") + 1
    weight = F.lit(float("nan"))
    if weights is not None:
        w = weights.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.least("w", F.lit(maxweight)).alias("w") if maxweight is not None else F.col("w"))
        sums = vertex_flows(cuts, flows, sources, sinks).join(w, ["source", "target"], "left").groupBy("threshold", "src_comp", "dst_comp").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("weight"))
        flows = flows.join(sums, ["threshold", "src_comp", "dst_comp"])
        weight = F.col("weight")
    total = lambda x, name: F.sum(x).alias(name)
    out = flows.groupBy("threshold").agg(
        total(both, "nflows"), F.count("*").alias("ncompflows"), total(F.col("len") * both, "flowlen_sum"), total(both / hops, "flowinvlen_sum"), total("len", "compflowlen_sum"), total(1 / hops, "compflowinvlen_sum"), F.max("len").alias("compflowlen_max"),
        F.sum(weight).alias("floweight_sum"), F.sum(weight / both).alias("compfloweight_sum"), F.sum(weight / hops).alias("flowavghopweight_sum"), F.sum(weight / both / hops).alias("compflowavghopweight_sum"),
        F.sum(F.col("minweight") * both).alias("flow_minedgeweight_sum"), F.sum("minweight").alias("compflow_minedgeweight_sum"),
    )
    ends = lambda v, name: _within(cuts, v, "c").groupBy("threshold").agg(F.count("*").alias(name))
    out = ends(sources, "ncompsources").join(ends(sinks, "ncompsinks"), "threshold", "full").join(out, "threshold", "left")
    missing = {c: F.lit(float("nan") if weights is None and "weight_sum" in c and "minedge" not in c else 0) for c in out.columns if c != "threshold"}
    return out.select("threshold", *[F.coalesce(c, x).alias(c) for c, x in missing.items()])  # thresholds without a flow have sums of 0


def used_ends(vertex_flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """threshold, vertex of the sources and of the sinks that have a flow."""
    return tuple(vertex_flows.select("threshold", F.col(c).alias("vertex")).distinct() for c in ("source", "target"))


def trace_flows(steps: DataFrame, walk: DataFrame, sources: DataFrame, sinks: DataFrame, step_test: EdgeTest, walk_test: EdgeTest, maxsteps: int = 2, compat: bool = False) -> DataFrame:
    """source, target, path: intermediates of all simple step paths of at most maxsteps edges whose ends are a valid walk edge.

    compat (at most 2 steps) leaves out v->b->a where v->a is a step as well and a < b, as a search that never un-visits does.
    """
    if maxsteps < 0:
        raise ValueError("maxsteps must not be negative")
    if compat and maxsteps > 2:
        raise ValueError("compat holds for two steps at most")
    s = steps.where(step_test.valid(F.col("w")) & (F.col("src") != F.col("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    spark = steps.sparkSession
    out = spark.createDataFrame([], "source long, target long, path array<long>")
    paths = sources.select(F.col("vertex").alias("source"), F.col("vertex").alias("at"), F.array().cast("array<long>").alias("path"))
    for k in range(maxsteps):
        path = F.col("path") if k == 0 else F.array_append("path", F.col("at"))
        moved = paths.join(s, F.col("at") == F.col("a")).where((F.col("b") != F.col("source")) & ~F.array_contains("path", F.col("b")))
        paths = moved.select("source", F.col("b").alias("at"), path.alias("path"))
        if compat and k == 1:
            direct = s.select(F.col("a").alias("source"), F.col("b").alias("at"))
            paths = paths.join(direct.withColumn("direct", F.lit(True)), ["source", "at"], "left").where(F.col("direct").isNull() | (F.col("at") > F.col("path")[0])).drop("direct")
        out = out.union(paths.select("source", F.col("at").alias("target"), "path"))
    ends = walk.where(walk_test.valid(F.col("w"))).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return out.join(ends, ["source", "target"], "left_semi").join(sinks.select(F.col("vertex").alias("target")), "target", "left_semi").select("source", "target", "path")
