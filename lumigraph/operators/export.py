"""Export of a cut network: components, vertices, directed edges and edges, as four DataFrames over one cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import settle
from .edges import EdgeTest
from .flows import flowgraph, trace_flows


def missing_stats(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without statistics."""
    return rows.join(stats, keys, "left_anti")


def export_flowgraph(
    merge: DataFrame, walk: DataFrame, vertices: DataFrame, sources: DataFrame, sinks: DataFrame, threshold: float, orig: DataFrame | None = None, steps: DataFrame | None = None, step_threshold: float | None = None, maxsteps: int = 2,
    flowpaths: str = "skip", vertex_stats: DataFrame | None = None, diedge_stats: DataFrame | None = None, mincompsize: int = 1, flow_edges: bool = False, exported_sinks: DataFrame | None = None, step_sources: DataFrame | None = None, step_sinks: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """components, vertices, diedges, edges at one threshold. flowpaths: skip, stepedges (traced steps as edges) or flowattr (paths as a column of walk edges).

    components: component (its smallest vertex), component0 (the same id: one id space), nvertices, is_used. vertices: those of used components and of traced steps (is_steptrace, component 0) that an edge
    touches; flow lists are null where there is no flow. diedges: walk edges (flow is null), traced steps (flow ``trace``) and flows (``flow``, or ``loop`` inside a component) to ``exported_sinks`` (all sinks).
    orig: source, target, weight and any other columns (diedge_type and its _rev name the type of an original edge); all of them are in diedges and, for both directions, in edges.
    Steps are traced between ``step_sources`` and ``step_sinks``, any vertex if they are not given, where the walk has an edge inside the used components. stats tables have the keys vertex, or source and target.
    """
    if flowpaths not in ("skip", "stepedges", "flowattr"):
        raise ValueError("flowpaths must be skip, stepedges or flowattr")
    if flowpaths != "skip" and steps is None:
        raise ValueError("tracing needs steps")
    exported = (sinks if exported_sinks is None else exported_sinks).select("vertex").distinct()
    cut, sub, flows = flowgraph(merge, walk, vertices, sources, sinks, EdgeTest(threshold=float(threshold)), mincompsize)
    sub, member = settle(sub), cut.select("vertex", "component")
    used_comps = settle(sub.select(F.col("src_comp").alias("component")).union(sub.select("dst_comp")).distinct())
    used = settle(member.join(used_comps, "component"))
    mark = lambda v, key, name: v.select(key).distinct().withColumn(name, F.lit(True))
    sizes = member.groupBy("component").agg(F.count("*").alias("nvertices"))
    components = sizes.join(mark(used_comps, "component", "is_used"), "component", "left").select("component", F.col("component").alias("component0"), "nvertices", F.coalesce("is_used", F.lit(False)).alias("is_used"))

    back = walk.select(F.col("dst").alias("source"), F.col("src").alias("target"), F.col("w").alias("back"))
    diedges = sub.join(back, ["source", "target"], "left").select("source", "target", "walkweight", F.coalesce("back", F.lit(0.0)).alias("walkweight_rev"))
    hops = None
    if flowpaths != "skip":
        inside = lambda c: used.select(F.col("vertex").alias(c))
        kept = walk.join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi")
        ends = [vertices if v is None else v for v in (step_sources, step_sinks)]
        paths = settle(trace_flows(steps, kept, *ends, EdgeTest(threshold=0.75 * threshold if step_threshold is None else step_threshold), EdgeTest(threshold=float(threshold)), maxsteps))
        if flowpaths == "flowattr":
            diedges = diedges.join(paths.groupBy("source", "target").agg(F.array_sort(F.collect_set("path")).alias("flowpaths")), ["source", "target"], "left")
        else:
            nodes = F.concat(F.array("source"), F.col("path"), F.array("target"))
            hop = F.transform(F.sequence(F.lit(1), F.size("path") + 1), lambda k: F.struct(F.element_at(nodes, k).alias("source"), F.element_at(nodes, k + 1).alias("target")))
            hops = settle(paths.select(F.explode(hop).alias("h")).select("h.*").distinct())
    if diedge_stats is not None:
        diedges = diedges.join(diedge_stats, ["source", "target"], "left")
    if hops is not None:
        diedges = diedges.unionByName(hops.join(sub, ["source", "target"], "left_anti").withColumn("flow", F.lit("trace")), allowMissingColumns=True)
    kind = F.when(F.col("src_comp") == F.col("dst_comp"), "loop").otherwise("flow")
    at = F.lit(float(threshold))
    shown = settle(flows.join(exported.withColumnRenamed("vertex", "target"), "target", "left_semi").join(used.select(F.col("vertex").alias("target")), "target", "left_semi").select("source", "target", at.alias("walkweight"), at.alias("walkweight_rev"), kind.alias("flow"), F.col("len").alias("flowlen"), F.col("minweight").alias("floweight")))
    diedges = diedges.unionByName(shown, allowMissingColumns=True)
    if orig is not None:
        diedges = diedges.join(orig, ["source", "target"], "left").withColumn("is_original", F.col("weight").isNotNull())
    diedges = settle(diedges)

    to = shown.groupBy(F.col("source").alias("vertex")).agg(_listed("target").alias("flows_to"), _count("target").alias("nflows_to"), _loops().alias("loops_through"), F.countDistinct(F.when(F.col("flow") == "loop", F.col("target"))).alias("nloops_through"))
    since = shown.groupBy(F.col("target").alias("vertex")).agg(_listed("source").alias("flows_from"), _count("source").alias("nflows_from"))
    touched = diedges.select(F.col("source").alias("vertex")).union(diedges.select("target")).distinct()
    out = touched.join(used, "vertex", "left").withColumn("is_steptrace", F.col("component").isNull())
    out = out.join(mark(sources, "vertex", "is_source"), "vertex", "left").join(mark(exported, "vertex", "is_sink"), "vertex", "left").fillna(False, ["is_source", "is_sink"]).fillna(0, ["component"])
    if vertex_stats is not None:
        out = out.join(vertex_stats, "vertex", "left")
    out = out.join(to, "vertex", "left").join(since, "vertex", "left")
    return {"components": components, "vertices": out, "diedges": diedges, "edges": combine_diedges(diedges, flow_edges, None if orig is None else orig.columns)}


def _count(other: str) -> Column:
    return F.size(F.collect_set(F.struct(other, "flowlen"))).cast("long")


def _loops() -> Column:
    found = F.array_sort(F.collect_set(F.when(F.col("flow") == "loop", F.col("target"))))
    return F.when(F.size(found) > 0, found)


def _listed(other: str):
    """Distinct (vertex, flowlen) by length, then vertex."""
    pairs = F.array_sort(F.collect_set(F.struct("flowlen", F.col(other).alias("vertex"))))
    return F.transform(pairs, lambda p: F.struct(p["vertex"].alias("vertex"), p["flowlen"].alias("flowlen")))


#: Columns of walk edges whose maximum an edge has for each direction.
MAXIMA = ["walkweight", "prob_perm_walkweight_greater", "walkpermweight_median", "walkpermweight_mad", "walkpermweight_mean", "walkpermweight_std"]


def combine_diedges(diedges: DataFrame, flow_edges: bool = False, original: Sequence[str] | None = None) -> DataFrame:
    """One row for each pair of vertices, the heavier direction forward (edges of equal weights keep theirs); pairs of flows only are left out unless asked for.

    Columns of the backward directed edges end in _rev: maxima of the weights and permutation statistics, flowpaths and, with is_original, has_original and the ``original`` columns.
    """
    given, original = diedges.columns, list(original or [])
    back = F.coalesce("walkweight", F.lit(0.0)) < F.coalesce("walkweight_rev", F.lit(0.0))
    rows = diedges.select(F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"), back.alias("is_reverse"), *[c for c in given if c not in ("source", "target")])
    is_flow = F.col("flowlen").isNotNull()
    sides = (("", ~F.col("is_reverse")), ("_rev", F.col("is_reverse")))
    parts = [F.bool_or(is_flow).alias("has_flow"), F.bool_and(F.coalesce("flow", F.lit("")) == "trace").alias("has_trace"), F.bool_or(~is_flow).alias("has_walk")]
    parts += [F.max(F.when(side & ~is_flow, F.col(c))).alias(c + end) for c in MAXIMA if c in given for end, side in sides]
    if "flowpaths" in given:
        parts += [F.min(F.when(side & ~is_flow, F.col("flowpaths"))).alias(f"flowpaths{end}") for end, side in sides]
    kept = [c for c in original if c not in ("source", "target")]
    if "is_original" in given:
        for end, side in sides:
            mine = side & F.col("is_original")
            parts += [F.bool_or(mine).alias(f"has_original{end}")]
            if kept:
                parts += [F.min_by(F.struct(*kept), F.when(mine, F.col("weight"))).alias(f"first{end}")]
    out = rows.groupBy("source", "target").agg(*parts)
    if "is_original" in given and kept:
        out = out.select(*[c for c in out.columns if c not in ("first", "first_rev")], *_original_columns(kept))
    return out if flow_edges else out.where("has_walk")


def _original_columns(kept: list[str]) -> list[Column]:
    """Types and other columns of the original edges of both directions; a direction without one of its own takes what the other says of it in columns that end in _rev."""
    out: dict[str, Column] = {}
    if "diedge_type" in kept:
        out["original_type"] = F.col("first")["diedge_type"]
        other = F.col("first")["diedge_type_rev"] if "diedge_type_rev" in kept else F.lit(None)
        out["original_type_rev"] = F.when(F.col("has_original_rev"), F.col("first_rev")["diedge_type"]).otherwise(other)
    for c in kept:
        if c != "diedge_type" and not c.endswith("_rev"):
            out[c], out[f"{c}_rev"] = F.col("first")[c], F.col("first_rev")[c]
    for c in kept:
        if c.endswith("_rev"):  # said by the forward edge, if there is one
            out[c] = F.when(F.col("has_original"), F.col("first")[c]).otherwise(out.get(c, F.lit(None)))
    return [x.alias(name) for name, x in out.items()]
