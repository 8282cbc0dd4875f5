"""The hierarchy of strongly connected components over all thresholds, as a forest of merges.

Every edge lies inside one component from some strongest threshold on. Those thresholds are found for all edges at once by bisection: the components of the edges of at least
the middle threshold decide for each edge whether it belongs to the stronger half (inside) or, with components contracted, to the weaker one. An edge is in one half only, so a
level of the bisection costs what the edges cost. What is kept is a forest: (u, v, m) says that the components of u and v are one from m on; it has fewer rows than there are vertices,
and the components at t are those connected by merges of at least t. No table of pairs is ever made.

Parts of the bisection of at most ``LOCAL`` edges are finished each in one task; before, components come from ``connect``, by rounds of joins where a part is too large for a task.

Where every edge counts in both directions, strong components are components, and a strongest spanning forest is the forest of merges: no bisection is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import settle
from . import connect
from .edges import EdgeTest

#: Edges of a part of the bisection that one task finishes.
LOCAL = 1 << 20
MERGE = "u long, v long, m double"


def bisect(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest of merges (u, v, m) of edges a -> b of weight w, the largest the strongest."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    levels, rank = np.unique(w, return_inverse=True)
    out_u, out_v, out_m = [], [], []
    # A part: its edges and the weakest and strongest rank at which their ends may become one (-1: never).
    parts = [(code[: len(a)], code[len(a) :], rank, -1, len(levels) - 1)]
    while parts:
        s, d, k, low, high = parts.pop()
        apart = s != d
        s, d, k = s[apart], d[apart], k[apart]
        if not len(s) or high < 0:
            continue
        middle = (low + high + 1) // 2
        strong = k >= middle
        own, back = np.unique(np.concatenate([s, d]), return_inverse=True)
        x, y = back[: len(s)], back[len(s) :]
        label = connect.strong_labels(len(own), x[strong], y[strong])
        inside = label[x] == label[y]
        if low == high or middle == high:  # nothing is stronger: components become one here
            e = inside & strong
            if e.any():
                u, v = forest(len(own), x[e], y[e])
                out_u.append(own[u])
                out_v.append(own[v])
                out_m.append(np.full(len(u), levels[middle]))
        else:
            e = inside & strong
            parts.append((s[e], d[e], k[e], middle, high))
        if low < middle:
            e = ~inside
            parts.append((own[label[x[e]]], own[label[y[e]]], k[e], low, middle - 1))
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return ids[cat(out_u, np.int64)], ids[cat(out_v, np.int64)], cat(out_m, np.float64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the smallest of its component, with that smallest one."""
    root = connect.label_min(n, a, b)
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def spanning(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a strongest spanning forest of a - b: every component takes its strongest edge until none is left. Equal weights are ordered by place, so that no cycle closes."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = np.argsort(w, kind="stable")[::-1]
    x, y = code[: len(a)][at], code[len(a) :][at]
    taken = []
    while True:
        apart = x != y
        x, y, at = x[apart], y[apart], at[apart]
        if not len(x):
            return np.concatenate(taken) if taken else at
        first = np.full(len(ids), len(x))
        np.minimum.at(first, x, np.arange(len(x)))
        np.minimum.at(first, y, np.arange(len(x)))
        best = np.unique(first[first < len(x)])
        taken.append(at[best])
        root = connect.label_min(len(ids), x[best], y[best])
        x, y = root[x], root[y]


def _spanning_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    if rows:
        table = pa.Table.from_batches(rows)
        yield from table.take(spanning(*(table[c].to_numpy() for c in ("a", "b", "w")))).to_batches()


def _spanning_forest(e: DataFrame, local: int) -> DataFrame:
    """u, v, m: a strongest spanning forest of edges (a, b, w) that count in both directions.

    Every task thins its share of the edges to a strongest spanning forest: an edge left out is a weakest one of a cycle, which the whole forest can do without. Shares are even ranges of the side with
    more ids, so that one of these is in few shares. Where that leaves more than half of the edges, components take their strongest edge by joins and are contracted, which halves the ids.
    """
    thin = lambda rows: rows.mapInArrow(_spanning_batches, "a long, b long, w double")
    e, done = e.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double")), None
    n = e.count()
    while n > local:
        ids = e.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
        e = settle(thin(e.repartitionByRange(-(-n // local), *(["a", "b"] if ids.a > ids.b else ["b", "a"]))))
        before, n = n, e.count()
        if n > local and 2 * n > before:
            found, e = _contract(e, local)
            done, n = found if done is None else done.union(found), e.count()
    last = thin(e.repartition(1)).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("w").alias("m"))
    return last if done is None else done.union(last)


def _contract(e: DataFrame, local: int) -> tuple[DataFrame, DataFrame]:
    """u, v, m of the strongest edge of every id, and the edges between what they join. That goes by the id from which its strongest edge was taken twice: the way to it is nowhere weaker than an id's strongest edge, so
    later merges may name it."""
    by = F.struct("w", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    ends = e.select(F.col("a").alias("id"), F.struct(by.alias("by"), F.col("b").alias("to")).alias("top")).union(e.select("b", F.struct(by.alias("by"), F.col("a").alias("to"))))
    taken = settle(ends.groupBy("id").agg(F.max("top").alias("top")).select("id", "top.to", F.col("top.by.w").alias("w")))
    twice = taken.select(F.col("to").alias("id"), F.col("id").alias("to")).where("id < to")
    roots = settle(taken.join(twice, ["id", "to"]).select(F.col("id").alias("root")))
    whole = settle(connect.components(taken.select(F.lit(0).alias("key"), F.col("id").alias("a"), F.col("to").alias("b")), local).select("id", "component"))
    label = settle(whole.join(whole.join(roots, F.col("id") == F.col("root")).select("component", "root"), "component").select("id", "root"))
    a, b = (label.select(F.col("id").alias(c), F.col("root").alias(f"{c}_of")) for c in ("a", "b"))
    rest = e.join(a, "a").join(b, "b").where("a_of <> b_of").groupBy(F.least("a_of", "b_of").alias("a"), F.greatest("a_of", "b_of").alias("b")).agg(F.max("w").alias("w"))
    merges = taken.join(roots, F.col("id") == F.col("root"), "left_anti").select(F.col("id").alias("u"), F.col("to").alias("v"), F.col("w").alias("m"))
    return merges, settle(rest)


#: Names that callers may give; the forest is the same.
METHODS = ("bisect", "bottomup")


def merge_table(e: DataFrame, test: EdgeTest = EdgeTest(), local: int = LOCAL, method: str = "bisect", both: bool = False) -> DataFrame:
    """u, v, m: the forest of merges of the edges that count. With ``both`` an edge stands for both directions; e is read several times then."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    sign = -1.0 if test.rev else 1.0
    valid = e.where(test.valid(F.col("w")) & (F.col("src") != F.col("dst")))
    if both:
        forest_ = _spanning_forest(valid.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") * sign).alias("w")), local)
        return settle(forest_.select("u", "v", (F.col("m") * sign).alias("m")))
    kept = valid.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max(F.col("w") * sign).alias("w"))
    parts = settle(kept.select(F.lit("").alias("part"), "a", "b", "w"))
    return settle(_merges(parts, local).select("u", "v", (F.col("m") * sign).alias("m")))


def _merges(parts: DataFrame, local: int) -> DataFrame:
    """Halves parts (part, a, b, w) of too many edges until all fit a task. A part is a graph of its own: the edges inside components at a threshold, or the rest with those
    contracted, where weights from the threshold on count as the next lower one, since they merge nothing."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, m = bisect(pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.w.to_numpy())
        return pd.DataFrame({"u": u, "v": v, "m": m})

    out = None
    while True:
        sizes = settle(parts.groupBy("part").agg(F.count("*").alias("n")))
        small = parts.join(sizes.where(F.col("n") <= local).select("part"), "part", "left_semi").groupBy("part").applyInPandas(solve, MERGE)
        large = sizes.where(F.col("n") > local)
        if large.isEmpty():
            return small if out is None else out.union(small)
        small = settle(small)
        rows = settle(parts.join(large.select("part"), "part", "left_semi"))
        levels = rows.select("part", "w").distinct()
        bounds = levels.groupBy("part").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.percentile_approx("w", 0.5, 10000).alias("half"))
        second = levels.join(bounds, "part").where(F.col("w") > F.col("least")).groupBy("part").agg(F.min("w").alias("second"))
        cut = bounds.join(second, "part", "left").select("part", "least", "most", F.when(F.col("half") > F.col("least"), F.col("half")).otherwise(F.coalesce("second", "least")).alias("at"))
        below = levels.join(cut, "part").where(F.col("w") < F.col("at")).groupBy("part").agg(F.max("w").alias("below"))
        marked = settle(rows.join(cut.join(below, "part", "left"), "part"))
        label = settle(connect.strong_components(marked.where("w >= at").select(F.col("part").alias("key"), "a", "b"), local).withColumnRenamed("key", "part"))
        a, b = (label.select("part", F.col("id").alias(c), F.col("component").alias(f"{c}_of")) for c in ("a", "b"))
        placed = settle(marked.join(a, ["part", "a"], "left").join(b, ["part", "b"], "left").withColumns({"a_of": F.coalesce("a_of", "a"), "b_of": F.coalesce("b_of", "b")}))
        strong = placed.where("a_of = b_of and w >= at")
        # Edges of one weight have no stronger half.
        joined = connect.components(strong.where("least = most").select(F.struct("part", "most").alias("key"), "a", "b"), local).where("id <> component")
        done = joined.select(F.col("id").alias("u"), F.col("component").alias("v"), F.col("key.most").alias("m"))
        out = settle(small.union(done) if out is None else out.union(small).union(done))
        inside = strong.where("least < most").select(F.concat("part", F.lit("1")).alias("part"), "a", "b", "w")
        rest = placed.where("a_of <> b_of and below is not null").groupBy(F.concat("part", F.lit("0")).alias("part"), F.col("a_of").alias("a"), F.col("b_of").alias("b"))
        parts = settle(inside.union(rest.agg(F.max(F.when(F.col("w") >= F.col("at"), F.col("below")).otherwise(F.col("w"))).alias("w"))))


def thresholds(merge: DataFrame, rev: bool = False) -> DataFrame:
    return merge.select(F.col("m").alias("threshold")).distinct().orderBy(F.desc("threshold") if rev else F.asc("threshold"))


def cuts(merge: DataFrame, vertices: DataFrame, at: DataFrame, rev: bool = False, minsize: int = 1, local: int = connect.LOCAL) -> DataFrame:
    """threshold, component (its smallest vertex), vertex, for every threshold in ``at``: a row for each vertex and threshold is the result.

    Merges travel to the thresholds at which they hold, so thresholds are solved apart from each other.
    """
    at = at.select("threshold").distinct()
    holds = F.col("m") <= F.col("threshold") if rev else F.col("m") >= F.col("threshold")
    kept = at.join(merge, holds).select(F.col("threshold").alias("key"), F.col("u").alias("a"), F.col("v").alias("b"))
    found = settle(connect.components(kept, local).select(F.col("key").alias("threshold"), F.col("id").alias("vertex"), "component"))
    if minsize > 1:
        big = found.groupBy("threshold", "component").agg(F.count("*").alias("n")).where(F.col("n") >= minsize).drop("n")
        return found.join(big, ["threshold", "component"]).join(vertices.select("vertex"), "vertex", "left_semi").select("threshold", "component", "vertex")
    grid = vertices.select("vertex").crossJoin(at)
    return grid.join(found, ["threshold", "vertex"], "left").select("threshold", F.coalesce("component", "vertex").alias("component"), "vertex")


def cut(merge: DataFrame, vertices: DataFrame, threshold: float, rev: bool = False, minsize: int = 1) -> DataFrame:
    at = merge.sparkSession.createDataFrame([(float(threshold),)], "threshold double")
    return cuts(merge, vertices, at, rev, minsize).select("component", "vertex")


def scc(e: DataFrame, vertices: DataFrame, test: EdgeTest = EdgeTest(), local: int = connect.LOCAL) -> DataFrame:
    """component, vertex: strong components of the edges that pass the test."""
    kept = e.where(test.valid(F.col("w"))).select(F.lit(0).alias("key"), F.col("src").alias("a"), F.col("dst").alias("b"))
    found = connect.strong_components(kept, local).select(F.col("id").alias("vertex"), "component")
    return vertices.select("vertex").join(found, "vertex", "left").select(F.coalesce("component", "vertex").alias("component"), "vertex")


def dendrogram(u: np.ndarray, v: np.ndarray, m: np.ndarray, rev: bool = False) -> pd.DataFrame:
    """Nodes of a forest of merges: component (smallest vertex), threshold, nvertices, up_component and up_threshold (of the parent; NaN for a root), is_leaf (a vertex, with a threshold of NaN)."""
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    levels, rank = np.unique(m if rev else -m, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    cuts_ = np.searchsorted(rank[order], np.arange(len(levels) + 1))
    root, size = np.arange(len(ids)), np.ones(len(ids), np.int64)
    holds = [-1] * len(ids)  # the node that holds the component of each root; -1: the vertex alone
    comp, level, count, up = [], [], [], []
    leaf_up = np.full(len(ids), -1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    for r in range(len(levels)):
        old: dict[int, set] = {}
        for e in order[cuts_[r] : cuts_[r + 1]].tolist():
            x, y = find(a[e]), find(b[e])
            if x == y:
                continue
            low, high = (x, y) if x < y else (y, x)
            parts = old.pop(low, {low}) | old.pop(high, {high})
            root[high] = low
            size[low] += size[high]
            old[low] = parts
        for low, parts in old.items():
            node = len(comp)
            comp.append(int(ids[low]))
            level.append(float(levels[r] if rev else -levels[r]))
            count.append(int(size[low]))
            up.append(-1)
            for q in parts:
                if holds[q] < 0:
                    leaf_up[q] = node
                else:
                    up[holds[q]] = node
            holds[low] = node
    comp_, level_, up_ = np.array(comp, np.int64), np.array(level, float), np.array(up, np.int64)
    far = lambda k: (np.where(k >= 0, comp_[np.maximum(k, 0)], -1), np.where(k >= 0, level_[np.maximum(k, 0)], np.nan)) if len(comp_) else (k, np.full(len(k), np.nan))
    uc, ut = far(up_)
    lc, lt = far(leaf_up)
    nodes = pd.DataFrame({"component": comp_, "threshold": level_, "nvertices": np.array(count, np.int64), "up_component": uc, "up_threshold": ut, "is_leaf": False})
    leaves = pd.DataFrame({"component": ids, "threshold": np.nan, "nvertices": np.int64(1), "up_component": lc, "up_threshold": lt, "is_leaf": True})
    return pd.concat([nodes, leaves], ignore_index=True)


_NODES = "component long, threshold double, nvertices long, up_component long, up_threshold double, is_leaf boolean"


def tree(merge: DataFrame, vertices: DataFrame, rev: bool = False) -> DataFrame:
    """node, parent, threshold, nvertices, component, children, vertices: the different components of more than one vertex, the root first.

    A node is named by its place in the order of threshold (weak to strong) and smallest vertex; ``component`` is that vertex, ``children`` its nodes, ``vertices`` those that are in no child.
    A component's threshold is the strongest at which it is one. If the whole graph never is one component, the root is the set of all vertices with a null threshold.
    The forest of merges, at most a row a vertex, is put in order in one task for each of its trees; vertices below a node come from ``tree_vertices``.
    """
    found = settle(_forests(merge).groupBy("tree").applyInPandas(lambda pdf: dendrogram(pdf.u.to_numpy(), pdf.v.to_numpy(), pdf.m.to_numpy(), rev), _NODES))
    real = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c))
    found = found.withColumns({"threshold": real("threshold"), "up_threshold": real("up_threshold")})
    n = vertices.count()
    nodes = found.where("not is_leaf")
    whole = n and nodes.where(F.col("nvertices") == n).isEmpty()
    inner = nodes.select("component", "threshold", "nvertices", "up_component", "up_threshold")
    least = vertices.agg(F.min("vertex").alias("component"), F.count("*").alias("nvertices"))
    if whole:
        inner = inner.union(least.select("component", F.lit(None).cast("double"), "nvertices", F.lit(-1).cast("long"), F.lit(None).cast("double")))
    order = F.desc_nulls_first("threshold") if rev else F.asc_nulls_first("threshold")
    named = settle(inner.withColumn("node", F.row_number().over(Window.orderBy(order, "component")).cast("long")))
    key = named.select(F.col("node").alias("parent"), F.col("component").alias("pc"), F.col("threshold").alias("pt"))
    joined = (F.col("up_component") == F.col("pc")) & F.col("up_threshold").eqNullSafe(F.col("pt"))
    below = settle(named.join(key, joined & (F.col("parent") != F.col("node")), "left").withColumn("parent", F.when(F.col("parent").isNull() & (F.col("node") > 1), F.lit(1).cast("long")).otherwise(F.col("parent"))).select("node", "parent", "threshold", "nvertices", "component"))
    children = below.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))
    leaves = found.where("is_leaf").select(F.col("component").alias("vertex"), "up_component", "up_threshold").join(key, joined).select(F.col("parent").alias("node"), "vertex")
    if whole:
        leaves = leaves.union(vertices.select("vertex").join(leaves.select("vertex"), "vertex", "left_anti").select(F.lit(1).cast("long"), "vertex"))
    own = leaves.groupBy("node").agg(F.array_sort(F.collect_list("vertex")).alias("vertices"))
    none = F.array().cast("array<long>")
    out = below.join(children, "node", "left").join(own, "node", "left")
    return out.select("node", "parent", "threshold", F.col("nvertices").cast("int").alias("nvertices"), "component", F.coalesce("children", none).alias("children"), F.coalesce("vertices", none).alias("vertices"))


def _forests(merge: DataFrame) -> DataFrame:
    """merge with ``tree``: merges that hang together."""
    whole = settle(connect.components(merge.select(F.lit(0).alias("key"), F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("u"), F.col("component").alias("tree")))
    return merge.join(whole, "u")


def tree_vertices(nodes: DataFrame) -> DataFrame:
    """node, vertex: all vertices below every node of ``tree``. Ancestors are found by doubling, so rounds grow with the logarithm of the depth."""
    own = settle(nodes.select("node", F.explode("vertices").alias("vertex")))
    jump = settle(nodes.where("parent is not null").select("node", F.col("parent").alias("up")))
    above = jump
    while not jump.isEmpty():
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("far"))
        above = settle(above.union(above.join(far, "up").select("node", "far")))
        jump = settle(jump.join(far, "up").select("node", F.col("far").alias("up")))
    return own.union(own.join(above, "node").select(F.col("up").alias("node"), "vertex"))


def same_tree(a: DataFrame, b: DataFrame) -> bool:
    """Whether two trees have the same nodes, thresholds and vertices."""
    names = ["node", "parent", "threshold", "nvertices", "children", "vertices"]
    return a.select(names).exceptAll(b.select(names)).isEmpty() and b.select(names).exceptAll(a.select(names)).isEmpty()
