"""Connected and strongly connected components of many graphs at once: ``key`` tells the graphs apart.

Graphs of at most ``LOCAL`` edges are solved each in one task; larger ones by rounds of joins over the edge table. Both give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle

#: Edges that a task holds as arrays.
LOCAL = 1 << 21


def label_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of 0..n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def strong_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the strongly connected component of each of 0..n-1, by a depth-first search without recursion."""
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, label, stack = [0] * n, [0] * n, [-1] * n, []
    clock = 0
    at = first[:-1]
    for start in range(n):
        if seen[start] or first[start] == first[start + 1]:
            continue
        clock += 1
        seen[start] = low[start] = clock
        stack.append(start)
        path = [start]
        while path:
            v = path[-1]
            if at[v] < first[v + 1]:
                u = to[at[v]]
                at[v] += 1
                if not seen[u]:
                    clock += 1
                    seen[u] = low[u] = clock
                    stack.append(u)
                    path.append(u)
                elif label[u] < 0 and seen[u] < low[v]:
                    low[v] = seen[u]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                where = len(stack) - 1
                while stack[where] != v:
                    where -= 1
                members = stack[where:]
                del stack[where:]
                least = min(members)
                for u in members:
                    label[u] = least
    out = np.array(label, np.int64)
    alone = out < 0
    out[alone] = np.flatnonzero(alone)
    return out


def _sizes(edges: DataFrame, local: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges of graphs for one task and of larger ones; None for those there are none of."""
    n = edges.groupBy("key").agg(F.count("*").alias("n_edges"))
    most = n.agg(F.max("n_edges")).first()[0] or 0
    if most <= local:
        return edges, None
    marked = edges.join(n, "key")
    return marked.where(F.col("n_edges") <= local).drop("n_edges"), marked.where(F.col("n_edges") > local).drop("n_edges")


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """key, id, component for edges (key, a, b): the smallest id connected with every id that has an edge."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(np.concatenate([pdf.a, pdf.b]), return_inverse=True)
        root = label_min(len(ids), code[: len(pdf)], code[len(pdf) :])
        return pd.DataFrame({"key": pdf.key.iloc[0], "id": ids, "component": ids[root]})

    schema = f"key {edges.schema['key'].dataType.simpleString()}, id long, component long"
    edges = edges.select("key", "a", "b")
    small, large = _sizes(edges, local)
    out = small.groupBy("key").applyInPandas(solve, schema)
    return out if large is None else out.union(_components_by_joins(large).select("key", "id", "component"))


def _components_by_joins(edges: DataFrame) -> DataFrame:
    """Every node takes its smallest neighbour, edges are relabelled, until none is left; then the maps are followed."""
    both = lambda e: e.union(e.select("key", F.col("b").alias("a"), F.col("a").alias("b")))
    label = settle(both(edges).select("key", F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    edges = settle(edges.where("a <> b").distinct())
    while not edges.isEmpty():
        low = settle(both(edges).groupBy("key", F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("low")))
        label = settle(label.join(low.withColumnRenamed("id", "component"), ["key", "component"], "left").select("key", "id", F.coalesce("low", "component").alias("component")))
        a, b = (low.select("key", F.col("id").alias(c), F.col("low").alias(f"{c}_low")) for c in ("a", "b"))
        edges = settle(edges.join(a, ["key", "a"]).join(b, ["key", "b"]).select("key", F.col("a_low").alias("a"), F.col("b_low").alias("b")).where("a <> b").distinct())
    return label


def strong_components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """key, id, component for edges (key, a, b): the smallest id of the strongly connected component of every id that has an edge."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(np.concatenate([pdf.a, pdf.b]), return_inverse=True)
        root = strong_labels(len(ids), code[: len(pdf)], code[len(pdf) :])
        return pd.DataFrame({"key": pdf.key.iloc[0], "id": ids, "component": ids[root]})

    schema = f"key {edges.schema['key'].dataType.simpleString()}, id long, component long"
    edges = edges.select("key", "a", "b")
    small, large = _sizes(edges, local)
    out = small.groupBy("key").applyInPandas(solve, schema)
    return out if large is None else out.union(_strong_by_joins(large).select("key", "id", "component"))


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """label (key, id, color) pushed along the edges until nothing changes: the smallest label that reaches every id."""
    while True:
        pushed = edges.join(label.select("key", F.col("id").alias("a"), "color"), ["key", "a"]).groupBy("key", F.col("b").alias("id")).agg(F.min("color").alias("new"))
        step = settle(label.join(pushed, ["key", "id"], "left").select("key", "id", F.least("color", "new").alias("color"), (F.col("new") < F.col("color")).alias("moved")))
        label = step.select("key", "id", "color")
        if step.where("moved").isEmpty():
            return label


def _strong_by_joins(edges: DataFrame) -> DataFrame:
    """Forward colours by smallest id; what reaches a colour's own vertex inside the colour is its component. Components leave, the rest is coloured again."""
    edges = settle(edges.where("a <> b").distinct().union(edges.where("a = b").distinct()))
    todo = settle(edges.select("key", F.col("a").alias("id")).union(edges.select("key", "b")).distinct())
    found = None
    while not todo.isEmpty():
        color = _spread(edges, todo.select("key", "id", F.col("id").alias("color")))
        a, b = (color.select("key", F.col("id").alias(c), F.col("color").alias(f"{c}_color")) for c in ("a", "b"))
        inside = settle(edges.join(a, ["key", "a"]).join(b, ["key", "b"]).where("a_color = b_color").select("key", F.col("b").alias("a"), F.col("a").alias("b")))
        far = F.lit((1 << 63) - 1)
        back = _spread(inside, color.select("key", "id", F.when(F.col("id") == F.col("color"), F.col("color")).otherwise(far).alias("color")))
        done = back.where(F.col("color") < far).select("key", "id", F.col("color").alias("component"))
        found = done if found is None else found.union(done)
        todo = settle(todo.join(done, ["key", "id"], "left_anti"))
        left = lambda c: todo.select("key", F.col("id").alias(c))
        edges = settle(edges.join(left("a"), ["key", "a"], "left_semi").join(left("b"), ["key", "b"], "left_semi"))
    if found is None:
        return edges.select("key", F.col("a").alias("id"), F.col("b").alias("component"))
    return settle(found)
