"""Random walks with restart. S has one column for each source vertex: an edge's weight over the sum of its source's edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle

#: Vertices up to which a walk is solved densely in one task; beyond, rounds of joins give the same entries.
DENSE = 2048
#: Terms of the series are added until the largest falls below this share of the restart probability.
TOLERANCE = 1e-14
#: A walk whose terms grow beyond this has no limit.
DIVERGED = 1e12


def stepmatrix(e: DataFrame, inedge: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """Edges scaled by the weight (vertex, weight) of their destination, then divided by the sum over their source. Sums are aggregated and joined back, so a source with most edges is split."""
    if inedge is not None:
        f = inedge.select(F.col("vertex").alias("dst"), F.col("weight").alias("factor"))
        e = e.join(f, "dst").select("src", "dst", (F.col("w") * F.col("factor")).alias("w"))
    if not normalize:
        return e
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    return e.join(total, "src").select("src", "dst", F.when(F.col("total") == 0, F.col("w")).otherwise(F.col("w") / F.when(F.col("total") != 0, F.col("total"))).alias("w"))


def check_restart(r: float) -> None:
    if not 0 <= r <= 1:
        raise ValueError("the restart probability must be between 0 and 1")


def _identity(vertices: DataFrame, r: float) -> DataFrame:
    return vertices.select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"), F.lit(float(r)).alias("w"))


def random_walk(step: DataFrame, vertices: DataFrame, r: float, tolerance: float = TOLERANCE, dense: int = DENSE) -> DataFrame:
    """W = r (I - (1 - r) S)^-1 as src, dst, w: an entry for every vertex that can be reached. r = 0 gives no entries, r = 1 the identity.

    Its size is the number of connected pairs. Where only W x is needed, ``diffuse`` doesn't make it.
    """
    check_restart(r)
    if r in (0, 1):
        return _identity(vertices, r).where(F.lit(r == 1))
    if vertices.count() <= dense:
        return _solve(step, vertices, r)
    s = settle(step.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("s")))
    term = _identity(vertices, r)
    terms, grown = [term], None
    while True:
        moved = term.join(s, term.dst == s.mid).select("src", F.col("to").alias("dst"), (F.col("w") * F.col("s") * (1 - r)).alias("w"))
        term = settle(moved.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w <> 0"))
        most = term.agg(F.max(F.abs("w"))).first()[0]
        if most is None:
            break
        _check_growth(most)
        terms.append(term)
        if len(terms) == 9:
            terms = [settle(_added(terms))]
        # Entries that are reached later are entries too, however small: the search goes on until no new pair turns up.
        pairs = term.select("src", "dst") if grown is None else grown.union(term.select("src", "dst")).distinct()
        pairs = settle(pairs)
        if most <= tolerance * r and grown is not None and pairs.count() == grown.count():
            break
        grown = pairs
    return _added(terms)


def _added(terms: list[DataFrame]) -> DataFrame:
    out = terms[0]
    for t in terms[1:]:
        out = out.union(t)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _check_growth(most: float) -> None:
    if most > DIVERGED:
        raise ValueError("the walk has no limit: normalise the steps or restart more often")


def _matrix(e: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    m = np.zeros((len(ids), len(ids)))
    np.add.at(m, (np.searchsorted(ids, e.dst.to_numpy(np.int64)), np.searchsorted(ids, e.src.to_numpy(np.int64))), e.w.to_numpy())
    return m


def _solve(step: DataFrame, vertices: DataFrame, r: float) -> DataFrame:
    """Bounded by DENSE vertices: all edges meet in one task."""
    rows = step.select("src", "dst", "w").union(vertices.select(F.col("vertex").alias("src"), F.lit(None).cast("long"), F.lit(0.0)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf[pdf.dst.isna()].src.unique())
        m = _matrix(pdf[pdf.dst.notna()], ids)
        w = r * np.linalg.inv(np.eye(len(ids)) - (1 - r) * m)
        reached = (np.eye(len(ids)) + (m != 0)).astype(np.float32)
        for _ in range(max(1, int(np.ceil(np.log2(max(len(ids), 2)))))):
            reached = np.minimum(reached @ reached, 1)
        i, j = np.nonzero(reached)  # elsewhere the inverse holds rounding errors only
        return pd.DataFrame({"src": ids[j], "dst": ids[i], "w": w[i, j]})

    return rows.groupBy().applyInPandas(solve, "src long, dst long, w double")


def diffuse(step: DataFrame, weights: DataFrame, r: float, tolerance: float = TOLERANCE, dense: int = DENSE) -> DataFrame:
    """W x by the vector's own iteration: vertex, weight for every vertex of ``weights`` (vertex, weight). With a column ``perm`` all permutations at once.

    A round costs a join of the steps with a row for each vertex and permutation. r = 0 gives zeros.
    """
    check_restart(r)
    keys = ["perm"] if "perm" in weights.columns else []
    weights = weights.select(*keys, "vertex", F.col("weight").cast("double").alias("weight"))
    if r in (0, 1):
        return weights.withColumn("weight", F.col("weight") * F.lit(float(r)))
    if weights.select("vertex").distinct().count() <= dense:
        return _diffuse_dense(step, weights, r)
    s = settle(step.select(F.col("src").alias("vertex"), F.col("dst").alias("to"), F.col("w").alias("s")))
    start = settle(weights.withColumn("weight", F.col("weight") * r))
    scale = start.agg(F.max(F.abs("weight"))).first()[0] or 0.0
    term, terms = start, [start]
    while scale:
        for _ in range(4):  # a few rounds to a table
            moved = term.join(s, "vertex").select(*keys, F.col("to").alias("vertex"), (F.col("weight") * F.col("s") * (1 - r)).alias("weight"))
            term = moved.groupBy(*keys, "vertex").agg(F.sum("weight").alias("weight"))
            terms.append(term)
        both = terms[0]
        for t in terms[1:]:
            both = both.union(t)
        last = term.withColumnRenamed("weight", "last")
        added = both.groupBy(*keys, "vertex").agg(F.sum("weight").alias("weight")).join(last, [*keys, "vertex"], "left")
        state = settle(added)
        most = state.agg(F.max(F.abs("last"))).first()[0] or 0.0
        _check_growth(most / scale)
        term, terms = state.where("last is not null").select(*keys, "vertex", F.col("last").alias("weight")), [state.drop("last")]
        if most <= tolerance * scale:
            break
    return weights.drop("weight").join(terms[0], [*keys, "vertex"], "left").select(*keys, "vertex", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def _diffuse_dense(step: DataFrame, weights: DataFrame, r: float) -> DataFrame:
    """Bounded by DENSE vertices: each permutation's task solves the system with the steps, which travel to it."""
    keys = ["perm"] if "perm" in weights.columns else []
    x = weights.withColumn("perm", F.lit(0)) if not keys else weights
    perms = x.select("perm").distinct()
    e = step.select(F.col("src"), F.col("dst"), "w").crossJoin(F.broadcast(perms))  # a copy of the steps for each task
    rows = e.select("perm", "src", "dst", "w").union(x.select("perm", F.col("vertex").alias("src"), F.lit(None).cast("long"), "weight"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.dst.isna()].sort_values("src")
        ids = own.src.to_numpy()
        m = _matrix(pdf[pdf.dst.notna()], ids)
        return pd.DataFrame({"perm": pdf.perm.iloc[0], "vertex": ids, "weight": r * np.linalg.solve(np.eye(len(ids)) - (1 - r) * m, own.w.to_numpy())})

    out = rows.groupBy("perm").applyInPandas(solve, f"perm {x.schema['perm'].dataType.simpleString()}, vertex long, weight double")
    return out.select(*keys, "vertex", "weight")


def similarity(walk: DataFrame, weights: DataFrame) -> DataFrame:
    """W with every source scaled by its weight."""
    x = weights.select(F.col("vertex").alias("src"), F.col("weight").alias("x"))
    return walk.join(x, "src").select("src", "dst", (F.col("w") * F.col("x")).alias("w"))


def stabilized_step(step: DataFrame, weights: DataFrame, r: float) -> DataFrame:
    """k (1 - r) S diag(W x) + r diag(x), with k the sum of x over the sum of W x (0 if that is 0)."""
    wx = settle(diffuse(step, weights, r))
    sums = wx.agg(F.sum("weight").alias("below")).join(F.broadcast(weights.agg(F.sum("weight").alias("above"))))
    k = sums.select(F.when(F.col("below") == 0, 0.0).otherwise(F.col("above") / F.when(F.col("below") != 0, F.col("below"))).alias("k"))  # one row
    scaled = step.join(wx.select(F.col("vertex").alias("src"), F.col("weight").alias("x")), "src").join(F.broadcast(k)).select("src", "dst", (F.col("w") * F.col("x") * F.col("k") * (1 - r)).alias("w"))
    diag = weights.select(F.col("vertex").alias("src"), F.col("vertex").alias("dst"), (F.col("weight") * r).alias("w"))
    return scaled.union(diag).groupBy("src", "dst").agg(F.sum("w").alias("w"))
