"""Degree bins and permutations of node weights inside them. ``perm`` is a column; permutation 0 is the real data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import hilbert_order
from .ranks import numbered


#: Vertices whose distances one task can hold.
WARD_VERTICES = 8192


def vertexbins(e: DataFrame, vertices: DataFrame, by: str = "out", method: str = "sort", nbins: int = 10) -> DataFrame:
    """vertex, bin by one of the methods ``sort`` and ``tree``."""
    if method not in ("sort", "tree"):
        raise ValueError("method must be sort or tree")
    return (vertexbins_sort if method == "sort" else vertexbins_tree)(e, vertices, by, nbins)


def degrees(e: DataFrame, vertices: DataFrame, weightf=lambda w: w) -> DataFrame:
    """vertex, out, inn: sums of the (transformed) weights of a vertex's edges."""
    w = weightf(F.col("w"))
    out = e.groupBy(F.col("src").alias("vertex")).agg(F.sum(w).alias("out"))
    inn = e.groupBy(F.col("dst").alias("vertex")).agg(F.sum(w).alias("inn"))
    return vertices.select("vertex").join(out, "vertex", "left").join(inn, "vertex", "left").select("vertex", F.coalesce("out", F.lit(0.0)).alias("out"), F.coalesce("inn", F.lit(0.0)).alias("inn"))


def _chunks(d: DataFrame, by: list[Column], n: int, nbins: int) -> DataFrame:
    bin_ = F.floor((F.col("_rank") - 1) / max(1, math.ceil(n / nbins))) + 1
    return numbered(d, [*by, "vertex"], "_rank").withColumn("bin", bin_.cast("int")).drop("_rank")


def vertexbins_sort(e: DataFrame, vertices: DataFrame, by: str = "out", nbins: int = 10) -> DataFrame:
    """vertex, bin: chunks of equal size by falling degree; ``outXin`` bins both ways and follows a Hilbert curve."""
    d, n = degrees(e, vertices), vertices.count()
    if by in ("out", "in"):
        return _chunks(d, [F.desc("out" if by == "out" else "inn")], n, nbins).select("vertex", "bin")
    if by != "outXin":
        raise ValueError("by must be out, in or outXin")
    side = 2 ** math.ceil(math.log2(math.sqrt(nbins))) if nbins > 1 else 1
    a = _chunks(d, [F.desc("out")], n, side).withColumnRenamed("bin", "i")
    b = _chunks(d.select("vertex", "inn"), [F.desc("inn")], n, side).select("vertex", F.col("bin").alias("j"))
    placed = a.join(b, "vertex").withColumn("place", hilbert_order(F.col("i"), F.col("j"), side))
    return _chunks(placed, [F.asc("place")], n, nbins).select("vertex", "bin")


def vertexbins_tree(e: DataFrame, vertices: DataFrame, by: str = "out", nbins: int = 10, weightf=F.sqrt) -> DataFrame:
    """vertex, bin: Ward clusters of the root-weight degrees, on root distances. One task holds a matrix of all pairs, so more than WARD_VERTICES are refused: bin those with ``vertexbins_sort``."""
    if vertices.count() > WARD_VERTICES:
        raise ValueError(f"Ward clusters are for {WARD_VERTICES} vertices at most")
    if by not in ("out", "in", "outXin"):
        raise ValueError("by must be out, in or outXin")
    d = degrees(e, vertices, weightf)
    columns = {"out": ["out"], "in": ["inn"], "outXin": ["out", "inn"]}[by]

    def ward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vertex")
        x = pdf[columns].to_numpy()
        dist = np.sqrt(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))) ** 2
        np.fill_diagonal(dist, np.inf)
        size, label, live = np.ones(len(x)), np.arange(len(x)), np.ones(len(x), bool)
        for _ in range(max(0, len(x) - nbins)):
            i, j = sorted(np.unravel_index(dist.argmin(), dist.shape))
            k = live & (np.arange(len(x)) != i) & (np.arange(len(x)) != j)
            # Lance-Williams update of Ward's criterion on squared distances.
            new = ((size[i] + size[k]) * dist[i, k] + (size[j] + size[k]) * dist[j, k] - size[k] * dist[i, j]) / (size[i] + size[j] + size[k])
            dist[i, k] = dist[k, i] = new
            dist[j, :] = dist[:, j] = np.inf
            size[i] += size[j]
            live[j] = False
            label[label == j] = i
        return pd.DataFrame({"vertex": pdf.vertex.to_numpy(), "bin": np.unique(label, return_inverse=True)[1].astype(np.int32) + 1})

    return d.groupBy().applyInPandas(ward, "vertex long, bin int")


def randpermgroups(bins: DataFrame, nperm: int, seed: int = 1) -> DataFrame:
    """perm, vertex, from_vertex for permutations 1..nperm: vertices trade places inside their bin, in the order of md5(seed:perm:vertex), whatever the partitioning."""
    perms = bins.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(nperm))))
    here = Window.partitionBy("perm", "bin")
    a = perms.select("perm", "bin", "vertex", F.row_number().over(here.orderBy("vertex")).alias("rank"))
    b = perms.select("perm", "bin", F.col("vertex").alias("from_vertex"), F.row_number().over(here.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm"), F.col("vertex"))), "vertex")).alias("rank"))
    return a.join(b, ["perm", "bin", "rank"]).select("perm", "vertex", "from_vertex")


def permuted_weights(weights: DataFrame, bins: DataFrame, nperm: int, seed: int = 1) -> DataFrame:
    """perm, vertex, weight; vertices in no bin keep their own weight."""
    moved = randpermgroups(bins, nperm, seed).join(weights.select(F.col("vertex").alias("from_vertex"), "weight"), "from_vertex").select("perm", "vertex", "weight")
    still = weights.join(bins, "vertex", "left_anti").select(F.explode(F.sequence(F.lit(1), F.lit(nperm))).alias("perm"), "vertex", "weight")
    return moved.union(still)
