"""Edge tables: import, tests, ranks, condensing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import settle
from .ranks import numbered


@dataclass(frozen=True)
class EdgeTest:
    """Which edges count: not the skipped value and at least as strong as the threshold (at most as large, if reversed)."""

    threshold: float | None = None
    skipval: float | None = 0.0
    rev: bool = False

    def _real(self, w: Column) -> Column:
        return F.lit(True) if self.skipval is None else w != F.lit(self.skipval)

    def valid(self, w: Column) -> Column:
        if self.threshold is None:
            return self._real(w)
        return self._real(w) & (w <= self.threshold if self.rev else w >= self.threshold)

    def indexed(self, w: Column) -> Column:
        """The other side: not stronger than the threshold."""
        if self.threshold is None:
            return self._real(w)
        return self._real(w) & (w >= self.threshold if self.rev else w <= self.threshold)

    @property
    def default(self) -> float:
        return self.skipval if self.skipval is not None else float("inf") if self.rev else float("-inf")


def isweaker(a: Column, b: Column, rev: bool = False) -> Column:
    return a > b if rev else a < b


def isstronger(a: Column, b: Column, rev: bool = False) -> Column:
    return isweaker(b, a, rev)


def import_digraph(raw: DataFrame, src: str = "src", dst: str = "dst", w: str = "w", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with ids from 1 in label order, and (vertex, label). Of a repeated pair the row that is last by ``order`` counts, the largest weight if none is given."""
    labels = raw.select(F.col(src).alias("label")).union(raw.select(dst)).distinct()
    nodes = settle(numbered(labels, ["label"], "vertex").select("vertex", "label"))
    last = F.max_by(w, order) if order else F.max(w)
    one = raw.groupBy(F.col(src).alias("s"), F.col(dst).alias("d")).agg(last.cast("double").alias("w"))
    a, b = (nodes.select(F.col("vertex").alias(n), F.col("label").alias(f"{n}_label")) for n in ("src", "dst"))
    return one.join(a, F.col("s") == F.col("src_label")).join(b, F.col("d") == F.col("dst_label")).select("src", "dst", "w"), nodes


def check_vertices(e: DataFrame, vertices: DataFrame) -> None:
    ends = e.select(F.col("src").alias("vertex")).union(e.select("dst"))
    if not ends.join(vertices, "vertex", "left_anti").isEmpty():
        raise ValueError("an edge ends in no vertex")


def outedges(e: DataFrame, vertex: int, test: EdgeTest = EdgeTest()) -> DataFrame:
    return e.where((F.col("src") == vertex) & test.valid(F.col("w"))).select("dst", "w")


def outedges_sparse(e: DataFrame, vertex: int, test: EdgeTest = EdgeTest()) -> DataFrame:
    """As ``outedges``, where absent edges can't count: the threshold must be positive."""
    if test.threshold is not None and test.threshold <= 0:
        raise ValueError("the threshold must be positive")
    return outedges(e, vertex, test)


def induced_subgraph(e: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select("vertex")
    return e.join(v, e.src == v.vertex, "left_semi").join(v, F.col("dst") == v.vertex, "left_semi")


def sorted_values(e: DataFrame, test: EdgeTest = EdgeTest()) -> DataFrame:
    return e.where(test.indexed(F.col("w"))).select("w").distinct().orderBy(F.desc("w") if test.rev else F.asc("w"))


def index_values(e: DataFrame, test: EdgeTest = EdgeTest()) -> DataFrame:
    """Edges with their weight's dense rank, weak to strong; ranks come from the distinct values, joined back."""
    order = F.desc("w") if test.rev else F.asc("w")
    ranks = numbered(e.where(test.indexed(F.col("w"))).select("w").distinct(), [order], "rank")
    return e.join(ranks, "w").select("src", "dst", "w", F.col("rank").cast("int").alias("rank"))


def condense(e: DataFrame, rows: DataFrame, cols: DataFrame | None = None, test: EdgeTest = EdgeTest(), zerodiag: bool = False, check: bool = False) -> DataFrame:
    """Strongest edge between groups; rows: (vertex, part) for destinations, cols for sources. A block without a real edge has no row. An edge that ends in no group doesn't count; with ``check`` it is an error."""
    if check:
        for ends, groups in (("dst", rows), ("src", rows if cols is None else cols)):
            check_vertices(e.select(F.col(ends).alias("src"), F.col(ends).alias("dst")), groups)
    cols = rows if cols is None else cols
    d = rows.select(F.col("vertex").alias("dst"), F.col("part").alias("dst_part"))
    s = cols.select(F.col("vertex").alias("src"), F.col("part").alias("src_part"))
    best = F.min("w") if test.rev else F.max("w")
    out = e.where(test._real(F.col("w"))).join(d, "dst").join(s, "src").groupBy("src_part", "dst_part").agg(best.alias("w"))
    return out.where("src_part <> dst_part") if zerodiag else out


def neighborhood_weights(e: DataFrame, graph: DataFrame, vertices: DataFrame) -> DataFrame:
    """For every vertex the sum of its edges in e over its neighbours in graph, itself left out."""
    kept = e.where("src <> dst").join(graph.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    sums = kept.groupBy(F.col("src").alias("vertex")).agg(F.sum("w").alias("weight"))
    return vertices.select("vertex").join(sums, "vertex", "left").select("vertex", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def empty_edges(spark: SparkSession) -> DataFrame:
    """No edge, with the schema of edges."""
    return spark.createDataFrame([], "src long, dst long, w double")


def diedge_ends(diedge: Column, n: int) -> tuple[Column, Column]:
    """src and dest of the pairs of vertices 1..n that are numbered from 1, column by column."""
    return (F.floor((diedge - 1) / n) + 1).cast("long"), (F.pmod(diedge - 1, F.lit(n)) + 1).cast("long")


def all_pairs(e: DataFrame, n: int) -> DataFrame:
    """Every directed pair of vertices 1..n, column by column, with its weight or 0: n squared rows by definition."""
    spark = e.sparkSession
    src, dest = diedge_ends(F.col("id") + 1, n)
    pairs = spark.range(n * n).select((F.col("id") + 1).alias("diedge"), src.alias("src"), dest.alias("dest"))
    return pairs.join(e.select("src", F.col("dst").alias("dest"), "w"), ["src", "dest"], "left").select("diedge", "src", "dest", F.coalesce("w", F.lit(0.0)).alias("w"))
