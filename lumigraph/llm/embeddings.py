"""Embedding near-duplicates by int8 tile products with error bounds.

Unit vectors are quantised to int8 with a scale of their own; the norm of what that leaves, delta, is measured in double precision. For two vectors the true cosine then
differs from the scaled integer product by at most (1 + delta_u) delta_v + delta_u (plus rounding), so a pair whose product and bound together stay below the
threshold can't be linked. Only the others are recomputed in full precision. Integer products of up to ``1 << 24`` are exact in float32, so a tile is one matrix product.

Vectors of a label are dealt into blocks of at most about ``BLOCK`` by hash and every two blocks of a label meet in one tile. A tile returns link counts and a
forest of its links, never the pairs. Equal vectors of a label are one class with a count, so copies make no pairs.

Defined cases: a null label, or a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of different length never link; rows of one vec_id
are vectors of their own with the same name; rows with a null vec_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, components, label_min, record

BLOCK = 2048
SLAB = 256
ROUNDING = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, and the norm of the error, for the rows of x made unit."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    delta = np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-12
    return q.astype(np.int8), scale, delta


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs (row of a, row of b; row before column if same) and how many were recomputed."""
    qa, sa, da = quantise(a)
    qb, sb, db = quantise(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fb = qb.astype(kind).T
    ub = b / np.linalg.norm(b, axis=1, keepdims=True)
    rows, cols, again = [], [], 0
    for lo in range(0, len(a), SLAB):
        hi = min(lo + SLAB, len(a))
        bound = (1 + da[lo:hi, None]) * db[None, :] + da[lo:hi, None]
        maybe = (qa[lo:hi].astype(kind) @ fb) * (sa[lo:hi, None] * sb[None, :]) + bound >= threshold - ROUNDING
        if same:
            maybe &= np.arange(len(b))[None, :] > np.arange(lo, hi)[:, None]
        r = np.flatnonzero(maybe.any(1))
        if not len(r):
            continue
        again += int(maybe.sum())
        if maybe.sum() <= 32 * len(r):
            i, j = np.nonzero(maybe)
            va = a[lo + i] / np.linalg.norm(a[lo + i], axis=1, keepdims=True)
            good = np.einsum("ij,ij->i", va, ub[j]) >= threshold
            rows.append(lo + i[good])
            cols.append(j[good])
        else:
            va = a[lo + r] / np.linalg.norm(a[lo + r], axis=1, keepdims=True)
            i, j = np.nonzero((va @ ub.T >= threshold) & maybe[r])
            rows.append(lo + r[i])
            cols.append(j)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(rows), cat(cols), again


def _pack(table: pa.Table) -> pa.Table:
    vectors = table.column("embedding").combine_chunks()
    x = vectors.flatten().to_numpy().astype(np.float32)
    return pa.table({
        "label": table.column("label").slice(0, 1), "dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "blocks": table.column("blocks").slice(0, 1),
        "ids": pa.array([table.column("rep").to_numpy().tobytes()], pa.binary()), "counts": pa.array([table.column("copies").to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()),
    })


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of dim, same, (ids, counts, x) of two blocks -> rep, links found, root."""
        for batch in batches:
            for dim, same, ids_a, counts_a, x_a, ids_b, counts_b, x_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ia, ib = np.frombuffer(ids_a, np.int64), np.frombuffer(ids_b, np.int64)
                ca, cb = np.frombuffer(counts_a, np.int64), np.frombuffer(counts_b, np.int64)
                a, b = (np.frombuffer(x, np.float32).reshape(-1, dim).astype(np.float64) for x in (x_a, x_b))
                i, j, _ = tile_links(a, b, threshold, same)
                if not len(i):
                    continue
                shift = 0 if same else len(ia)
                n = shift + len(ib)
                ids, counts = (ib, cb) if same else (np.concatenate([ia, ib]), np.concatenate([ca, cb]))
                links = np.bincount(i, counts[j + shift], n) + np.bincount(j + shift, counts[i], n)
                root = label_min(n, i, j + shift)
                hit = np.flatnonzero(links > 0)
                yield record({"rep": ids[hit], "links": links[hit].astype(np.int64), "root": ids[root[hit]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id long, embedding array of float, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    x = F.col("embedding").cast("array<float>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    named = vectors.where("vec_id is not null").select("vec_id", F.col("label").cast("string").alias("label"), x.alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"))
    named = named.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", F.lit(7), "label")})
    ids = scratch.save(named.select("vec_id", "label", "good", "h1", "h2", F.size("embedding").alias("dim")), "ids")
    classes = scratch.save(ids.where("good").groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # One vector of each class: the rep's own row (rows of one vec_id with equal vectors are dropped to one).
    own = named.where("good").select(F.col("vec_id").alias("rep"), "h1", "h2", "embedding").join(classes, ["rep", "h1", "h2"]).dropDuplicates(["rep", "h1", "h2"])
    dealt = own.join(counts, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int"))
    packed = scratch.save(dealt.select("label", "dim", "block", "blocks", "rep", "copies", "embedding").groupBy("label", "dim", "block").applyInArrow(_pack, "label string, dim int, block int, blocks int, ids binary, counts binary, x binary"), "blocks")
    sides = packed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low = sides.where("block <= with").select("label", "dim", F.col("block").alias("lo"), F.col("with").alias("hi"), F.col("ids").alias("ids_a"), F.col("counts").alias("counts_a"), F.col("x").alias("x_a"))
    high = sides.where("with <= block").select("label", "dim", F.col("with").alias("lo"), F.col("block").alias("hi"), F.col("ids").alias("ids_b"), F.col("counts").alias("counts_b"), F.col("x").alias("x_b"))
    met = low.join(high, ["label", "dim", "lo", "hi"]).select("dim", (F.col("lo") == F.col("hi")).alias("same"), "ids_a", "counts_a", "x_a", "ids_b", "counts_b", "x_b")
    found = scratch.save(met.mapInArrow(_tiles(threshold), "rep long, links long, root long"), "found")
    chained = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "rep", "left").join(chained, classes.rep == chained.id, "left").select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = ids.where("good").join(per_class, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = ids.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """DuckDB SQL for ``query``: all pairs of a label, then reachability."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings WHERE vec_id IS NOT NULL),
g AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) n FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
c AS (SELECT a, least(a, min(b)) m FROM r GROUP BY a), k AS (SELECT a, count(*) n FROM s GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.m, v.vec_id) AS component_id, coalesce(c.m, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id"""
