"""What the corpus operators share: tables in the shared folder, components of a link graph, word and shingle hashes.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, so that they outlive lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import remove, shared_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder by one operator run; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")  # this job's shuffle files go when the table stands
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        finally:
            self.spark.conf.unset(SHUFFLE_CLEANUP) if before is None else self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_buckets(spark: SparkSession, per_core: int = 2, least: int = 8) -> int:
    """Buckets for packed blobs: as many as the session's shuffle partitions, which the user sizes for the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) * per_core, least)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge (columns a, b).

    Each round maps every node to its smallest neighbour and relabels the edges, after each partition has contracted
    its own edges to a forest. Rounds grow with the logarithm of the longest chain. Nothing is collected.
    """
    forest = lambda df: df.mapInArrow(_local_forest, "a long, b long").distinct()
    edges = scratch.save(forest(edges.where("a <> b").select("a", "b")), f"{name}-e0")
    maps, k = [], 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("low")), f"{name}-m{k}")
        maps.append(low)
        moved = edges.join(low, edges.a == low.id).select(F.col("low").alias("a"), "b")
        low2 = low.withColumnsRenamed({"id": "id2", "low": "low2"})
        moved = moved.join(low2, moved.b == low2.id2).select("a", F.col("low2").alias("b")).where("a <> b")
        k += 1
        edges = scratch.save(forest(moved), f"{name}-e{k}")
        scratch.drop(f"{name}-e{k - 1}")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0].withColumnRenamed("low", "component")
    for low in maps[1:]:
        low = low.withColumnRenamed("id", "via")
        out = out.join(low, out.component == low.via, "left").select("id", F.coalesce("low", "component").alias("component"))
    out = scratch.save(out, f"{name}-out")
    scratch.drop(*[f"{name}-m{k}" for k in range(len(maps))], f"{name}-e{len(maps)}")
    return out


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts the edges of a partition, a bounded number at a time."""
    held, rows = [], 0

    def flush():
        a, b = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = label_min(len(ids), codes[: len(a)], codes[len(a) :])
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
        if rows > 2_000_000:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def label_min(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for nodes 0..n-1 and edges (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        keep = ra != rb
        if not keep.any():
            break
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


# ---- words and shingles -------------------------------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_tables: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _tables[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a space after each, and where each begins (with the end as last)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=start[1:])
    return buf, start


def slice_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from first to end."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers("up", _MULT, len(buf)), out=total[1:])
    return mix64((total[end] - total[first]) * _powers("down", _INV, len(buf))[first])


def words(buf: np.ndarray, start: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: hashes, owning text, first byte, end byte.

    alnum: words are runs of ASCII letters and digits and bytes from 128 on instead.
    """
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _ALNUM[buf] if alnum else ~_SPACE[buf]
    step = np.diff(inside)
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(start, first, "right") - 1
    return slice_hashes(_LOWER[buf], first, end), owner, first, end


def shingles(h: np.ndarray, owner: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes by text: hashes, and their owner, sorted by owner and hash.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    count = np.bincount(owner, minlength=n_texts)
    out_h, out_o = [], []
    if len(h) >= n:
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            acc = mix64(acc * np.uint64(_MULT) + h[k : len(h) - n + 1 + k])
        whole = owner[: len(acc)] == owner[n - 1 :]
        out_h.append(acc[whole])
        out_o.append(owner[: len(acc)][whole])
    first = np.cumsum(count) - count
    for length in range(1, n):
        short = np.flatnonzero(count == length)
        if len(short):
            acc = np.full(len(short), length, np.uint64)
            for k in range(length):
                acc = mix64(acc * np.uint64(_MULT) + h[first[short] + k])
            out_h.append(acc)
            out_o.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hs, os = np.concatenate(out_h), np.concatenate(out_o)
    order = np.lexsort((hs, os))
    hs, os = hs[order], os[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
    return hs[new], os[new]


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) from batches of (id, text), about ``limit`` bytes at a time; a null text is empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def row_batches(batches: Iterator[pa.RecordBatch], at: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of whole rows with about ``limit`` bytes of text in column ``at`` (or one longer text), and those texts; a null text is empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        lo, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > lo and size + n > limit:
                part = batch.slice(lo, i - lo)
                yield part, [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                lo, size = i, 0
            size += n
        if lo < batch.num_rows:
            part = batch.slice(lo)
            yield part, [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]


def record(names_arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in names_arrays.values()], names=list(names_arrays))
