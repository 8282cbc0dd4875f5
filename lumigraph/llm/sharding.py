"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, largest first, each to the least loaded shard of a heap (ties: the smaller shard number). Groups of one size are
interchangeable, so the driver only needs how many groups there are of each size: all groups of a size are dealt at once, with the loads that dealing them one by one
through the heap would give, and ranks inside the size then say which group goes where. Different sizes add up to the whole input, so there are at most the root of twice its bytes of them.

Ranks are numbered by cells of a size, copies find their group by a join that has the groups with most rows (at most ``HOT``) broadcast, and slots are numbered by cells of a shard: no size, group or
shard is brought into one task.

Defined cases: null texts are one group of size 1 a row; empty texts another; an empty table gives no rows; repeated rows
are rows of their own and share a shard; a null doc_id is kept. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch

#: Groups that may be broadcast: those with at least 1/HOT of all rows.
HOT = 1000
CELL_ROWS = 200_000
SALTS = 16


def lpt(sizes: dict, n_shards: int) -> dict:
    """Item -> shard: largest first (ties: smaller key), each to the least loaded shard (ties: smaller number)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def deal_equal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets when every one goes to the least loaded shard. A few through the heap, many by the level up to which they fill the shards."""
    n = len(loads)
    got = [0] * n
    if count > 4 * n:
        below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731  # turns that start under the level
        low, high = min(loads), max(loads) + size * count
        while low < high:
            middle = (low + high + 1) // 2
            if sum(below(middle)) <= count:
                low = middle
            else:
                high = middle - 1
        got = below(low)
        count -= sum(got)
    heap = [(load + k * size, s) for s, (load, k) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count):
        load, shard = heap[0]
        got[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return got


def schedule(histogram: Iterable[tuple[int, int]], n_shards: int) -> pd.DataFrame:
    """For each (size, count) the ranks from which on a shard takes groups: group_size, starts, shards."""
    loads = [0] * n_shards
    rows = []
    for size, count in sorted(histogram, reverse=True):
        got = deal_equal(loads, size, count)
        first, starts, shards = 0, [], []
        for shard, k in enumerate(got):
            if k:
                starts.append(first)
                shards.append(shard)
                first += k
                loads[shard] += k * size
        rows.append((size, starts, shards))
    return pd.DataFrame(rows, columns=["group_size", "starts", "shards"])


def _numbered(rows: DataFrame, keys: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """rows with a number from 0 for each value of keys: cells are counted, and rows numbered inside them."""
    counts = rows.groupBy(*keys, cell).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    return rows.withColumn("_inside", inside).join(before.hint("shuffle_merge"), [*keys, cell]).withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_before", "_inside", cell)


def place_groups(groups: DataFrame, n_shards: int, scratch: Scratch) -> DataFrame:
    """groups (h1, h2, group_size, n_rows) with ``shard``."""
    histogram = groups.groupBy("group_size").agg(F.count("*").alias("n")).collect()  # a row for each size
    spark = groups.sparkSession
    plan = schedule([(r.group_size, r.n) for r in histogram], n_shards)
    schema = "group_size long, starts array<long>, shards array<int>"
    table = scratch.save(spark.createDataFrame(plan, schema) if len(plan) else spark.createDataFrame([], schema), "plan")
    cells = max(1, sum(r.n for r in histogram) // CELL_ROWS)
    ranked = _numbered(groups.withColumn("cell", F.pmod(F.xxhash64("h2", "h1"), F.lit(cells)).cast("int")), ["group_size"], "cell", ["h1", "h2"], "rank")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = ranked.withColumn("salt", F.pmod(F.col("h1"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["group_size", "salt"])  # tables that grow with the input are never broadcast
    shard = F.element_at("shards", F.size(F.filter("starts", lambda x: x <= F.col("rank"))))
    return met.select("h1", "h2", "n_rows", shard.alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    scratch = Scratch(docs.sparkSession, "sharding")
    raw = F.encode(F.col(text), "utf-8")
    slim = scratch.save(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.xxhash64(raw), F.lit(0)).alias("h1"), F.when(F.col(text).isNull(), F.lit(-1)).otherwise(F.conv(F.substring(F.md5(raw), 1, 15), 16, 10).cast("long")).alias("h2"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "slim",
    )
    groups = scratch.save(slim.groupBy("h1", "h2").agg(F.sum("size").alias("group_size"), F.count("*").alias("n_rows")), "groups")
    placed = scratch.save(place_groups(groups, n_shards, scratch), "placed")
    total = slim.count()
    hot = F.col("n_rows") * HOT >= F.lit(total)
    own = F.broadcast(placed.where(hot).select("h1", "h2", F.col("shard").alias("hot_shard")))
    marked = slim.join(own, ["h1", "h2"], "left")
    rest = marked.where("hot_shard is null").drop("hot_shard").join(placed.where(~hot).select("h1", "h2", "shard").hint("shuffle_merge"), ["h1", "h2"])
    columns = ["doc_id", "size", "text_crc32", "shard", "row"]
    put = scratch.save(marked.where("hot_shard is not null").withColumn("shard", F.col("hot_shard")).select(columns).union(rest.select(columns)), "put")
    # Rows with equal ids and texts are interchangeable; those without an id may be many, so their cells come from their place.
    key = F.xxhash64(F.coalesce("doc_id", F.col("row")), "text_crc32")
    cells = max(64, total // CELL_ROWS)
    out = _numbered(put.withColumn("cell", F.pmod(key, F.lit(cells)).cast("int")), ["shard"], "cell", ["doc_id", "text_crc32", "row"], "slot")
    scratch.drop("slim", "groups", "plan", "placed")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
