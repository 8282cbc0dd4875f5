"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of at least num / den, exactly, as components.

The Jaccard distance is a metric. A pivot join over the whole corpus would be exact but useless: nearly all documents are at distance 1 from every pivot, so the windows would
copy everything everywhere. So the first pivot is the empty set, under the distance |A xor B|: its regions are rings of set sizes, and the window copies a document into the next
smaller ring if it can have a partner there. Inside a ring all shingles have one order, rarest first: a linked set shares at least num / den of its shingles, so two linked sets have one in common among their
1 - num / den rarest ones (and one more). Documents that share such a shingle in a ring are chained into candidate regions. Passages that many documents hold are common, so they chain only documents that hold little else.
The order comes from a table of counts by hash over all documents; any order gives the same links, a good one gives small regions. A shingle's key travels once for each chunk of documents, so a group of copies is never dealt to one task.

Inside a region pivots create Voronoi cells by Jaccard distance; a document joins every cell whose pivot is at most 2 eps farther than its nearest one, cells join recursively, pairs outside any pivot's eps window are skipped,
and so are pairs already connected. Regions too large for a task first lose the documents that share too little with all others together; then one pivot is compared by all tasks, and what is left is joined in tiles. Copies (equal sets) are represented by their smallest id.

Shingles, parts and sets are told apart by 64-bit hashes (two of them for equal sets), not by their words.

Defined cases: texts null, empty or without words have no shingles and link with nothing; fewer words than n: the whole sequence is the only shingle; rows of one doc_id are
one node and a row of the result each; rows with a null doc_id are left out; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, components, join_texts, label_min, mix64, record, shingles, shuffle_buckets, text_batches, words

#: Shingles of a region that one task joins; larger regions are cut.
REGION_SHINGLES = 8_000_000
TILE_SHINGLES = 3_000_000
#: Signatures a task holds before it passes them on.
HELD = 1_500_000
#: Bytes of text whose signatures meet in one bucket.
BUCKET_BYTES = 8_000_000
_SEED = np.uint64(0xD6E8FEB86659FD93)


def rings(num: int, den: int, largest: int) -> np.ndarray:
    """Upper ends of the size rings: a set's partners lie in its own ring or the one below or above."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * den // num))
    return np.array(ends, np.int64)


def signatures(hs: np.ndarray, os: np.ndarray, n: np.ndarray, num: int, den: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) of the rarest shingles of all sets; hs, os: shingles sorted by owner; n: set sizes; levels: how common shingles are, by the first bits of their hash.

    A set has two nodes: 2 * owner in its own ring, and 1 more in the ring below. Chains of equal shingles thus stay inside a ring.
    """
    ends = rings(num, den, int(n.max()) if len(n) else 1)
    ring = np.searchsorted(ends, n)
    common = levels[(hs >> np.uint64(64 - (len(levels) - 1).bit_length())).astype(np.int64)]
    order = np.argsort(os << 8 | common, kind="stable")  # of equal level the smaller hash first
    rank = np.arange(len(hs)) - (np.cumsum(n) - n)[os]
    few = order[rank < (n + (-n * num // den) + 1)[os]]  # rank and os are the same before and after the sort by owner
    hs, os = hs[few], os[few]
    out_s, out_o = [], []
    for down in (0, 1):
        c = ring - down
        use = c >= 0
        if down:
            use &= -(-n * num // den) <= ends[np.maximum(c, 0)]
        mine = use[os]
        out_s.append(mix64(hs[mine] + mix64(c[os[mine]].astype(np.uint64) + _SEED)))
        out_o.append(2 * os[mine] + down)
    return np.concatenate(out_s), np.concatenate(out_o)


def table_bits(total: int) -> int:
    """Bits of the table of counts: a place for each 64 bytes of text, between 2^16 and 2^23 places."""
    return min(23, max(16, (total // 64).bit_length()))


#: Parts in which tables of counts are added up, and tasks whose tables one task adds.
COUNT_PARTS, COUNT_TASKS = 16, 64


def _count(words_n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of a task have a shingle, by the first bits of its hash."""
        counts, seen = np.zeros(1 << bits, np.uint32), False
        for _, texts in text_batches(batches):
            h, owner, _, _ = words(*join_texts(texts))
            hs, _ = shingles(h, owner, len(texts), words_n)
            counts += np.bincount((hs >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            seen = seen or len(hs) > 0
        if seen:
            parts = counts.reshape(COUNT_PARTS, -1).astype("<u8" if counts.max() > 65535 else "<u2")
            task = TaskContext.get().partitionId() // COUNT_TASKS
            yield record({"part": pa.array(range(COUNT_PARTS), pa.int32()), "task": pa.array([task] * COUNT_PARTS, pa.int32()), "width": pa.array([parts.itemsize] * COUNT_PARTS, pa.int32()), "counts": pa.array([zstandard.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = 0
    for blob, width in zip(table.column("counts").to_pylist(), table.column("width").to_pylist(), strict=True):
        total = total + np.frombuffer(zstandard.decompress(blob), f"<u{width}").astype(np.uint64)
    row = {"part": table.column("part")[0].as_py(), "task": 0, "width": 8, "counts": zstandard.compress(total.tobytes(), 1)}
    return pa.Table.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("task", pa.int32()), ("width", pa.int32()), ("counts", pa.binary())]))


def commonness(docs: DataFrame, words_n: int, total: int) -> np.ndarray:
    """For each value of the first bits of a shingle's hash how many documents have such a shingle, on a logarithmic scale from 0 to 255. At most 8 MB, whatever the corpus."""
    schema = "part int, task int, width int, counts binary"
    bits = table_bits(total)
    summed = docs.select("doc_id", "text").mapInArrow(_count(words_n, bits), schema).groupBy("part", "task").applyInArrow(_add_counts, schema).groupBy("part").applyInArrow(_add_counts, schema)
    out = np.zeros((COUNT_PARTS, (1 << bits) // COUNT_PARTS), np.uint8)
    for r in summed.collect():  # COUNT_PARTS rows
        counts = np.frombuffer(zstandard.decompress(r.counts), "<u8")
        out[r.part] = np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8)
    return out.reshape(-1)


def first_of_each(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their smallest id, and edges from every other id of a key to it."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    low = ids[new][np.cumsum(new) - 1]
    other = low != ids
    pairs = np.unique(np.stack([ids[other], low[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return key[new], ids[new], pairs[:, 0], pairs[:, 1]


_PASS1 = "kind int, doc_id long, n long, s1 long, s2 long, bucket int, keys binary, ids binary, other long"


def _pass1_row(kind: int, rows: int, **columns) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "bucket": pa.int32(), "keys": pa.binary(), "ids": pa.binary(), "other": pa.int64()}
    return record({k: pa.array(columns[k], t) if k in columns else pa.array([kind] * rows, t) if k == "kind" else pa.nulls(rows, t) for k, t in types.items()})


def _first_pass(words_n: int, num: int, den: int, buckets: int, levels: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a row for each document; 1: packed signatures of a bucket; 2: edges found here."""
        held: list = []

        def flush():
            key, ids, a, b = first_of_each(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held.clear()
            ids_, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = label_min(len(ids_), codes[: len(a)], codes[len(a) :])
            own = np.flatnonzero(root != np.arange(len(ids_)))
            if len(own):
                yield _pass1_row(2, len(own), doc_id=ids_[own], other=ids_[root[own]])
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            for lo in range(0, len(some), 16):
                part = some[lo : lo + 16]
                yield _pass1_row(1, len(part), bucket=part, keys=[key[order[cut[k] : cut[k + 1]]].tobytes() for k in part], ids=[ids[order[cut[k] : cut[k + 1]]].tobytes() for k in part])

        for doc_ids, texts in text_batches(batches):
            h, owner, _, _ = words(*join_texts(texts))
            hs, os = shingles(h, owner, len(texts), words_n)
            n = np.bincount(os, minlength=len(texts))
            s1, s2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            np.add.at(s1, os, mix64(hs + np.uint64(1)))
            np.add.at(s2, os, mix64(hs ^ np.uint64(0xABCDEF)))
            yield _pass1_row(0, len(texts), doc_id=doc_ids, n=n, s1=s1.view(np.int64), s2=s2.view(np.int64))
            sig, so = signatures(hs, os, n, num, den, levels.value)
            held.append((sig, 2 * np.array(doc_ids, np.int64)[so >> 1] + (so & 1)))
            if sum(len(x) for x, _ in held) >= HELD:
                yield from flush()
        if held and sum(len(x) for x, _ in held):
            yield from flush()

    return run


def _stars(table: pa.Table) -> pa.Table:
    """Edges between the documents of each signature in a bucket."""
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
    _, _, a, b = first_of_each(join("keys", np.uint64), join("ids", np.int64))
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = label_min(len(ids), codes[: len(a)], codes[len(a) :])
    own = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[root[own]], pa.int64())})


# ---- joining a region -----------------------------------------------------------------------------------------------


class Region:
    """Sets of one region; ``labels`` says which are connected so far."""

    LEAF, PIVOTS = 48, 8

    def __init__(self, sets: list[np.ndarray], num: int, den: int, free: np.ndarray | None = None):
        self.num, self.den = num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.free = np.ones(len(sets), bool) if free is None else free
        self.labels = np.arange(len(sets))
        self.eps = (den - num) / den + 1e-9

    def shared(self, v: int, items: np.ndarray) -> np.ndarray:
        """Shingles that v shares with each of the items."""
        n = self.n[items]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[items], n)
        own, x = self.flat[self.first[v] : self.first[v] + self.n[v]], self.flat[at]
        where = np.searchsorted(own, x)
        where[where == len(own)] = 0
        return np.bincount(np.repeat(np.arange(len(items)), n), own[where] == x, len(items)).astype(np.int64)

    def compare(self, v: int, items: np.ndarray) -> np.ndarray:
        """Distances from v; links what is near enough."""
        both = self.shared(v, items)
        union = self.n[v] + self.n[items] - both
        near = items[self.den * both >= self.num * union]
        if len(near):
            old = np.unique(self.labels[np.append(near, v)])
            self.labels[np.isin(self.labels, old)] = old[0]
        return 1 - both / union

    def pivots(self, items: np.ndarray) -> np.ndarray:
        """The item that holds the most widely shared shingles, and others spread over the order of that measure."""
        n = self.n[items]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[items], n)
        _, code, count = np.unique(self.flat[at], return_inverse=True, return_counts=True)
        shared = np.bincount(np.repeat(np.arange(len(items)), n), count[code], len(items)) / n
        order = items[np.argsort(-shared, kind="stable")]
        return order[np.unique(np.linspace(0, len(order) - 1, self.PIVOTS).astype(int))]

    def scan(self, items: np.ndarray, distance: np.ndarray | None = None) -> None:
        """Every pair of items with a free one, but for those connected or outside a window."""
        done = np.zeros(len(items), bool)
        for k in np.flatnonzero(self.free[items]):
            v = items[k]
            done[k] = True
            todo = ~done & (self.labels[items] != self.labels[v])
            todo &= (self.den * np.minimum(self.n[items], self.n[v]) >= self.num * np.maximum(self.n[items], self.n[v]))
            if distance is not None:
                todo &= (np.abs(distance - distance[:, k : k + 1]) <= self.eps).all(0)
            if todo.any():
                self.compare(v, items[todo])

    def partners(self) -> np.ndarray:
        """Items that can have one: a linked set shares num / den of its shingles with its partner, so what shares less with all others together leaves, again and again."""
        alive = np.ones(len(self.n), bool)
        while alive.any():
            own = np.sort(self.flat[np.repeat(alive, self.n)])
            common = np.unique(own[1:][own[1:] == own[:-1]])
            del own
            keep = alive.copy()
            for i in np.flatnonzero(alive):  # one item at a time: a region may fill most of a task's memory
                mine = self.flat[self.first[i] : self.first[i] + self.n[i]]
                where = np.searchsorted(common, mine)
                where[where == len(common)] = 0
                keep[i] = len(common) > 0 and self.den * np.count_nonzero(common[where] == mine) >= self.num * self.n[i]
            if (keep == alive).all():
                break
            alive = keep
        return np.flatnonzero(alive)

    def join(self) -> np.ndarray:
        stack = [self.partners()]
        while stack:
            items = stack.pop()
            if len(items) < 2 or (self.labels[items] == self.labels[items[0]]).all() or not self.free[items].any():
                continue
            if len(items) <= self.LEAF:
                self.scan(items)
                continue
            pivots = self.pivots(items)
            distance = np.stack([self.compare(p, items) for p in pivots])
            nearest = distance.min(0)
            cell = distance.argmin(0)
            windows = [items[distance[j] <= nearest + 2 * self.eps] for j in range(len(pivots)) if (cell == j).any()]
            if sum(len(w) for w in windows) > 1.5 * len(items):  # more copying than cutting: cells would multiply from level to level
                self.scan(items, distance)
            else:
                stack += windows
        return self.labels


def _link_regions(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        region, doc_id, free = (table.column(c).to_numpy() for c in ("region", "doc_id", "free"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        order = np.argsort(region, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(region[order]) != 0, True])
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = order[lo:hi]
            labels = Region([sets[i] for i in part], num, den, free[part].astype(bool)).join()
            other = labels != np.arange(len(part))
            a.append(doc_id[part[other]])
            b.append(doc_id[part[labels[other]]])
        cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    return run


def _sets_of(texts: list[bytes], words_n: int, limit: int = 4 << 20) -> list[np.ndarray]:
    """Shingle sets of texts, ``limit`` bytes or one longer text at a time."""
    sets, part, size = [], [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= limit or k == len(texts) - 1:
            h, owner, _, _ = words(*join_texts(part))
            hs, os = shingles(h, owner, len(part), words_n)
            cut = np.searchsorted(os, np.arange(len(part) + 1))
            sets += [hs[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            part, size = [], 0
    return sets


def _link_texts(words_n: int, num: int, den: int):
    join = _link_regions(num, den)

    def run(table: pa.Table) -> pa.Table:
        """region, doc_id, text -> edges."""
        sets = _sets_of([t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()], words_n)
        full = pa.array([len(x) > 0 for x in sets], pa.bool_())  # another row of a doc_id may have no words
        return join(pa.table({"region": table.column("region"), "doc_id": table.column("doc_id"), "free": full, "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}).filter(full))

    return run


def _by_shingle(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """region, doc_id, shingles -> the shingles packed by region and bucket, with their documents."""
        for batch in batches:
            regions, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            for region in np.unique(regions):
                mine = np.flatnonzero(regions == region)
                key = np.concatenate([sets[i] for i in mine])
                owner = np.repeat(ids[mine], [len(sets[i]) for i in mine])
                bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                yield record({"region": pa.array([region] * len(some), pa.int64()), "bucket": pa.array(some, pa.int32()), "keys": pa.array([key[order[cut[k] : cut[k + 1]]].tobytes() for k in some], pa.binary()), "ids": pa.array([owner[order[cut[k] : cut[k + 1]]].tobytes() for k in some], pa.binary())})

    return run


def _shared(table: pa.Table) -> pa.Table:
    """How many of each document's shingles in this bucket another document of the region has too."""
    join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
    _, code, count = np.unique(join("keys", np.uint64), return_inverse=True, return_counts=True)
    ids, both = np.unique(join("ids", np.int64)[count[code] > 1], return_counts=True)
    return pa.table({"region": pa.array([table.column("region")[0].as_py()] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "both": pa.array(both, pa.int64())})


def _peel(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Documents of large regions that can have a partner: one shares num / den of its shingles with it, so at least as many with all others together."""
    buckets = max(8, -(-(sets.agg(F.sum("n")).first()[0] or 0) // 1_000_000))
    packed = sets.select("region", "doc_id", "shingles").mapInArrow(_by_shingle(buckets), "region long, bucket int, keys binary, ids binary")
    shared = packed.groupBy("region", "bucket").applyInArrow(_shared, "region long, doc_id long, both long")
    shared = shared.groupBy("region", "doc_id").agg(F.sum("both").alias("both"))
    return sets.join(shared, ["region", "doc_id"]).where(F.col("both") * den >= F.col("n") * num).drop("both")


def _medoid(table: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    best = int(Region(sets, 1, 1).pivots(np.arange(len(sets)))[0])
    return table.select(["region", "doc_id", "shingles"]).slice(best, 1)


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """region, doc_id, n, shingles, pivot, pivot_shingles -> shared shingles and the pivot's size."""
    for batch in batches:
        both, size = [], []
        for own, pivot in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
            x, p = np.frombuffer(own, np.uint64), np.frombuffer(pivot, np.uint64)
            both.append(int(np.isin(x, p, assume_unique=True).sum()))
            size.append(len(p))
        yield record({"region": batch.column(0), "doc_id": batch.column(1), "n": batch.column(2), "pivot": batch.column(4), "both": pa.array(both, pa.int64()), "pivot_n": pa.array(size, pa.int64())})


def _large_regions(sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges of regions beyond a task's size: one pivot for all, then tiles of what it leaves open."""
    few = sets.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("doc_id")))).where("rank <= 128").drop("rank")
    pivots = scratch.save(few.select("region", "doc_id", "shingles").groupBy("region").applyInArrow(_medoid, "region long, doc_id long, shingles binary"), "pivots")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    spread = pivots.select("region", F.col("doc_id").alias("pivot"), F.col("shingles").alias("pivot_shingles"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    met = sets.withColumn("salt", salt).join(spread, ["region", "salt"]).select("region", "doc_id", "n", "shingles", "pivot", "pivot_shingles").mapInArrow(_to_pivot, "region long, doc_id long, n long, pivot long, both long, pivot_n long")
    union = F.col("n") + F.col("pivot_n") - F.col("both")
    met = scratch.save(met.withColumn("linked", F.col("both") * den >= union * num).withColumn("d", 1 - F.col("both") / union), "met")
    eps = (den - num) / den + 1e-9
    open_ = met.where("not linked").groupBy("region").agg(F.min("d").alias("least"))
    left = met.join(open_, "region").where(~F.col("linked") | (F.col("d") >= F.col("least") - F.lit(eps))).select("region", "doc_id", (~F.col("linked")).alias("free"), "n")
    blocks = left.groupBy("region").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("blocks"))
    left = left.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    pairs = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    tiles = pairs.select("region", "doc_id", "free", "lo", "hi").join(sets.select("region", "doc_id", "shingles"), ["region", "doc_id"])
    edges = tiles.groupBy("region", "lo", "hi").applyInArrow(_link_regions(num, den), "a long, b long")
    return edges.union(met.where("linked and doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))


def _to_sets(words_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, region -> sets."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sets = _sets_of([t or b"" for t in batch.column(1).slice(lo, 1024).cast(pa.binary()).to_pylist()], words_n)
                rest = {name: batch.column(k).slice(lo, 1024) for k, name in ((0, "doc_id"), (2, "region"))}
                yield record(rest | {"n": pa.array([len(x) for x in sets], pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def jaccard_components(docs: DataFrame, words_n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    # Two near copies meet in every bucket that holds one of their common keys, so with few buckets the edges of a document would grow with their number.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_buckets(spark, least=256), total // BUCKET_BYTES)
    first = scratch.save(docs.mapInArrow(_first_pass(words_n, num, den, buckets, spark.sparkContext.broadcast(commonness(docs, words_n, total))), _PASS1), "first", "kind")
    stars = first.where("kind = 1").select("bucket", "keys", "ids").groupBy("bucket").applyInArrow(_stars, "a long, b long")
    near = scratch.save(stars.union(first.where("kind = 2").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))), "near")
    rows = scratch.save(first.where("kind = 0").select("doc_id", "n", "s1", "s2"), "rows")
    scratch.drop("first")  # its signatures are the largest table here
    chained = components(near, scratch, "near")
    reps = scratch.save(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    copies = rows.where("n > 0").join(reps, ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    nodes = reps.select(F.col("rep").alias("doc_id"), "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("down"))
    members = nodes.join(chained, F.col("doc_id") * 2 + F.col("down") == chained.id).select("doc_id", "n", F.col("component").alias("region"))
    sizes = members.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).where("docs > 1").select("region", (F.col("total") > REGION_SHINGLES).alias("large"))
    members = scratch.save(members.join(sizes, "region").groupBy("doc_id", "region", "large").agg(F.max("n").alias("n")), "members")
    # members grow with the corpus, so they are never broadcast: the plan is the same at every size
    near_texts = scratch.save(docs.join(members.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "region", "large"), "texts")
    # texts are smaller than their shingles, so they travel to the tasks that join a region
    small = near_texts.where("not large").select("region", "doc_id", "text")
    bundles = max(8, (members.where("not large").agg(F.sum("n")).first()[0] or 0) // 500_000)
    linked = small.withColumn("bundle", F.pmod(F.xxhash64("region"), F.lit(bundles))).groupBy("bundle").applyInArrow(_link_texts(words_n, num, den), "a long, b long")
    if not members.where("large").isEmpty():
        sets = scratch.save(near_texts.where("large").select("doc_id", "text", "region").mapInArrow(_to_sets(words_n), "doc_id long, region long, n long, shingles binary").where("n > 0"), "sets")
        sets = scratch.save(_peel(sets, num, den), "peeled")
        linked = linked.union(_large_regions(sets.select("region", "doc_id", "n", "shingles"), num, den, scratch))
    found = components(scratch.save(linked.union(copies), "links"), scratch, "out")
    out = scratch.save(rows.join(found, rows.doc_id == found.id, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "result")
    scratch.drop("rows", "texts", "sets", "peeled", "near", "links", "members", "reps", "pivots", "met")
    return out


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns, whose doc_id is the smallest of its component; rows with a null doc_id stay."""
    out = jaccard_components(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out.hint("shuffle_merge"), "doc_id", "left_anti").select(*docs.columns)  # what is dropped grows with the corpus, so it is never broadcast


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words_n=4, num=85, den=100)
