"""Suffix dedup: byte windows of ``length`` that start in an earlier document too, found by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``length`` bytes, most significant digit first, and a suffix leaves the sort as soon as its group holds one document:

1. First digit: the ``GRAM``-byte anchor of a window, the gram with the smallest hash in it. Equal windows have the same anchor at the same place, so all windows of an
   anchor are sorted as one and windows whose anchor occurs in one document only leave.
2. Second digit: the anchor's whole run (all bytes that windows with this anchor cover). A run seen in an earlier document is repeated in full; a run whose two
   half-extended anchors are in no other run leaves, since a window extends its anchor by half of the rest on one side at least.
3. Last digit: what remains, window by window, all ``length`` bytes. Equal groups are the repeated windows; every one in a later document is removed.

Digits are 64-bit fingerprints (40 bits where a digit only filters). Documents are packed in chunks of a few MB; a digit travels once for each chunk and bucket with its smallest document, so a passage found in a third of all
documents is sent once by each chunk and sorted with all others of its bucket. Each pass is a table in the shared folder.

Texts of more than ``PIECE_BYTES`` are cut into pieces that overlap by ``length`` - 1 bytes, so every window lies whole in the piece it starts in; pieces are rows of one doc_id and so don't remove each other's
bytes. What the pieces lose is put together for each such text at the end. Buckets hold what about ``BUCKET_BYTES`` of text send, whatever the size of the corpus.

Defined cases: null and empty texts have no bytes and no windows; texts shorter than ``length`` keep everything; rows of one doc_id don't remove each other's bytes; rows with a null doc_id are
left out; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _BYTE, _MULT, Scratch, _powers, mix64, record, shuffle_buckets

GRAM = 24
CHUNK_BYTES = 4_000_000
PIECE_BYTES = 2_000_000
BUCKET_BYTES = 64_000_000
_U = np.uint64


class Text:
    """Documents of a chunk as one array, with rolling fingerprints of any length."""

    def __init__(self, data: bytes, lengths: np.ndarray):
        self.bytes = np.frombuffer(data, np.uint8)
        self.lengths = lengths
        self.first = np.cumsum(lengths) - lengths
        self.sums: np.ndarray | None = None

    def prepare(self) -> None:
        n = len(self.bytes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * _powers("down", pow(_MULT, -1, 1 << 64), n), out=self.sums[1:])
        self.up = _powers("up", _MULT, n + 1)

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Fingerprints of bytes lo..hi-1, the same wherever they stand."""
        return mix64((self.sums[hi] - self.sums[lo]) * self.up[lo] + (hi - lo).astype(np.uint64))

    def hash_all(self, length: int) -> np.ndarray:
        n = len(self.bytes) - length + 1
        return mix64((self.sums[length:] - self.sums[:n]) * self.up[:n] + _U(length))


def runs(text: Text, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, first window, last window, document and fingerprint of the anchor gram."""
    none = np.zeros(0, np.int64)
    n = len(text.bytes)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    text.prepare()
    bits = _U(max(1, (n - 1).bit_length()))
    gram = text.hash_all(GRAM)
    key = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    span, low, width = length - GRAM + 1, key, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)  # of the window that starts at each place
    doc = np.repeat(np.arange(len(text.lengths)), np.maximum(text.lengths - length + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(text.lengths - length + 1, 0)) - np.maximum(text.lengths - length + 1, 0), np.maximum(text.lengths - length + 1, 0)) + text.first[doc]
    if not len(start):
        return none, none, none, none, np.zeros(0, np.uint64)
    a = anchor[start]
    new = np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(a)] - 1
    return a[at], start[at], start[last], doc[at], gram[a[at]]


def five(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def from_five(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return raw.reshape(-1).view("<u8")


_LOW40 = _U((1 << 40) - 1)


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (gram >> _U(40)) % _U(buckets)


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and where each begins."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def send_grams(text: Text, length: int, buckets: int) -> dict[int, bytes]:
    """Pass 1, from a chunk: its different anchor grams; each with a flag if two of its documents hold it."""
    _, _, _, doc, gram = runs(text, length)
    order = np.lexsort((doc, gram))
    g, d = gram[order], doc[order]
    new = np.r_[True, g[1:] != g[:-1]][: len(g)]
    at = np.flatnonzero(new)
    several = d[np.r_[at[1:], len(d)] - 1] != d[at] if len(at) else np.zeros(0, bool)
    g = g[new]
    order, cut = by_bucket(bucket_of(g, buckets), buckets)
    return {b: b"".join([len(part := order[cut[b] : cut[b + 1]]).to_bytes(4, "little"), five(g[part]).tobytes(), np.packbits(several[part]).tobytes()]) for b in range(buckets) if cut[b] < cut[b + 1]}


def match_grams(blobs: list[bytes]) -> list[bytes]:
    """Pass 1, in a bucket: for each chunk the bitmap of its grams that another document holds too."""
    keys, several, sizes = [], [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        keys.append(from_five(blob[4 : 4 + 5 * n]))
        several.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + 5 * n))[:n].astype(bool))
        sizes.append(n)
    key, many = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    again = many.copy()
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    return [np.packbits(again[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]


class Entries:
    """Pass 2, in a chunk: the different runs of repeated anchors, each with its smallest document, in a fixed order."""

    def __init__(self, text: Text, ids: np.ndarray, length: int, buckets: int, bitmaps: dict[int, bytes]):
        self.text, self.ids, self.length = text, ids, length
        anchor, lo, hi, doc, gram = runs(text, length)
        kept = np.zeros(len(gram), bool)
        if len(gram):
            grams, code = np.unique(gram, return_inverse=True)
            again = np.zeros(len(grams), bool)
            order, cut = by_bucket(bucket_of(grams, buckets), buckets)
            for b, bits in bitmaps.items():
                part = order[cut[b] : cut[b + 1]]
                again[part] = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(part)].astype(bool)
            kept = again[code]
        self.anchor, self.lo, self.hi, self.doc, gram = anchor[kept], lo[kept], hi[kept], doc[kept], gram[kept]
        n = len(self.anchor)
        if n:
            place = ((self.anchor - self.lo) * (length + 1) + self.hi - self.lo).astype(np.uint64)
            self.run = mix64(text.hash(self.lo, self.hi + length) + mix64(place))
        else:
            self.run = np.zeros(0, np.uint64)
        # Of equal runs in the chunk only the one of the smallest doc_id travels; later documents are repeated at once.
        order = np.lexsort((self.lo, self.ids[self.doc], self.run))
        r = self.run[order]
        new = np.r_[True, r[1:] != r[:-1]][:n]
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.of = np.zeros(n, np.int64)
        self.of[order] = group
        self.sent = order[at]
        self.full = np.zeros(n, bool)
        if n:
            self.full = self.ids[self.doc] > self.ids[self.doc[self.sent]][self.of]
        self.order, self.cut = by_bucket(bucket_of(gram[self.sent], buckets), buckets)
        self.buckets = buckets

    def send(self) -> dict[int, bytes]:
        s, half = self.sent, (self.length - GRAM) // 2
        ends = self.text.first + self.text.lengths
        left, right = self.anchor[s] - half, self.anchor[s] + GRAM + half
        has_left, has_right = left >= self.text.first[self.doc[s]], right <= ends[self.doc[s]]
        here = np.arange(len(s), dtype=np.uint64)
        alone = mix64(self.run[s] + here)
        l = np.where(has_left, self.text.hash(np.where(has_left, left, 0), np.where(has_left, self.anchor[s] + GRAM, 0)), alone) if len(s) else alone  # noqa: E741
        r = np.where(has_right, self.text.hash(np.where(has_right, self.anchor[s], 0), np.where(has_right, right, 0)), mix64(alone)) if len(s) else alone
        ids = self.ids[self.doc[s]]
        out = {}
        for b in range(self.buckets):
            p = self.order[self.cut[b] : self.cut[b + 1]]
            if len(p):
                out[b] = b"".join([len(p).to_bytes(4, "little"), self.run[s[p]].tobytes(), ids[p].tobytes(), five(l[p]).tobytes(), five(r[p]).tobytes()])
        return out

    def learn(self, status: dict[int, bytes]) -> np.ndarray:
        """Takes a status for each run sent (1: repeated in full, 2: its windows are sorted) and returns those of the second kind, with all places of each in its smallest document."""
        state = np.zeros(len(self.sent), np.uint8)
        for b, x in status.items():
            state[self.order[self.cut[b] : self.cut[b + 1]]] = np.frombuffer(x, np.uint8)
        if len(self.sent):
            self.full |= (state == 1)[self.of]
        return np.flatnonzero((state == 2)[self.of] & ~self.full) if len(self.sent) else self.sent


def match_runs(blobs: list[bytes]) -> list[bytes]:
    """Pass 2, in a bucket: a status for every run."""
    parts = []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        at = np.cumsum([4, 8 * n, 8 * n, 5 * n, 5 * n])
        parts.append((np.frombuffer(blob, np.uint64, n, at[0]), np.frombuffer(blob, np.int64, n, at[1]), from_five(blob[at[2] : at[3]]), from_five(blob[at[3] : at[4]])))
    run, ids, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, code = np.unique(run, return_inverse=True)
    least = np.full(code.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    full = ids > least[code]
    # Among the first documents of the different runs: does another document share an extended half?
    first = np.flatnonzero(~full)
    shared = np.zeros(len(first), bool)
    for side in (left[first], right[first]):
        order = np.lexsort((ids[first], side))
        s, d = side[order], ids[first][order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        stop = np.r_[start[1:], len(s)] - 1
        several = d[start] != d[stop]
        shared[order] |= np.repeat(several, stop - start + 1)
    status = full.astype(np.uint8)
    status[first[shared]] = 2
    ends = np.cumsum([len(p[0]) for p in parts])
    return [status[e - len(p[0]) : e].tobytes() for e, p in zip(ends, parts, strict=True)]


class Windows:
    """Pass 3, in a chunk: the different windows of the runs still open, in a fixed order."""

    def __init__(self, entries: Entries, open_: np.ndarray, buckets: int):
        e = entries
        n = e.hi[open_] - e.lo[open_] + 1
        self.start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(e.lo[open_], n)
        self.id = e.ids[np.repeat(e.doc[open_], n)]
        key = e.text.hash(self.start, self.start + e.length) if len(self.start) else np.zeros(0, np.uint64)
        order = np.lexsort((self.id, key))
        k = key[order]
        new = np.r_[True, k[1:] != k[:-1]][: len(k)]
        at = np.flatnonzero(new)
        self.of = np.zeros(len(k), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.sent = order[at]
        self.later = self.id > self.id[self.sent][self.of] if len(k) else np.zeros(0, bool)
        self.key = key[self.sent]
        self.order, self.cut = by_bucket(self.key % _U(buckets), buckets)
        self.buckets = buckets

    def send(self) -> dict[int, bytes]:
        out = {}
        ids = self.id[self.sent]
        for b in range(self.buckets):
            p = self.order[self.cut[b] : self.cut[b + 1]]
            if len(p):
                low = int(ids[p].min())
                wide = int(ids[p].max()) - low >= 1 << 32
                out[b] = b"".join([len(p).to_bytes(4, "little"), (8 if wide else 4).to_bytes(4, "little"), low.to_bytes(8, "little", signed=True), self.key[p].tobytes(), (ids[p] - low).astype("<u8" if wide else "<u4").tobytes()])
        return out

    def learn(self, bits: dict[int, bytes]) -> None:
        later = np.zeros(len(self.sent), bool)
        for b, x in bits.items():
            part = self.order[self.cut[b] : self.cut[b + 1]]
            later[part] = np.unpackbits(np.frombuffer(x, np.uint8))[: len(part)].astype(bool)
        if len(later):
            self.later |= later[self.of]


def match_windows(blobs: list[bytes]) -> list[bytes]:
    """Pass 3, in a bucket: which windows start in an earlier document."""
    keys, ids = [], []
    for blob in blobs:
        n, width = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
        keys.append(np.frombuffer(blob, np.uint64, n, 16))
        ids.append(np.frombuffer(blob, "<u8" if width == 8 else "<u4", n, 16 + 8 * n).astype(np.int64) + int.from_bytes(blob[8:16], "little", signed=True))
    key, id_ = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((id_, key))
    k, d = key[order], id_[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    later = np.zeros(len(k), bool)
    later[order] = d > np.repeat(d[start], np.diff(np.r_[start, len(k)]))
    ends = np.cumsum([len(x) for x in keys])
    return [np.packbits(later[e - len(x) : e]).tobytes() for e, x in zip(ends, keys, strict=True)]


def losses(text: Text, entries: Entries, windows: Windows, length: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    step = np.zeros(len(text.bytes) + 1, np.int32)
    np.add.at(step, entries.lo[entries.full], 1)
    np.add.at(step, entries.hi[entries.full] + length, -1)
    np.add.at(step, windows.start[windows.later], 1)
    np.add.at(step, windows.start[windows.later] + length, -1)
    return np.cumsum(step[:-1]) > 0


def cleaned(doc_id: int, data: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, int, bytes]:
    """doc_id, n_bytes, n_removed, n_spans, kept bytes of a document."""
    return doc_id, len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), data[~gone].tobytes()


# ---- Spark ------------------------------------------------------------------------------------------------------------


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, row of long texts -> their pieces."""
        for batch in batches:
            for doc_id, text, row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for k, lo in enumerate(range(0, len(text), PIECE_BYTES)):
                    yield record({"doc_id": pa.array([doc_id], pa.int64()), "data": pa.array([text[lo : lo + PIECE_BYTES + length - 1]], pa.binary()), "row": pa.array([row], pa.int64()), "piece": pa.array([k], pa.int32())})

    return run


def _pack(table: pa.Table) -> pa.Table:
    data = [t or b"" for t in table.column("data").to_pylist()]
    blob = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table({
        "chunk": table.column("chunk").slice(0, 1), "ids": blob(table.column("doc_id").to_numpy()), "lengths": blob(np.array([len(t) for t in data], np.int64)), "data": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(data))], pa.binary()),
        "rows": blob(table.column("row").to_numpy()), "pieces": blob(table.column("piece").to_numpy()),
    })


def _unpack(ids: bytes, lengths: bytes, data: bytes) -> tuple[np.ndarray, Text]:
    return np.frombuffer(ids, np.int64), Text(zstandard.ZstdDecompressor().decompress(data), np.frombuffer(lengths, np.int64))


def _put_together(output, length: int):
    def run(table: pa.Table) -> pa.Table:
        """The pieces of one text -> what ``output`` makes of it."""
        order = np.argsort(table.column("piece").to_numpy())
        data, gone = table.column("data").to_pylist(), table.column("gone").to_pylist()
        n = PIECE_BYTES * (len(order) - 1) + len(data[order[-1]])
        whole, lost = np.zeros(n, np.uint8), np.zeros(n, bool)
        for k, i in enumerate(order):
            lo = k * PIECE_BYTES
            whole[lo : lo + len(data[i])] = np.frombuffer(data[i], np.uint8)
            lost[lo : lo + len(data[i])] |= np.unpackbits(np.frombuffer(gone[i], np.uint8))[: len(data[i])].astype(bool)
        return pa.Table.from_batches([output([cleaned(table.column("doc_id")[0].as_py(), whole, lost)])])

    return run


def _match(match):
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array(match(table.column("blob").to_pylist()), pa.binary())})

    return run


def _answers(buckets: bytes | list, blobs: list) -> dict[int, bytes]:
    return dict(zip(buckets or [], blobs or [], strict=True))


class _Pass:
    """One look at every chunk, with the answers to what it sent before; ``send`` is what it sends now."""

    def __init__(self, length: int, buckets: int, step: int, output=None):
        self.length, self.buckets, self.step, self.output = length, buckets, step, output

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk, (ids, text) = row[0], _unpack(*row[1:4])
                if self.step == 1:
                    yield from self.rows(chunk, send_grams(text, self.length, self.buckets))
                    continue
                entries = Entries(text, ids, self.length, self.buckets, _answers(row[6], row[7]))
                if self.step == 2:
                    yield from self.rows(chunk, entries.send())
                    continue
                windows = Windows(entries, entries.learn(_answers(row[8], row[9])), self.buckets)
                if self.step == 3:
                    yield from self.rows(chunk, windows.send())
                    continue
                windows.learn(_answers(row[10], row[11]))
                yield from self.results(text, ids, losses(text, entries, windows, self.length), np.frombuffer(row[4], np.int64), np.frombuffer(row[5], np.int32))

    def results(self, text: Text, ids: np.ndarray, gone: np.ndarray, rows: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What ``output`` makes of whole texts, and the pieces of long ones with their lost bytes, side by side."""
        part = lambda i: slice(text.first[i], text.first[i] + text.lengths[i])
        whole, cut = np.flatnonzero(pieces < 0), np.flatnonzero(pieces >= 0)
        if len(whole):
            done = self.output([cleaned(int(ids[i]), text.bytes[part(i)], gone[part(i)]) for i in whole])
            yield record({name: done.column(name) for name in done.schema.names} | {"row": pa.nulls(len(whole), pa.int64()), "piece": pa.nulls(len(whole), pa.int32()), "data": pa.nulls(len(whole), pa.binary()), "gone": pa.nulls(len(whole), pa.binary())})
        if len(cut):
            like = self.output([]).schema
            yield record({f.name: pa.array(ids[cut]) if f.name == "doc_id" else pa.nulls(len(cut), f.type) for f in like} | {"row": pa.array(rows[cut]), "piece": pa.array(pieces[cut]), "data": pa.array([text.bytes[part(i)].tobytes() for i in cut], pa.binary()), "gone": pa.array([np.packbits(gone[part(i)]).tobytes() for i in cut], pa.binary())})

    @staticmethod
    def rows(chunk: int, blobs: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        keys = sorted(blobs)
        for lo in range(0, len(keys), 32):
            part = keys[lo : lo + 32]
            yield record({"chunk": pa.array([chunk] * len(part), pa.int64()), "bucket": pa.array(part, pa.int32()), "blob": pa.array([blobs[k] for k in part], pa.binary())})


def digests(rows) -> pa.RecordBatch:
    rows = list(rows)
    ints = {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("doc_id", "n_bytes", "n_removed", "n_spans"))}
    return record(ints | {"kept_sha256": pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string())})


def kept_texts(rows) -> pa.RecordBatch:
    rows = list(rows)
    return record({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "kept": pa.array([r[4] for r in rows], pa.binary())})


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 50, output=digests, schema: str = DIGESTS) -> DataFrame:
    """What ``output`` makes of every document (doc_id, text): by default the digests, with ``kept_texts`` and "doc_id long, kept binary" the remaining bytes."""
    if length < GRAM + 2:
        raise ValueError(f"length must be at least {GRAM + 2}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    size = F.octet_length("text")
    total = docs.agg(F.sum(size)).first()[0] or 0
    chunks = max(8, -(-total // CHUNK_BYTES))
    buckets = max(shuffle_buckets(spark), total // BUCKET_BYTES)
    short = docs.where(text_is_short := F.coalesce(size, F.lit(0)) <= PIECE_BYTES).select("doc_id", F.col("text").cast("binary").alias("data"), "row", F.lit(-1).alias("piece"))
    pieces = short.union(docs.where(~text_is_short).mapInArrow(_cut(length), "doc_id long, data binary, row long, piece int"))
    dealt = pieces.withColumn("chunk", F.pmod(F.when(F.col("piece") < 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("row", "piece")), F.lit(chunks)))
    table = scratch.save(dealt.groupBy("chunk").applyInArrow(_pack, "chunk long, ids binary, lengths binary, data binary, rows binary, pieces binary"), "chunks")
    joined = table
    for step, match in ((1, match_grams), (2, match_runs), (3, match_windows)):
        sent = joined.mapInArrow(_Pass(length, buckets, step), "chunk long, bucket int, blob binary")
        answers = sent.groupBy("bucket").applyInArrow(_match(match), "chunk long, bucket int, answer binary")
        listed = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("all")).select("chunk", F.col("all.bucket").alias(f"b{step}"), F.col("all.answer").alias(f"a{step}"))
        joined = joined.join(scratch.save(listed, f"answers{step}"), "chunk", "left")
    results = scratch.save(joined.mapInArrow(_Pass(length, buckets, 4, output), f"{schema}, row long, piece int, data binary, gone binary"), "result")
    scratch.drop("chunks", "answers1", "answers2", "answers3")
    columns = [c for c in results.columns if c not in ("row", "piece", "data", "gone")]
    joined_up = results.where("piece is not null").groupBy("row").applyInArrow(_put_together(output, length), schema)
    return results.where("piece is null").select(columns).union(joined_up.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
