"""Token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those
ids that have one, and so on. A continuation bitmap at each level says which entries go on; a rank directory (one absolute
count every ``RANK_STEP`` bits) turns a place in one level into the place in the next. Any token is read by touching one chunk
and one rank a level, without decoding a block.

A file holds segments, each a binary value in a Parquet row beside its addresses: doc ids, lengths, and the number of ids before it.
Segments are in ascending doc_id order and hold ``SEGMENT_TOKENS`` ids or one longer document.

Layout of a segment, little endian: ``DAC1``, u32 ids, u32 levels, then for each level u32 entries, the chunks (one byte each), the
bitmap (ceil(entries / 8) bytes, lowest bit first) and the directory (ceil(entries / RANK_STEP) u32).

Defined cases: null and empty texts are the end id alone; a text may hold any marker literally (special strings are encoded as the tokenizer's
defaults have it); equal doc_ids follow each other in the order of their ids' bytes; rows with a null doc_id come first; an empty table gives no rows and no segments; other columns aren't read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, join_texts, record, row_batches, slice_hashes

CHUNK_BITS = 8
RANK_STEP = 512
SEGMENT_TOKENS = 1 << 18
END_ID = 0
#: Slots for pieces of texts with their ids in each Python worker (a power of two), and the bytes of a piece and the ids of all pieces that are kept.
CACHE_SLOTS = 1 << 20
CACHE_PIECE = 256
CACHE_IDS = 1 << 23
#: Bytes of text that are encoded in one go, or one longer text.
BATCH_BYTES = 1 << 20


def dac_encode(ids: np.ndarray) -> bytes:
    rest = ids.astype(np.uint32)
    out, levels = [], 0
    while True:
        more = rest >> np.uint32(CHUNK_BITS)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.zeros(len(rest) // RANK_STEP + 1, np.uint32)
        if len(rest):
            sums = np.add.reduceat(goes_on.astype(np.uint32), np.arange(0, len(rest), RANK_STEP))
            ones = np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u4")
        else:
            ones = np.zeros(0, "<u4")
        out += [struct.pack("<I", len(rest)), (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ones.tobytes()]
        levels += 1
        rest = more[goes_on]
        if not len(rest):
            break
    return b"DAC1" + struct.pack("<II", len(ids), levels) + b"".join(out)


class DacReader:
    """Reads single ids or ranges from an encoded segment."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        self.n, levels = struct.unpack_from("<II", blob, 4)
        self.levels, at = [], 12
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", blob, at)
            chunks = np.frombuffer(blob, np.uint8, n, at + 4)
            bits = np.frombuffer(blob, np.uint8, (n + 7) // 8, at + 4 + n)
            ranks = np.frombuffer(blob, "<u4", -(-n // RANK_STEP), at + 4 + n + len(bits))
            at += 4 + n + len(bits) + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def get(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            tail = np.unpackbits(bits[block * RANK_STEP // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_STEP]
            i = int(ranks[block]) + int(tail.sum())
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The ids at places lo to hi - 1."""
        value = np.zeros(hi - lo, np.uint32)
        at = np.arange(hi - lo)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(at):
                break
            value[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            start = lo // 8 * 8
            goes_on = np.unpackbits(bits[start // 8 : -(-hi // 8)], bitorder="little")[lo - start : hi - start].astype(bool)
            block = lo // RANK_STEP
            before = np.unpackbits(bits[block * RANK_STEP // 8 : -(-lo // 8)], bitorder="little")[: lo - block * RANK_STEP].sum() if lo > block * RANK_STEP else 0
            lo = int(ranks[block] if block < len(ranks) else 0) + int(before)
            at = at[goes_on]
            hi = lo + len(at)
        return value


#: The byte-level pre-tokenizer's pattern (a fixed, published value): 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
_LETTER, _DIGIT, _OTHER, _BLANK, _END = range(5)
_CLASS = np.array([_LETTER if chr(i).isalpha() else _DIGIT if chr(i).isnumeric() else _BLANK if i in (*range(9, 14), 32, 0x85, 0xA0) else _OTHER for i in range(256)], np.uint8)


def pieces(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces begin in Latin-1 texts, each with one more byte at ``ends``, itself a piece."""
    kind = _CLASS[buf]
    kind[ends] = _END
    begins = np.ones(len(buf), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[ends] = True
    begins[ends[:-1] + 1] = True
    # the last blank before a word is a piece's beginning; a space draws the word to it
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] < _BLANK))
    begins[last] = True
    begins[last + 1] = buf[last] != 32
    quotes = np.flatnonzero((buf == 39) & begins)
    quotes = quotes[kind[quotes + 1] == _LETTER]  # a text's last byte is its end, so there is one more
    one, two = buf[quotes + 1], buf[np.minimum(quotes + 2, len(buf) - 1)]
    short = np.isin(one, (115, 116, 109, 100))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    begins[quotes[short | long] + 1] = False
    begins[quotes[short] + 2] = True
    begins[quotes[long] + 3] = True
    return np.flatnonzero(begins)


def _splits_bytes(path: str) -> bool:
    """Whether a tokenizer is byte-level BPE without anything before or beside the splitter that ``pieces`` follows."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain and model.get("type") == "BPE" and not told.get("normalizer") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))


class WordEncoder:
    """Encodes texts through the tokenizer piece by piece, each different piece once while it stays in a bounded table.

    Byte-level BPE never merges across the pieces of its pre-tokenizer, so the pieces of a text are encoded alone as they are together. Texts with signs beyond Latin-1 or with a special string are encoded whole, and so are all texts of a tokenizer of another kind.
    Pieces are told apart by a 64-bit hash and their length; the table has a slot for each value of the hash's low bits, and the piece seen first keeps it.
    """

    def __init__(self, path: str, slots: int = CACHE_SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = _splits_bytes(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocab.values())] = [len(t) for t in vocab]  # byte-level tokens have one sign a byte
        self.mask = np.uint64(slots - 1)
        self.keys = np.arange(slots, dtype=np.uint64) ^ np.uint64(1)  # no key of that slot, so the slot is free
        self.free = np.ones(slots, bool)
        self.at, self.count, self.width = np.zeros(slots, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.held = np.zeros(1 << 16, self.kind), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for lo in range(0, len(texts), 1024) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. Pieces that begin with a space are split again as they were when they stand in a row, so many are encoded in one go and cut where their bytes end."""
        found: list = [None] * len(words)
        led = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and _CLASS[ord(w[1])] != _BLANK]
        for lo in range(0, len(led), 1024):
            part = led[lo : lo + 1024]
            ids = self.encode(["".join([words[i] for i in part])])[0]
            ends, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum([len(words[i].encode()) for i in part])
            cut = np.searchsorted(ends, wanted, "right")
            if len(ids) and cut[0] and (ends[cut - 1] == wanted).all():
                for i, a, b in zip(part, [0, *cut.tolist()], cut.tolist()):
                    found[i] = ids[a:b]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self.encode([words[i] for i in rest]), strict=True):
            found[i] = ids
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def look_up(self, buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` of the pieces from ``first`` to ``end``, and how many ids each has."""
        h = slice_hashes(buf, first, end)
        slot = (h & self.mask).astype(np.int64)
        at, count = self.at[slot], self.count[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != h) | (self.width[slot] != end - first))
        if len(miss):
            fresh, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            mine = slot[one]
            _, lead = np.unique(mine, return_index=True)
            stays = np.zeros(len(fresh), bool)
            stays[lead] = self.free[mine[lead]]
            stays &= (end[one] - first[one] <= CACHE_PIECE) & (self.held < CACHE_IDS)
            order = np.argsort(~stays, kind="stable")  # those that stay come first, the others' ids are overwritten next time
            whole = buf.tobytes().decode("latin-1")
            ids, n = self.encode_pieces([whole[a:b] for a, b in zip(first[one[order]].tolist(), end[one[order]].tolist(), strict=True)])
            if self.held + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.held], np.zeros(self.held + 2 * len(ids), self.kind)])
            self.ids[self.held : self.held + len(ids)] = ids
            begin, many = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
            begin[order], many[order] = self.held + np.cumsum(n) - n, n
            put = mine[stays]
            self.keys[put], self.at[put], self.count[put], self.width[put], self.free[put] = fresh[stays], begin[stays], many[stays], (end - first)[one[stays]], False
            self.held += int(many[stays].sum())
            at[miss], count[miss] = begin[back], many[back]
        return at, count

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, packed in ``kind``."""
        out: list = [None] * len(texts)
        apart, split = [], []
        for i, t in enumerate(texts):
            if not self.by_piece or any(m in t for m in self.marks):
                apart.append(i)
                continue
            try:
                split.append((i, t.encode("latin-1")))
            except UnicodeEncodeError:
                apart.append(i)
        if split:
            buf, start = join_texts([t for _, t in split])
            ends = start[1:] - 1
            first = pieces(buf, ends)
            end = np.append(first[1:], len(buf))
            of_text = np.searchsorted(first, ends)  # the piece of the end byte
            real = np.ones(len(first), bool)
            real[of_text] = False
            at, count = self.look_up(buf, first[real], end[real])
            total = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            ids = self.ids[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
            cut = [0, *total[of_text - np.arange(len(split))].tolist()]
            for (i, _), a, b in zip(split, cut, cut[1:]):
                out[i] = ids[a:b].tobytes()
        for i, ids in zip(apart, self.encode([texts[i] for i in apart]), strict=True):
            out[i] = ids.tobytes()
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """The encoder of this process, kept between tasks (a function of the module, so that workers share its state)."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads of its own would only spin
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_table(docs: DataFrame, path: str | None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (binary: the width as a digit, then the ids) of every row of docs (doc_id, text, bucket)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path or tokenizer_path())
        for batch, texts in row_batches(batches, 1, BATCH_BYTES):
            part = encoder([t.decode() for t in texts])
            width, end = encoder.kind.itemsize, np.array([end_id], encoder.kind).tobytes()
            blobs = [b"%d" % width + x + end for x in part]
            yield record({"doc_id": batch.column(0), "bucket": batch.column(2), "n_tokens": pa.array([len(x) // width for x in blobs], pa.int64()), "ids": pa.array(blobs, pa.binary())})

    return docs.mapInArrow(encode, "doc_id long, bucket int, n_tokens long, ids binary")


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[:1] == b"2" else "<u4", offset=1).astype(np.uint32)


def write_tokens(docs: DataFrame, out: str, path: str | None = None, n_buckets: int | None = None) -> None:
    """Writes the segments of ``docs`` (doc_id, text) to the Parquet folder ``out``: bucket, segment, before (ids of the bucket before it), doc_ids, lengths, n_ids, dac."""
    spark = docs.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [k / n_buckets for k in range(1, n_buckets)], 0.2 / n_buckets)})
    bucket = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    encoded = encode_table(docs.select("doc_id", "text", F.coalesce(bucket, F.lit(0)).cast("int").alias("bucket")), path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and doc_id."""
        held: list = []
        state = {"bucket": None, "segment": 0, "before": 0, "n": 0}

        def flush():
            ids = np.concatenate([unpack(b) for _, _, b in held])
            row = record({"bucket": pa.array([state["bucket"]], pa.int32()), "segment": pa.array([state["segment"]], pa.int32()), "before": pa.array([state["before"]], pa.int64()), "doc_ids": pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), "lengths": pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()), "dac": pa.array([dac_encode(ids)], pa.binary())})
            held.clear()
            state.update(segment=state["segment"] + 1, before=state["before"] + len(ids), n=0)
            return row

        for batch in batches:
            for d, b, n, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (b != state["bucket"] or state["n"] + n > SEGMENT_TOKENS):
                    yield flush()
                if b != state["bucket"]:
                    state.update(bucket=b, segment=0, before=0)
                held.append((d, n, blob))
                state["n"] += n
        if held:
            yield flush()

    ordered = encoded.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("ids"), "ids")
    ordered.mapInArrow(pack, "bucket int, segment int, before long, doc_ids array<long>, lengths array<long>, n_ids long, dac binary").write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    seg = spark.read.parquet(out)
    sums = {r.bucket: r.n for r in seg.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}  # one row a bucket
    total, rows = 0, []
    for b in sorted(sums):
        rows.append((b, total))
        total += sums[b]
    offsets = spark.createDataFrame(rows, "bucket int, bucket_start long")
    placed = seg.join(F.broadcast(offsets), "bucket").select((F.col("before") + F.col("bucket_start")).alias("start"), "doc_ids", "lengths", "dac")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, dac in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                reader = DacReader(dac)
                ends = np.cumsum(lengths)
                ids = reader.slice(0, reader.n)
                crcs = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield record({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - np.array(lengths), pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch.path("segments"))
    return read_tokens(spark, scratch.path("segments"))
