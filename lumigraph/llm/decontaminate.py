"""Benchmark decontamination: training passages query a BM25 inverted index of the test items with block-max WAND.

Items are indexed, passages are queries. Postings hold the impact of a term on an item, divided by the item's own score (of itself as query), so a
score is the share of the item's weight that a passage covers, and one threshold serves all items. Items lie in blocks; each term has its
largest impact for every block it occurs in. A passage whose terms' block maxima stay below the threshold can't hold an item of that block; terms
are taken rarest first and the common ones, whose maxima together can't reach what is missing, are only read for blocks that are still open. Nothing above the threshold is lost.

Words are runs of letters and digits of the lower-cased text, so punctuation glued to a leaked passage hides nothing.

A retrieved item is verified on word 5-shingles: an item's text is its question and, from its last sentence on, its answer. It is reported if the document holds at least
``min_overlap`` of all its shingles and at least ``min_part`` of those of the question and of the answer each (a part of fewer than 5 words is joined to the other one).

Passages are ``2 L`` words long and start every ``L`` words, where ``L`` is the number of words of the longest item, so every place where an item can stand lies whole in a passage.

The index is broadcast in slices of about ``slice_items`` items, each scanned on its own, so its size is bounded whatever the benchmark's. Item count, mean length, longest item
and document frequencies are those of the whole benchmark, so scores don't depend on the slices.
Defined cases: items without words (null, blank, signs only) are not indexed; null and empty texts retrieve nothing; equal items are all reported; repeated rows of a document are reported once;
rows with a null doc_id are never reported. ``drop_contaminated`` judges every row by its own text, whatever its doc_id, and keeps all columns; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, join_texts, record, row_batches, shingles, text_batches, words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
BLOCK_ITEMS = 16


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line of at least 5 words answers."""
    ends = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text) if len(text[m.end() :].split()) >= SHINGLE and len(text[: m.end()].split()) >= SHINGLE]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


def has_words(text: str | None) -> bool:
    """Whether a text has a sign that words are made of: an ASCII letter or digit or anything beyond ASCII."""
    return bool(text) and any(c.isalnum() or c >= "\x80" for c in text)


def item_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item, term and frequency of every different term of every item, and the items' numbers of words."""
    h, owner, _, _ = words(*join_texts([t.lower().encode() for t in texts]), True)
    pair, tf = np.unique(np.stack([owner.astype(np.uint64), h], 1), axis=0, return_counts=True)
    return pair[:, 0].astype(np.int64), pair[:, 1], tf, np.bincount(owner, minlength=len(texts))


class Corpus(NamedTuple):
    """Statistics of the whole benchmark: items, their words together, words of the longest, and the document frequencies of (sorted) terms."""

    n: int
    n_words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """BM25 impacts by term, with block maxima, and the items' shingles, for scores of at least ``threshold``. Without ``corpus`` the items are the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None, threshold: float = THRESHOLD):
        if threshold <= 0:
            raise ValueError("the threshold must be positive")
        items = [(i, t) for i, t in items if has_words(t)]
        self.threshold = threshold
        self.ids = np.array([i for i, _ in items], np.int64)
        n = len(items)
        item, term, tf, length = item_terms([t for _, t in items])
        self.terms, code = np.unique(term, return_inverse=True)
        if corpus is None:
            corpus = Corpus(n, int(length.sum()), int(length.max()) if n else 1, self.terms, np.bincount(code, minlength=len(self.terms)))
        self.longest = corpus.longest
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log(1 + (corpus.n - df + 0.5) / (df + 0.5))
        impact = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(corpus.n_words / max(corpus.n, 1), 1)))
        impact = impact / np.bincount(item, impact, n)[item]
        order = np.lexsort((item, code))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        n_blocks = -(-n // BLOCK_ITEMS) if n else 0
        self.n_blocks = n_blocks
        key = code[order] * max(n_blocks, 1) + self.item // BLOCK_ITEMS
        keys, at = np.unique(key, return_index=True)
        self.block, self.block_max = keys % max(n_blocks, 1), np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.block_first = np.searchsorted(keys // max(n_blocks, 1), np.arange(len(self.terms) + 1))
        # Common terms: the most frequent ones whose block maxima together stay below SLACK of the threshold in every block. So a block without a rare term can't reach the threshold.
        rank = np.argsort(-df, kind="stable")
        rest, common = np.zeros(max(n_blocks, 1)), np.zeros(len(self.terms), bool)
        for t in rank:
            lo, hi = self.block_first[t], self.block_first[t + 1]
            add = rest.copy()
            add[self.block[lo:hi]] += self.block_max[lo:hi]
            if add.max() > SLACK * threshold:
                break
            rest, common[t] = add, True
        self.common, self.common_max = common, rest
        parts = [split_item(t) for _, t in items]
        flat = [p.lower().encode() for q in parts for p in q]
        sh, so = shingles(*words(*join_texts(flat), True)[:2], len(flat), SHINGLE) if flat else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts = [sh[so == k] for k in range(len(flat))]
        # A quick test for terms: 2^18 places of the hash.
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def retrieve(self, passage: np.ndarray, h: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items with at least the index's threshold."""
        threshold = self.threshold
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        hit = self.maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)]
        passage, h = passage[hit], h[hit]
        code = np.searchsorted(self.terms, h)
        code[code == len(self.terms)] = 0
        real = self.terms[code] == h
        key = np.unique(passage[real] * len(self.terms) + code[real])
        passage, code = key // len(self.terms), key % len(self.terms)
        rare = ~self.common[code]
        p, at = _expand(passage[rare], self.block_first[code[rare]], self.block_first[code[rare] + 1])
        bound = np.bincount(p * self.n_blocks + self.block[at], self.block_max[at], n_passages * self.n_blocks).reshape(n_passages, self.n_blocks)
        open_ = bound + self.common_max[None, :] >= threshold - 1e-9
        open_ &= bound > 0
        some = open_.any(1)
        keep = some[passage] & ~rare
        p, at = _expand(passage[keep], self.block_first[code[keep]], self.block_first[code[keep] + 1])
        bound += np.bincount(p * self.n_blocks + self.block[at], self.block_max[at], n_passages * self.n_blocks).reshape(n_passages, self.n_blocks)
        open_ &= bound >= threshold - 1e-9
        some = open_.any(1)
        if not some.any():
            return none
        keep = some[passage]
        p, at = _expand(passage[keep], self.first[code[keep]], self.first[code[keep] + 1])
        inside = open_[p, self.item[at] // BLOCK_ITEMS]
        key, back = np.unique(p[inside] * len(self.ids) + self.item[at[inside]], return_inverse=True)
        score = np.bincount(back, self.impact[at[inside]], len(key))
        good = score >= threshold - 1e-9
        return key[good] // len(self.ids), key[good] % len(self.ids), score[good]


#: Share of the threshold that the common terms may make up together.
SLACK = 0.5


def _expand(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place lo..hi-1 of every row, with its owner."""
    n = hi - lo
    total = int(n.sum())
    return np.repeat(owner, n), np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def scan(index: Index, texts: list[bytes], min_overlap: float, min_part: float = 0.5) -> list[tuple[int, int, float, float, float]]:
    """(text, item place, score, question overlap, answer overlap) of verified items."""
    if not len(index.ids):
        return []
    buf, start = join_texts(texts)
    h, owner, _, _ = words(buf, start, True)
    n_words = np.bincount(owner, minlength=len(texts))
    step = index.longest
    n_pass = np.maximum(1, -(-n_words // step))
    base = np.cumsum(n_pass) - n_pass
    rank = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    own = base[owner] + rank // step
    # A word lies in the passage that starts at its step and in the one before.
    again = rank >= step
    p, item, score = index.retrieve(np.concatenate([own, own[again] - 1]), np.concatenate([h, h[again]]), int(n_pass.sum()))
    if not len(p):
        return []
    text = np.repeat(np.arange(len(texts)), n_pass)[p]
    order = np.lexsort((-score, item, text))
    text, item, score = text[order], item[order], score[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
    out = []
    where = np.searchsorted(owner, np.arange(len(texts) + 1))
    last, own_shingles = -1, None
    for t, i, s in zip(text[new], item[new], score[new], strict=True):
        if t != last:
            hs = h[where[t] : where[t + 1]]
            own_shingles = shingles(hs, np.zeros(len(hs), np.int64), 1, SHINGLE)[0]
            last = t
        question, answer = index.parts[2 * i], index.parts[2 * i + 1]
        if len(question) == 1 and not len(answer):  # an item of fewer words than a shingle: its whole sequence
            found = _holds_sequence(h[where[t] : where[t + 1]], question[0], min(index.longest, SHINGLE - 1))
            q = a = both = float(found or np.isin(question, own_shingles).any())
        else:
            in_q, in_a = np.isin(question, own_shingles), np.isin(answer, own_shingles)
            q = float(in_q.mean())
            a = float(in_a.mean()) if len(answer) else q
            both = float(np.concatenate([in_q, in_a]).mean())
        if both >= min_overlap and min(q, a) >= min_part:
            out.append((int(t), int(i), float(s), q, a))
    return out


def _holds_sequence(h: np.ndarray, wanted: np.uint64, longest: int) -> bool:
    for n in range(1, longest + 1):
        if len(h) < n:
            break
        k = len(h) - n + 1
        part = np.stack([h[j : j + k] for j in range(n)], 1).reshape(-1)
        if (shingles(part, np.repeat(np.arange(k), n), k, SHINGLE)[0] == wanted).any():
            return True
    return False


def _slice_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (slice, text) of items: slice and term of all different terms of an item, and a row without a term with its number of words."""
    for batch in batches:
        of, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        kept = [k for k, t in enumerate(texts) if has_words(t)]
        if not kept:
            continue
        of = of[kept]
        item, term, _, length = item_terms([texts[k] for k in kept])
        yield record({"slice": pa.array(of[item], pa.int32()), "term": pa.array(term.view(np.int64)), "n_words": pa.nulls(len(term), pa.int64())})
        yield record({"slice": pa.array(of, pa.int32()), "term": pa.nulls(len(of), pa.int64()), "n_words": pa.array(length, pa.int64())})


def slice_statistics(rows: DataFrame, slices: int, scratch: Scratch) -> Iterator[Corpus]:
    """For each slice of items (k, text) the statistics of the whole benchmark, with the frequencies of the slice's terms."""
    found = scratch.save(rows.select(F.pmod("k", F.lit(slices)).cast("int").alias("slice"), "text").mapInArrow(_slice_terms, "slice int, term long, n_words long"), "terms")
    total = found.where("term is null").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"), F.max("n_words").alias("longest")).first()
    inside = found.where("term is not null")
    known = scratch.save(inside.select("slice", "term").distinct().join(inside.groupBy("term").agg(F.count("*").alias("df")), "term"), "frequencies")
    for s in range(slices):
        part = known.where(F.col("slice") == s).select("term", "df").toArrow()  # the terms of about slice_items items
        term, df = part.column("term").to_numpy().view(np.uint64), part.column("df").to_numpy()
        order = np.argsort(term)
        yield Corpus(total.n, total.n_words or 0, max(total.longest or 0, 1), term[order], df[order])
    scratch.drop("terms", "frequencies")


def indexes(benchmark: DataFrame, threshold: float, slice_items: int) -> list[Broadcast]:
    """The index in slices of about slice_items items, with the statistics of the whole benchmark."""
    spark = benchmark.sparkSession
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)).alias("k"))
    slices = max(1, -(-rows.count() // slice_items))
    found = []
    for s, corpus in enumerate(slice_statistics(rows, slices, Scratch(spark, "decontaminate")) if slices > 1 else [None]):
        part = rows.where(F.pmod("k", F.lit(slices)) == s)
        found.append(spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], corpus, threshold)))  # about slice_items rows
    return found


def folded(text: bytes) -> bytes:
    return text.decode(errors="replace").lower().encode()


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_overlap: float = 0.8, slice_items: int = 4096) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every document (doc_id, text) and item (item_id, text) it holds."""
    out = None
    for index in indexes(benchmark, threshold, slice_items):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for ids, texts in text_batches(batches, 2 << 20):
                found = scan(index.value, [folded(t) for t in texts], min_overlap)
                yield record({"doc_id": pa.array([ids[t] for t, *_ in found], pa.int64()), "item_id": pa.array([int(index.value.ids[i]) for _, i, *_ in found], pa.int64()), **{name: pa.array([x[k] for x in found], pa.float64()) for k, name in ((2, "score"), (3, "question_overlap"), (4, "answer_overlap"))}})

        hits = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(find, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = hits if out is None else out.union(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


#: Slices of the index that one pass over the documents holds in memory.
SLICES_A_PASS = 4


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_overlap: float = 0.8, slice_items: int = 4096) -> DataFrame:
    """Rows of docs, all columns, whose text holds no benchmark item. Rows are dropped where they are read: nothing is shuffled."""
    at = docs.columns.index("text")
    found = indexes(benchmark, threshold, slice_items)
    out = docs
    for lo in range(0, len(found), SLICES_A_PASS):

        def keep(batches: Iterator[pa.RecordBatch], part=found[lo : lo + SLICES_A_PASS]) -> Iterator[pa.RecordBatch]:
            for batch, texts in row_batches(batches, at, 2 << 20):
                texts = [folded(t) for t in texts]
                good = np.ones(len(texts), bool)
                for index in part:
                    good[[t for t, *_ in scan(index.value, texts, min_overlap)]] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
