"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_WORDS`` words each, all of them). Every passage is encoded as counts of hashed word shapes and byte classes plus surface ratios; a gated
attention net (tanh times sigmoid) learned from document labels weighs the passages, and the weighted passage representation is scored.
Plain NumPy, trained on the driver by Adam on at most ``max_train`` labelled rows (those with the smallest hash among documents of at most ``max_bytes``: bounds that don't grow with the corpus).

A text of more than ``PART_BYTES`` is scored in parts of whole passages: attention weights are kept relative to the largest seen so far, so the score is that of the whole text.

Defined cases: null and empty texts have one empty passage and a score like any other; documents with several labels count once for each; null labels are not learned;
without training rows every score is 0.5 (and every row is kept); an empty table gives no rows; repeated rows are scored each; a null doc_id is scored and kept like any; other columns are kept by ``keep_good`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _SPACE, join_texts, record, row_batches, words
from .language import held_out

PASSAGE_WORDS = 64
HASHED = 96
CLASSES = 14
DIM = HASHED + CLASSES + 8
HIDDEN = 16
#: A document is predicted good from this score on.
THRESHOLD = 0.3
PART_BYTES = 1 << 20

_CLASS = np.full(256, 13, np.uint8)  # other
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 3
for _k, _chars in enumerate([b".", b",", b"!?", b"|", b"#$%&*", b"<>/\\=", b"@:", b"\n", b" \t\r"]):
    _CLASS[list(_chars)] = 4 + _k


def passage_cuts(text: bytes, limit: int) -> tuple[list[int], int]:
    """Where parts of about ``limit`` bytes of whole passages begin and the last ends, and the number of words. Words are counted a slice at a time."""
    cuts, n, inside = [0], 0, False
    for lo in range(0, len(text), limit):
        buf = np.frombuffer(text, np.uint8, min(limit, len(text) - lo), lo)
        word = ~_SPACE[buf]
        opens = np.flatnonzero(word & ~np.r_[inside, word[:-1]])
        inside = bool(word[-1])
        first = opens[(np.arange(len(opens)) + n) % PASSAGE_WORDS == 0]
        n += len(opens)
        if len(first) and lo + first[-1] > cuts[-1]:
            cuts.append(int(lo + first[-1]))
    return [*cuts, len(text)], n


def encode_passages(texts: list[bytes], words_of: np.ndarray | None = None, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (passages by DIM) and the owning text of each; every text has one passage at least.

    words_of: the numbers of words of the documents, where the texts are parts of them; goes_on: the only text is a part with more after it.
    """
    buf, start = (np.frombuffer(texts[0], np.uint8), np.array([0, len(texts[0])])) if goes_on else join_texts(texts)
    h, owner, first, end = words(buf, start)
    n_words = np.bincount(owner, minlength=len(texts))
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    bag = np.repeat(np.arange(len(texts)), n_pass)
    rank = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = base[owner] + rank // PASSAGE_WORDS
    out = np.zeros((total, DIM))
    n = np.maximum(np.bincount(passage, minlength=total), 1).astype(float)
    out[:, :HASHED] = np.bincount(passage * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED) / n[:, None]
    # Bytes belong to the passage of the word they follow; leading blanks to the first.
    marks = np.zeros(len(buf), np.int64)
    opens = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    at = first[opens]
    inner = rank[opens] > 0
    np.add.at(marks, at[inner], 1)
    marks_start = start[:-1]
    running = np.cumsum(marks)
    of = np.repeat(base - (running[marks_start] - marks[marks_start]), np.diff(start)) + running
    classes = np.bincount(of * CLASSES + _CLASS[buf], minlength=total * CLASSES).reshape(total, CLASSES).astype(float)
    size = np.maximum(classes.sum(1), 1)
    out[:, HASHED : HASHED + CLASSES] = classes / size[:, None]
    length = (end - first).astype(float)
    k = HASHED + CLASSES
    mean_len = np.bincount(passage, length, total) / n
    out[:, k] = mean_len / 10
    out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(passage, length**2, total) / n - mean_len**2)) / 10
    order = np.lexsort((h, passage))
    ph, pp = h[order], passage[order]
    same = np.zeros(len(ph), bool)
    same[1:] = (ph[1:] == ph[:-1]) & (pp[1:] == pp[:-1])
    out[:, k + 2] = np.bincount(pp[same], minlength=total) / n
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    out[:, k + 3] = np.bincount(passage[again], minlength=total) / n
    last = _CLASS[buf[np.maximum(end - 1, 0)]]
    out[:, k + 4] = np.bincount(passage[(last >= 6) & (last <= 9)], minlength=total) / n
    lead = _CLASS[buf[first]] if len(first) else np.zeros(0, np.uint8)
    out[:, k + 5] = np.bincount(passage[lead == 1], minlength=total) / n
    total_words = n_words if words_of is None else words_of
    out[:, k + 6] = np.log1p(total_words[bag]) / 10
    out[:, k + 7] = total_words[bag] == 0
    return out, bag


class Mil:
    """Gated attention over passages, then a logistic score of the pooled hidden representation."""

    def __init__(self, dim: int = DIM, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(dim), np.ones(dim)
        self.p = {"E": r.normal(0, 1 / np.sqrt(dim), (dim, hidden)), "e": np.zeros(hidden), "V": r.normal(0, 0.3, (hidden, hidden)), "U": r.normal(0, 0.3, (hidden, hidden)), "w": r.normal(0, 0.3, hidden), "o": r.normal(0, 0.3, hidden), "c": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, a)
        e = np.exp(a - top[bag])
        a = e / np.bincount(bag, e, n)[bag]
        pooled = np.zeros((n, h.shape[1]))
        np.add.at(pooled, bag, a[:, None] * h)
        y = 1 / (1 + np.exp(-np.clip(pooled @ p["o"] + p["c"], -30, 30)))
        return y, (z, h, t, s, a, pooled)

    def gradients(self, x, bag, n, y_true, weight):
        p = self.p
        y, (z, h, t, s, a, pooled) = self.forward(x, bag, n)
        d = (y - y_true) * weight / weight.sum()
        g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        dh = a[:, None] * dp[bag]
        da = (h * dp[bag]).sum(1)
        da = a * (da - np.bincount(bag, a * da, n)[bag])
        g["w"] = (t * s).T @ da
        dts = da[:, None] * p["w"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = dh + dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - h**2)
        g["E"], g["e"] = z.T @ dz, dz.sum(0)
        return g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Mil:
        x, bag = encode_passages(texts)
        y, n = np.array(labels, float), len(texts)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        pos = max(y.mean(), 1e-3)
        # The rarer class weighs half as if both were equal: scores stay near probabilities but bad documents are seen.
        weight = np.where(y > 0.5, 1.0, np.sqrt(pos / max(1 - pos, 1e-3)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            g = self.gradients(x, bag, n, y, weight)
            for k in self.p:
                gk = g[k] + (decay * self.p[k] if k in "EVUo" else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > PART_BYTES:
            return self.score_long(texts[0])
        x, bag = encode_passages(texts)
        return self.forward(x, bag, len(texts))[0]

    def score_long(self, text: bytes, limit: int = PART_BYTES) -> np.ndarray:
        """The score of one text, a part at a time."""
        p, (cuts, n_words) = self.p, passage_cuts(text, limit)
        top, total, pooled = -np.inf, 0.0, np.zeros(len(p["o"]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x, _ = encode_passages([text[lo:hi]], np.array([n_words]), hi < len(text))
            h = np.tanh((x - self.mean) / self.scale @ p["E"] + p["e"])
            a = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
            new = max(top, a.max())
            e, old = np.exp(a - new), np.exp(top - new)
            total, pooled, top = total * old + e.sum(), pooled * old + e @ h, new
        return 1 / (1 + np.exp(-np.clip(pooled / total @ p["o"] + p["c"], -30, 30)))


def train_rows(docs: DataFrame, labels: DataFrame, max_train: int, max_bytes: int) -> list[tuple[bytes, int]]:
    """At most max_train labelled rows, whole texts of at most max_bytes, smallest hashes first."""
    order = ["k", "doc_id", "quality"]
    given = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("k"))
    picked = given.orderBy(*order).limit(max_train)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)  # picked: at most max_train rows
    rows = found.orderBy(*order, F.xxhash64("text"), "text").limit(max_train).collect()  # a doc_id may have many rows
    return [((r.text or "").encode(), r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.quality, r.text or ""))]


def train(docs: DataFrame, labels: DataFrame, max_train: int = 2000, max_bytes: int = 1 << 18) -> Mil | None:
    rows = train_rows(docs, labels, max_train, max_bytes)
    return Mil().fit([t for t, _ in rows], [q for _, q in rows]) if rows else None


def scorer(spark: SparkSession, model: Mil | None):
    """A column of scores for a text column, as an Arrow function."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_batches(batches, 1, PART_BYTES):
            y = shared.value.score(texts) if shared.value else np.full(len(texts), 0.5)
            yield record({"doc_id": batch.column(0), "score": pa.array(y)})

    return score


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = 2000) -> DataFrame:
    """doc_id, score, predicted for docs (doc_id, text), learned from labels (doc_id, quality)."""
    out = docs.select("doc_id", "text").mapInArrow(scorer(docs.sparkSession, train(docs, labels, max_train)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = 2000, train_on: DataFrame | None = None) -> DataFrame:
    """Rows of docs, all columns, that are predicted good; the labelled texts come from train_on (docs if none is given)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if train_on is None else train_on, labels, max_train))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_batches(batches, at, PART_BYTES):
            yield batch if model.value is None else batch.filter(pa.array(model.value.score(texts) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
