"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the different 1- to ``N_MAX``-byte n-grams that both hold (presence, not frequency), divided by the root of the product of their own counts of different
n-grams. Landmarks drawn from the training rows give a Nyström map: K(text, landmarks) K(landmarks, landmarks)^-1/2. One ridge regression for each language against the rest is
solved on the mapped training rows; whole texts are then scored in batches by two matrix products. N-grams are of UTF-8 bytes with A-Z lower-cased and digits and blanks as spaces, all told
apart by their bytes: those of the landmarks are a vocabulary with a place each, the others count for a text's own number. A text of any length is read whole, in parts of ``PART_BYTES``.

Learning uses at most ``per_lang`` training texts of each of the ``max_langs`` most frequent languages, those with the smallest hash among those of at most ``max_bytes``, and at most ``landmarks``
landmarks: bounds that don't grow with the corpus. It runs on the driver over these rows only.

Defined cases: a text that is null or has no letter is ``und`` with score 1; without any training row all texts are ``und``; an empty table gives no rows; null languages are not learned;
repeated rows are scored each; rows with a null doc_id count as not held out; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import record, row_batches

N_MAX = 4
PART_BYTES = 1 << 18
SALTS = 16
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_FOLD[48:58] = 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, in no special order. Each claims a slot; a key that finds another one there is compared by sorting."""
    if not len(keys):
        return keys
    bits = max(10, int(len(keys)).bit_length() + 1)
    slot = _slots(keys, bits)
    owner = np.empty(1 << bits, np.int32)
    owner[slot] = np.arange(len(keys), dtype=np.int32)
    of = owner[slot]
    first = of == np.arange(len(keys))
    apart = keys[of] != keys
    return np.concatenate([keys[first], np.unique(keys[apart])]) if apart.any() else keys[first]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of all different n-grams of each text; an n-gram is its bytes and, above them, its length."""
    held: list[np.ndarray] = []  # the same n-gram may be in several where a text is in several
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if group:
            buf = _FOLD[np.frombuffer(b"".join(t for _, t in group), np.uint8)].astype(np.uint64)
            lengths = [len(t) for _, t in group]
            owner = np.repeat(np.array([i for i, _ in group], np.uint64), lengths)
            left = np.concatenate([np.arange(n, 0, -1) for n in lengths])  # bytes from each place to the end of its part
            code, keys = np.zeros(len(buf), np.uint64), []
            for n in range(1, N_MAX + 1):
                code = (code[: len(buf) - n + 1] << np.uint64(8)) | buf[n - 1 :]
                whole = left[: len(code)] >= n
                keys.append(((owner[: len(code)] << np.uint64(35)) | np.uint64(n << 32) | code)[whole])
            held.append(distinct(np.concatenate(keys)))
            group.clear()
        if len(held) > 8:
            held[:] = [distinct(np.concatenate(held))]

    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), PART_BYTES):
            part = t[lo : lo + PART_BYTES + N_MAX - 1]  # n-grams across the cut belong to the part before
            if part:
                group.append((i, part))
                size += len(part)
            if size >= PART_BYTES:
                flush()
                size = 0
    flush()
    keys = held[0] if len(held) == 1 else distinct(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    return (keys >> np.uint64(35)).astype(np.int64), keys & np.uint64((1 << 35) - 1)


class Vocabulary:
    """Places of known n-grams, found through slots; n-grams that share a slot are looked up in order."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(10, int(4 * len(self.keys)).bit_length())
        slot = _slots(self.keys, self.bits)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot] = np.arange(len(self.keys), dtype=np.int32)
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[slot[self.table[slot] != np.arange(len(self.keys))]] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not known."""
        slot = _slots(keys, self.bits)
        at = self.table[slot].astype(np.int64)
        known = at >= 0
        known[known] = self.keys[at[known]] == keys[known]
        at[~known] = -1
        again = np.flatnonzero(~known & self.shared[slot])
        if len(again):
            found = np.searchsorted(self.keys, keys[again])
            found[found == len(self.keys)] = 0
            real = self.keys[found] == keys[again]
            at[again[real]] = found[real]
        return at


class Model:
    """Landmarks as a 0/1 matrix of n-grams by landmarks, and one column of weights for each language."""

    def __init__(self, landmarks: list[bytes]):
        of, gram = grams(landmarks)
        self.vocabulary = Vocabulary(gram)
        self.marks = np.zeros((len(self.vocabulary.keys), len(landmarks)), np.uint8)
        self.marks[self.vocabulary.places(gram), of] = 1
        self.norm = np.sqrt(np.maximum(self.marks.sum(0, dtype=np.int64), 1))
        self.langs: list[str] = []
        self.weights = np.zeros((len(landmarks) + 1, 0))

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """Texts by landmarks. Only n-grams that a batch holds take part in its product."""
        of, gram = grams(texts)
        own = np.bincount(of, minlength=len(texts))
        at = self.vocabulary.places(gram)
        of, at = of[at >= 0], at[at >= 0]
        used = np.zeros(len(self.marks), bool)
        used[at] = True
        column = np.cumsum(used) - 1
        present = np.zeros((len(texts), int(used.sum())), np.float32)
        present[of, column[at]] = 1
        return (present @ self.marks[used].astype(np.float32)) / (np.sqrt(np.maximum(own, 1))[:, None] * self.norm[None, :])

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and a score from the softmax over the regressions."""
        k = self.kernel(texts)
        y = np.hstack([k, np.ones((len(k), 1))]) @ self.weights
        e = np.exp((y - y.max(1, keepdims=True)) * 4)
        p = e / e.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def fit(rows: list[tuple[bytes, str]], landmarks: int = 192, ridge: float = 1e-2) -> Model | None:
    """rows: (text, lang), in a fixed order. At most ``landmarks`` of them, spread over the languages, are landmarks."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    by = {lang: [t for t, x in rows if x == lang] for lang in langs}
    turns = [by[lang][k] for k in range(max(len(x) for x in by.values())) for lang in langs if k < len(by[lang])]
    model = Model(turns[:landmarks])
    km = model.kernel(turns[:landmarks])
    values, vectors = np.linalg.eigh((km + km.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.vstack([model.kernel([t for t, _ in rows[i : i + 64]]) for i in range(0, len(rows), 64)]) @ root
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    # Languages weigh the same however many rows they have.
    w = np.array([1.0 / len(by[lang]) for _, lang in rows]) * len(rows) / len(langs)
    a = (phi * w[:, None]).T @ phi + ridge * len(rows) * np.eye(phi.shape[1]) * 0.01
    beta = np.linalg.solve(a, (phi * w[:, None]).T @ y)
    model.langs, model.weights = langs, np.vstack([root @ beta[:-1], beta[-1:]])
    return model


def train_rows(docs: DataFrame, per_lang: int, max_langs: int, max_bytes: int) -> list[tuple[bytes, str]]:
    """At most per_lang rows of each of the max_langs most frequent languages (ties: by name), whole texts of at most max_bytes, smallest hashes first."""
    ok = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= max_bytes))
    ok = ok.withColumn("h", F.xxhash64("text"))
    langs = ok.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    order = [F.xxhash64("doc_id"), "doc_id", "h"]
    few = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))).where(F.col("rank") <= per_lang)
    salted = ok.select("doc_id", "lang", "h", F.pmod("h", F.lit(SALTS)).alias("salt")).distinct().join(F.broadcast(langs), "lang")
    picked = few(few(salted, "salt").drop("rank")).drop("salt")  # a frequent language is cut down salt by salt first
    found = ok.join(F.broadcast(picked), ["doc_id", "lang", "h"]).select("lang", "rank", "text").dropDuplicates(["lang", "rank"]).collect()  # picked: per_lang rows a language
    return [(r.text.encode(), r.lang) for r in sorted(found, key=lambda r: (r.lang, r.rank))]


def identify(docs: DataFrame, train: DataFrame, per_lang: int = 200, landmarks: int = 192, max_langs: int = 256, max_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, lang_pred, score for docs (doc_id, text), learned from train (doc_id, text, lang)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(train_rows(train, per_lang, max_langs, max_bytes), landmarks))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in row_batches(batches, 1, PART_BYTES):
            real = [i for i, t in enumerate(texts) if LETTER.search(t.decode(errors="replace"))] if m else []
            langs, scores = ["und"] * len(texts), np.ones(len(texts))
            if real:
                best, p = m.predict([texts[i] for i in real])
                for i, b in zip(real, best, strict=True):
                    langs[i] = m.langs[b]
                scores[real] = p
            yield record({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(doc_id, mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
