"""The stages of the pipeline against plain Python, on a small folder of tables with odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from lumigraph.llm import quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(words, n=5):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    say = lambda n, v=3000: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    items = [(k, f"{say(22)}. {say(9)}") for k in range(12)] + [(90, None), (91, "???")]
    texts = [say(r.randrange(30, 150)) for _ in range(90)]
    texts += ["BUY!! NOW!! " * 50 + say(5) for _ in range(45)]
    texts += [f"{say(80)} {items[k][1].upper()} {say(60)}" for k in range(8)]
    for k in range(12):
        w = texts[k].split()
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
    texts += [texts[3]] * 6 + [None, "", " \n", "one word", "Straße é " * 40, say(9000)]
    rows = [(i, t, "en" if i % 7 else None, None if i % 11 == 0 else f"s{i % 3}", None if i % 5 else 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[6], (None, say(50), "en", "s1", 2), (None, None, None, None, None)]
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"h1": F.lit("mine"), "mix_rate": F.lit(7), "component_id": F.lit(0), "shard": F.lit("x")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not (t or "").startswith("BUY")), 0) for i, t, *_ in rows if i is not None and i % 2] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def key(rows):
    return sorted((-1 if r[0] is None else r[0], r[1] or "", r[2] or "", r[3] or "", r[4] or 0) for r in rows)


def given(spark, rows):
    return spark.createDataFrame([tuple(r[:5]) for r in rows], SCHEMA).repartition(2).withColumn("text__mine", F.lit(1))


def test_quality_stage(spark, tables):
    folder, rows, _ = tables
    labelled = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    train = sorted((i, labelled[i], t or "") for i, t, *_ in rows if i in labelled)
    model = quality.Mil().fit([t.encode() for *_, t in train], [q for _, q, _ in train])
    want = [r for r in rows if model.score([(r[1] or "").encode()])[0] >= quality.THRESHOLD]
    got = pipeline.keep_quality(spark, given(spark, rows), folder)
    assert got.columns == pipeline.COLUMNS and key(got.collect()) == key(want) and 100 < len(want) < len(rows) - 30


def test_near_duplicate_stage(spark, tables):
    folder, rows, _ = tables
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, shingle_set(words_of(t)))
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    want = [r for r in rows if r[0] is None or low[r[0]] == r[0]]
    got = pipeline.drop_near_duplicates(spark, given(spark, rows), folder)
    assert got.columns == pipeline.COLUMNS and key(got.collect()) == key(want) and len(rows) - len(want) >= 14


def test_contamination_stage(spark, tables):
    folder, rows, items = tables
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())

    def held(text):
        own = shingle_set(split(text or ""))
        return any(len(shingle_set(split(t)) & own) >= 0.8 * len(shingle_set(split(t))) for _, t in items if t and split(t))

    got = pipeline.drop_contaminated(spark, given(spark, rows), folder)
    want = [r for r in rows if not held(r[1])]
    assert got.columns == pipeline.COLUMNS and key(got.collect()) == key(want) and len(rows) - len(want) == 8


def test_mix_stage(spark, tables):
    folder, rows, _ = tables
    own = {}
    for _, t, _, s, _ in rows:
        own[s] = own.get(s, 0) + len((t or "").encode())
    want = []
    for r in rows:
        rate = sum(own.values()) / len(own) / own[r[3]]
        u = int(hashlib.md5(f"{-1 if r[0] is None else r[0]}:mix-1".encode()).hexdigest()[:13], 16) / (1 << 52)
        n, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        want += [r] * n
    got = pipeline.mix_sources(spark, given(spark, rows), folder)
    assert got.columns == pipeline.COLUMNS and key(got.collect()) == key(want)


def test_shard_stage(spark, tables):
    folder, rows, _ = tables
    got = pipeline.shard(spark, given(spark, rows), folder).collect()
    groups = {}
    for _, t, *_ in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    heap = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    load = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert sorted(load) == sorted(heap) and len(got) == len(rows)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(16))


def test_run(spark, tables):
    folder, rows, _ = tables
    out = pipeline.run(spark, folder).collect()
    assert out and {r.shard for r in out} <= set(range(16)) and len({r.doc_id for r in out}) < len(rows) - 50


def test_empty_tables(spark, tables, tmp_path):
    folder, rows, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    empty = f"file://{tmp_path}"
    assert pipeline.run(spark, empty).isEmpty()
    for _, stage in pipeline.STAGES[:4]:
        assert stage(spark, given(spark, rows).limit(0), folder).isEmpty()
    assert pipeline.keep_quality(spark, given(spark, rows), empty).count() == pipeline.drop_contaminated(spark, given(spark, rows), empty).count() == len(rows)


def test_model_score_is_the_same_in_any_batch():
    r = np.random.default_rng(3)
    m = quality.Mil()
    texts = [" ".join(f"w{k}" for k in r.integers(0, 99, n)).encode() for n in (0, 1, 70, 400)]
    assert np.allclose(m.score(texts), [m.score([t])[0] for t in texts])
