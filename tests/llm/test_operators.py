"""Corpus operators on small tables: brute force, round trips, and odd rows (nulls, empty and long texts, ties, repeated rows, clashing columns)."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.llm import decontaminate, embeddings, jaccard, language, mixing, quality, sharding, suffix, tokenfile, warc
from lumigraph.llm._common import join_texts, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, bucket string, rate string"


def sentence(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [sentence(r, r.randrange(20, 120)) for _ in range(30)]
    texts = list(base)
    for k in range(20):
        w = base[k % 5].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[0]] * 15 + ["", None, "one", "ONE", "two words", " \n\t ", "Straße é " * 30, base[3] + " " + base[4], sentence(r, 4000)]
    return [(i, t, "en", "a" if i % 3 else None, 1, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def sets_of(rows, n):
    out = {}
    for i, t, *_ in rows:
        buf, start = join_texts([(t or "").encode()])
        h, o, _, _ = words(buf, start)
        out[i] = frozenset(shingles(h, o, 1, n)[0].tolist())
    return out


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(ids), 2) if linked(a, b)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_jaccard(docs, rows, n, num):
    s = sets_of(rows, n)
    want = brute_components(s, lambda a, b: s[a] and s[b] and 100 * len(s[a] & s[b]) >= num * len(s[a] | s[b]))
    got = jaccard.jaccard_components(docs, n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s[i]), want[i]) for i in s} and len(got) == len(rows)


def test_jaccard_large_regions(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", 100)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 150)
    test_jaccard(docs, rows, 4, 85)


def test_linked_sets_meet_under_any_order():
    """Two linked sets share a signature in a ring, however the shingles are ordered."""
    r = np.random.default_rng(1)
    for trial in range(150):
        num, base = (80, 85, 50)[trial % 3], r.integers(0, 2**63, int(r.integers(1, 120))).astype(np.uint64)
        sets = [np.unique(np.r_[base[r.random(len(base)) < r.choice([0.85, 0.9, 0.95, 1.0])], r.integers(0, 2**63, int(r.integers(0, 1 + len(base) // 8))).astype(np.uint64)]) for _ in range(8)]
        sets = [x for x in sets if len(x)]
        if not sets:
            continue
        n = np.array([len(x) for x in sets])
        sig, node = jaccard.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n, num, 100, r.integers(0, 256, 1 << 16).astype(np.uint8))
        by, plain = [set(sig[node >> 1 == i].tolist()) for i in range(len(sets))], [set(x.tolist()) for x in sets]
        assert all(by[a] & by[b] for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(plain[a] & plain[b]) >= num * len(plain[a] | plain[b]))


def test_commonness(docs, rows):
    s = sets_of(rows, 5)
    levels = jaccard.commonness(docs, 5, 1 << 20)
    counts = np.zeros(len(levels))
    np.add.at(counts, np.array([h for x in s.values() for h in x], np.uint64) >> np.uint64(64 - 16), 1)
    assert len(levels) == 1 << 16 and (levels == np.minimum(255, 8 * np.log2(counts + 1)).astype(np.uint8)).all()
    assert [jaccard.table_bits(t) for t in (0, 1 << 30, 1 << 47)] == [16, 23, 23]


def test_region_join():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = r.choice(10**6, 60, replace=False)
        for _ in range(40):
            sets.append(np.unique(np.r_[r.choice(base, r.integers(45, 61), replace=False), r.integers(0, 10**6, r.integers(0, 4))]).astype(np.uint64))
    plain = [frozenset(x.tolist()) for x in sets]
    want = brute_components(range(len(sets)), lambda a, b: 100 * len(plain[a] & plain[b]) >= 85 * len(plain[a] | plain[b]))
    labels = jaccard.Region(sets, 85, 100).join()
    assert all((labels[a] == labels[b]) == (want[a] == want[b]) for a, b in itertools.combinations(range(len(sets)), 2))


@pytest.mark.parametrize("region", [1, 10**7])
def test_jaccard_rows_of_one_id(spark, monkeypatch, region):
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", region)
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, None), (1, "other words " * 9), (2, text + " end"), (3, ""), (3, None), (4, text[:100])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted({(r.doc_id, r.component_id) for r in got}) == [(1, 1), (2, 1), (3, 3), (4, 4)] and len(got) == len(rows)


def test_keep_first(docs):
    kept = jaccard.keep_first(docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 0").count() == 1 and not kept.where("doc_id between 50 and 64").count()


def test_suffix(docs, rows):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), gone.sum(), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_passage_repeated_in_a_document(spark):
    r = random.Random(11)
    passage, left, right = (sentence(r, 25, 10**6) for _ in range(3))
    again = f"{left} {passage} {right}"  # the same run several times in its smallest document
    texts = [f"{sentence(r, 30)} {passage} {sentence(r, 30)}", " ".join([again, sentence(r, 40), again, sentence(r, 40), again]), f"{sentence(r, 20)} {again}"]
    rows = [(i, t) for i, t in enumerate(texts)]
    test_suffix(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    twice = suffix.remove_repeats(spark.createDataFrame([(0, texts[0]), (1, again), (1, again)], "doc_id long, text string")).where("doc_id = 1").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed >= len(passage)


def test_suffix_of_long_texts(spark, monkeypatch):
    """Texts cut into overlapping pieces lose the same bytes as whole ones."""
    monkeypatch.setattr(suffix, "PIECE_BYTES", 700)
    r = random.Random(21)
    passage = sentence(r, 40, 10**6)
    texts = [f"{sentence(r, 60)} {passage}", " ".join([sentence(r, 300), passage, sentence(r, 150), passage[20:120], sentence(r, 99)]), None, "", sentence(r, 500) + passage]
    rows = [(i, t) for i, t in enumerate(texts)]
    test_suffix(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    kept = suffix.remove_repeats(spark.createDataFrame([*rows, (1, texts[1]), (None, passage)], "doc_id long, text string"), output=suffix.kept_texts, schema="doc_id long, kept binary").collect()
    assert len(kept) == 6 and [bytes(x.kept) for x in kept if x.doc_id == 0] == [texts[0].encode()] and len({bytes(x.kept) for x in kept if x.doc_id == 1}) == 1


def test_token_file_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(2, "b"), (2, "a"), (None, "x y"), (None, None), (1, "a"), (2, "b"), (2, "")]
    found = []
    for k, order in enumerate((rows, rows[::-1])):
        d = spark.createDataFrame(order, "doc_id long, text string").repartition(k + 1).withColumn("bucket", F.lit("mine"))
        tokenfile.write_tokens(d, f"file://{tmp_path}/{k}")
        found.append(sorted(map(tuple, tokenfile.read_tokens(spark, f"file://{tmp_path}/{k}").collect()), key=lambda x: x[1]))
    assert found[0] == found[1] and len(found[0]) == 7 and [x[0] for x in found[0]] == [None, None, 1, 2, 2, 2, 2]
    tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/none").isEmpty()


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    from tokenizers import Tokenizer

    path = tokenfile.tokenizer_path(name)
    t, e = Tokenizer.from_file(path), tokenfile.WordEncoder(path)
    texts = ["some plain text, isn't it?", "", "  two  blanks\n", "Straße é"]
    assert [np.frombuffer(x, e.kind).tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_row_batches():
    import pyarrow as pa

    from lumigraph.llm._common import row_batches

    texts = ["a" * n for n in (3, 500, 0, 20, 90, 1000, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = list(row_batches([batch, batch.slice(0, 0)], 1, 100))
    assert [x for _, p in parts for x in p] == [(t or "").encode() for t in texts] and [i for b, _ in parts for i in b.column(0).to_pylist()] == list(range(8))
    assert all(sum(map(len, p)) <= 100 or len(p) == 1 for _, p in parts)


def test_revisits_of_odd_rows(spark):
    columns = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, payload string, canonical string, s string"
    rows = [
        (1, "http://www.a.com/x?ref=1", 10, "response", "e", None, None, {"A": "1"}, "www", "c", "s"), (2, "http://a.com/x", 20, "revisit", "e", None, None, {}, None, "c", "s"), (3, "http://www.a.com/x?ref=1", 20, "revisit", "e", None, None, {}, None, "c", "s"),
        (3, "http://www.a.com/x?ref=1", 5, "revisit", "e", None, None, {}, None, "c", "s"), (1, "http://www.a.com/x?ref=1", 10, "response", "e", None, None, {"A": "1"}, "www", "c", "s"), (None, "http://a.com", 1, "revisit", None, None, None, None, None, "c", "s"),
        (9, "http://b.com", 1, None, None, None, None, None, "p", "c", "s"),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, columns)).collect()
    assert len(got) == len(rows)
    assert {(r.record_id, r.ts, r.resolved) for r in got} == {(1, 10, True), (2, 20, False), (3, 20, True), (3, 5, False), (None, 1, False), (9, 1, False)}
    folded = {(r.record_id, r.ts): r.payload for r in warc.resolve_revisits(spark.createDataFrame(rows, columns), ignored=warc.IGNORED_PARAMETERS + "|ref", fold_hosts=True).collect()}
    assert folded[2, 20] == "www"


def test_columns_with_clashing_names(spark, docs):
    """Operators don't read other columns, whatever they are called."""
    names = ["chunk", "bucket", "row", "piece", "region", "large", "n", "a", "b", "id", "component", "kind", "blocks", "block", "rep", "copies", "h1", "h2", "label__", "score", "rank", "h"]
    odd = docs.select("doc_id", "text", "lang", "source", *[F.lit("mine").alias(n) for n in names])
    plain = docs.select("doc_id", "text", "lang", "source")
    for run in (suffix.remove_repeats, jaccard.jaccard_components, sharding.shard_documents, lambda d: language.identify(d, d)):
        one, two = (sorted(map(str, run(d).drop("slot").collect())) for d in (odd, plain))
        assert one == two
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    one, two = (sorted(map(str, embeddings.near_duplicates(d).collect())) for d in (v, v.select("*", *[F.lit("mine").alias(n) for n in names])))
    assert one == two and len(one) == 3


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard.jaccard_components(none).isEmpty() and suffix.remove_repeats(none).isEmpty() and sharding.shard_documents(none).isEmpty() and mixing.mix(none).isEmpty()
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()
    assert decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).isEmpty()
    assert language.identify(docs, none).where("lang_pred <> 'und'").isEmpty()
    assert {r.score for r in quality.score_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}
    assert warc.resolve_revisits(warc.capture_log(spark.createDataFrame([], "page_id long, url string, html string"))).isEmpty()


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(20, 8))
    x = np.concatenate([base, base[:10] + r.normal(size=(10, 8)) * 0.12, base[:3], base[:3] * 2])
    rows = [(i, [float(np.float32(v)) for v in e], int(i % 2 if i >= 20 else i % 2)) for i, e in enumerate(x)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] + [1.0] * 7, 1), (103, rows[0][1], None), (104, [], 1), (105, [1.0, None], 1), (106, [1.0, 2.0], 0)]
    got = {v.vec_id: v for v in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=5).collect()}
    e = {i: np.array(v) for i, v, label in rows if i < 100}
    label = {i: k for i, _, k in rows}
    near = lambda a, b: a in e and b in e and label[a] == label[b] and e[a] @ e[b] / np.linalg.norm(e[a]) / np.linalg.norm(e[b]) >= 0.98
    want = brute_components(label, near)
    assert {i: (v.n_links, v.component_id, v.kept) for i, v in got.items()} == {i: (sum(near(i, j) for j in label if j != i), want[i], want[i] == i) for i in label}


def test_quantisation_bound():
    x = np.random.default_rng(2).normal(size=(200, 16))
    q, s, d = embeddings.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    approx = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    assert (np.abs(u @ u.T - approx) <= (1 + d[:, None]) * d[None, :] + d[:, None] + 1e-12).all()


def test_equal_groups_are_dealt_as_by_the_heap():
    r = random.Random(2)
    for _ in range(200):
        n, sizes = r.randrange(1, 6), [r.choice([1, 1, 1, 2, 3, 5, 9, 20, 50]) for _ in range(r.randrange(80))]
        load = [0] * n
        for k, shard in sharding.lpt(dict(enumerate(sizes)), n).items():
            load[shard] += sizes[k]
        got, count = [0] * n, {x: sizes.count(x) for x in sizes}
        for row in sharding.schedule(count.items(), n).itertuples():
            for a, b, shard in zip(row.starts, [*row.starts[1:], count[row.group_size]], row.shards, strict=True):
                got[shard] += (b - a) * row.group_size
        assert got == load


@pytest.mark.parametrize("hot", [1000, 3])
def test_sharding(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(sharding, "HOT", hot)
    rows = [*rows, *rows[:3], (None, "one", "en", "a", 1, "x", "y", "z"), (None, None, "en", "a", 1, "x", "y", "z")]
    got = sharding.shard_documents(docs.sparkSession.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    sizes = {}
    for _, t, *_ in rows:
        sizes[t] = sizes.get(t, 0) + len((t or "").encode()) + 1
    assert sorted((r.doc_id or -1, r.text_crc32, r.size) for r in got) == sorted((i or -1, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows)
    of = {}
    for r in got:
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(of[zlib.crc32((t or "").encode()), len((t or "").encode()) + 1]) == 1 for t in sizes if t)
    load, exact = [sum(r.size for r in got if r.shard == k) for k in range(16)], [0] * 16
    for k, shard in sharding.lpt(dict(enumerate(sizes.values())), 16).items():
        exact[shard] += list(sizes.values())[k]
    assert sorted(load) == sorted(exact)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(16))
    assert sharding.lpt({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_mixing(docs, rows):
    counts = {r.doc_id: r.mix_count for r in mixing.with_counts(docs).collect()}
    assert len(counts) == len(rows)
    out = mixing.mix(docs).collect()
    assert sum(counts.values()) == len(out) and all(sum(r.doc_id == i for r in out) == n for i, n in counts.items())
    assert {r.source for r in mixing.mix(docs, {"a": 1.0}).collect()} == {"a"}


def test_mixing_keeps_columns_and_odd_rows(docs, spark, monkeypatch):
    odd = docs.withColumns({"mix_place": F.lit("p"), "place__x": F.lit(1), "mix_rate": F.lit("old"), "mix_copy": F.lit("old")}).union(docs.limit(2).select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:], F.lit("p"), F.lit(1), F.lit("old"), F.lit("old")))
    out = mixing.mix(odd)
    assert out.columns == [*[c for c in odd.columns if c not in ("mix_rate", "mix_copy")], "mix_rate", "mix_count", "mix_copy"] and {r.mix_place for r in out.collect()} == {"p"}
    key = lambda df: sorted((r.doc_id or -1, r.mix_copy, r.text or "") for r in df.collect())
    one = key(out)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.mix(odd)) == one  # the join over salts gives the same rows


def test_mixing_oracle(spark, tmp_path):
    """The query's SQL on rows whose rates need several draws."""
    import duckdb

    rows = [(k, f"text {k}" * (1 + k % 3), "few" if k < 3 else None if k % 50 == 0 else "many") for k in range(900)] + [(5, None, "many"), (None, "x", "many"), (901, "", "empty")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"select doc_id, source, copy, rate, n_bytes from ({mixing.oracle()})").fetchall()
    got = mixing.query(spark, f"file://{tmp_path}")
    key = lambda x: tuple(str(v) for v in x)
    assert max(r.rate for r in got.collect()) > 60 and sorted(map(tuple, got.select("doc_id", "source", "copy", "rate", "n_bytes").collect()), key=key) == sorted(want, key=key)


def test_poisson_mean(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    n = {r.source: r.n for r in mixing.mix(d).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["x"] - 10000) < 400 and abs(n["y"] - 10000) < 400


def test_poisson_rates_above_one_draw(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") < 20, "few").otherwise("many").alias("source"))
    n = {r.source: r.n for r in mixing.with_counts(d).groupBy("source").agg(F.sum("mix_count").alias("n")).collect()}
    assert abs(n["few"] - 2000) < 200 and abs(n["many"] - 2000) < 200
    got = mixing.with_counts(d, {"few": 1.0}).where("source = 'few'").collect()
    assert {r.mix_rate for r in got} == {200.0} and abs(sum(r.mix_count for r in got) - 4000) < 320 and len({r.mix_count for r in got}) > 5
    huge = d.withColumn("source", F.when(F.col("doc_id") == 0, "few").otherwise("many"))  # a rate of 4000, where exp(-rate) is 0
    assert abs(mixing.with_counts(huge, {"few": 1.0}).where("doc_id = 0").first().mix_count - 4000) < 320


def test_warc(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1#t", 10, "response", "e1", "d1", None, {"Content-Type": "html", "ETag": "e1"}, "body1"), (2, "https://a.com/x?a=1&b=2&utm_source=q", 20, "revisit", "e1", None, None, {"Expires": "9", "Content-Type": "no"}, None),
        (3, "https://a.com/x?a=1&b=2", 30, "response", "e2", "d2", None, {}, "body3"), (4, "https://a.com/x?a=1&b=2", 40, "revisit", None, "d2", None, None, None), (5, "https://a.com/x?a=1&b=2", 50, "revisit", "e1", None, None, {}, None),
        (6, "https://b.com", 5, "revisit", "e", None, None, {}, None), (7, None, 5, "revisit", "e", None, None, {}, None), (8, "https://a.com/x?a=1&b=2", None, "revisit", "e2", None, None, {}, None), (2, "https://a.com/x?a=1&b=2&utm_source=q", 20, "revisit", "e1", None, None, {"Expires": "9", "Content-Type": "no"}, None),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, payload string"), fold_hosts=True).collect()
    assert len(got) == len(rows)
    by = {r.record_id: r for r in got}
    assert (by[2].source_id, by[2].payload, by[2].headers) == (1, "body1", {"Content-Type": "html", "ETag": "e1", "Expires": "9"})
    assert by[4].payload == "body3" and not by[5].resolved and not by[6].resolved and not by[7].resolved and not by[8].resolved and by[3].payload == "body3"


def test_decontamination(spark):
    r = random.Random(2)
    items = [(k, f"{sentence(r, 20, 3000)}. {sentence(r, 9, 3000)}") for k in range(40)] + [(90, None), (91, " "), (92, "tiny one")]
    docs = [(0, sentence(r, 300, 3000)), (1, sentence(r, 500, 3000) + " " + items[7][1].upper() + "!!! " + sentence(r, 90, 3000)), (2, items[3][1]), (3, None), (4, ""), (5, "a tiny one here"), (None, items[3][1]), (2, items[3][1])]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slice_items=16).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 7), (2, 3), (5, 92)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (16, 5, 4096):
        kept = decontaminate.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"), slice_items=n)
        assert sorted(x.doc_id for x in kept.collect()) == [0, 3, 4] and kept.columns == d.columns
    signs = spark.createDataFrame([(1, "!!! ... ???"), (2, None), (3, "")], "item_id long, text string")
    assert decontaminate.find_contamination(d, signs).isEmpty() and decontaminate.drop_contaminated(d, signs).count() == len(docs)
    with pytest.raises(ValueError):
        decontaminate.Index([(1, "some words")], threshold=0)


def test_decontamination_scores_of_any_slices(spark):
    r = random.Random(8)
    items = [(k, f"{sentence(r, 20, 60 if k % 2 else 3000)}. {sentence(r, 9, 60)}") for k in range(50)] + [(90, " "), (91, "!!!"), (92, "tiny one")]
    part = lambda t: " ".join(t.split()[4:])
    docs = spark.createDataFrame([(k, f"{sentence(r, 60, 3000)} {part(t)} {sentence(r, 60, 3000)}") for k, t in items[:50]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, several = (sorted(tuple(x) for x in decontaminate.find_contamination(docs, bench, min_overlap=0.5, slice_items=n).collect()) for n in (4096, 7))
    assert one == several and len(one) >= 40 and any(x[2] < 0.99 for x in one)


@pytest.mark.parametrize("threshold", [0.05, 0.1, 0.25, 0.5, 0.8])
def test_wand_is_exact(threshold):
    r = random.Random(4)
    index = decontaminate.Index([(k, sentence(r, 30, 200)) for k in range(60)], threshold=threshold)
    texts = [sentence(r, 60, 200).encode() for _ in range(40)]
    h, owner, _, _ = words(*join_texts(texts), True)
    got = set(zip(*(x.tolist() for x in index.retrieve(owner, h, len(texts))[:2]), strict=True))
    want = set()
    for p in range(len(texts)):
        mine = set(h[owner == p].tolist())
        for i in range(60):
            score = sum(index.impact[k] for t, term in enumerate(index.terms.tolist()) if term in mine for k in range(index.first[t], index.first[t + 1]) if index.item[k] == i)
            if score >= threshold - 1e-9:
                want.add((p, i))
    assert got == want and (want or threshold > 0.5)


def brute_grams(text):
    folded = bytes(language._FOLD[np.frombuffer(text, np.uint8)])
    return {(n, folded[k : k + n]) for n in range(1, 5) for k in range(len(folded) - n + 1)}


def test_string_kernel(monkeypatch):
    """N-grams, kernel and Nyström map against plain sets; texts longer than a part are cut without losing or adding any."""
    r = random.Random(1)
    texts = [bytes(r.randrange(40, 110) for _ in range(r.randrange(300))) for _ in range(12)] + [b"", b"aaaa" * 50]
    sets = [brute_grams(t) for t in texts]
    for part in (64, 1 << 18):
        monkeypatch.setattr(language, "PART_BYTES", part)
        of, gram = language.grams(texts)
        got = [set() for _ in texts]
        for i, g in zip(of.tolist(), gram.tolist(), strict=True):
            got[i].add((g >> 32, (g & 0xFFFFFFFF).to_bytes(g >> 32, "big")))
        assert got == sets and len(of) == sum(map(len, sets))
        model = language.Model(texts[:5])
        want = np.array([[len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1)) for b in sets[:5]] for a in sets])
        assert np.allclose(model.kernel(texts), want, atol=1e-6)
    rows = [(t, "x" if i % 2 else "y") for i, t in enumerate(texts[:10])]
    fitted = language.fit(rows, landmarks=6)
    order = [t for k in range(5) for t in ([x for x, lang in rows if lang == "x"][k], [x for x, lang in rows if lang == "y"][k])]
    assert (fitted.marks.sum(0) == [len(brute_grams(t)) for t in order[:6]]).all() and fitted.langs == ["x", "y"] and fitted.weights.shape == (7, 2)


def test_vocabulary_of_shared_slots():
    keys = np.random.default_rng(1).integers(0, 1 << 35, 5000).astype(np.uint64)
    v = language.Vocabulary(keys[:3000])
    at = v.places(keys)
    assert (v.keys[at[:3000]] == keys[:3000]).all() and (at[3000:][~np.isin(keys[3000:], keys[:3000])] == -1).all()


def test_language_held_out(spark):
    r = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "ré"], "bb": ["sch", "ung", "ein", "ä"], "cc": ["the", "ing", "ion", "er"]}
    rows = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate(list(syllables) * 40)]
    rows += [(900, None, "aa"), (901, "123 ...", "aa"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(d, d.where("doc_id < 60")).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows if 60 <= i < 900) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}


def test_quality_held_out(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, 150) if i % 3 else "BUY!! NOW!! " * 60 + sentence(r, 30)) for i in range(240)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in quality.score_documents(d, d.where("doc_id < 120").selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) quality")).collect()}
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in range(120, 240)]) > 0.95 and len(got) == len(rows) and all(0 <= x.score <= 1 for x in got.values())


def test_attention_by_loops():
    """The forward pass, passage by passage."""
    r = np.random.default_rng(4)
    m, x, bag = quality.Mil(5, 3), r.normal(size=(6, 5)), np.array([0, 1, 1, 1, 2, 2])
    m.mean, m.scale = r.normal(size=5), r.random(5) + 0.5
    got, p = m.forward(x, bag, 3)[0], m.p
    for k in range(3):
        h = [np.tanh((v - m.mean) / m.scale @ p["E"] + p["e"]) for v in x[bag == k]]
        gate = [np.exp((np.tanh(u @ p["V"]) * (1 / (1 + np.exp(-(u @ p["U"]))))) @ p["w"]) for u in h]
        pooled = sum(g * u for g, u in zip(gate, h, strict=True)) / sum(gate)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(pooled @ p["o"] + p["c"][0]))))


def test_quality_of_long_texts():
    r = random.Random(9)
    m = quality.Mil().fit([sentence(r, 100).encode(), b"BUY! " * 90, b""], [1, 0, 0], steps=20)
    text = "\n".join(sentence(r, r.randrange(1, 30)) + "!  " for _ in range(400)).encode()
    whole = m.score([text])[0]
    for limit in (200, 1000, 7777):
        assert m.score_long(text, limit)[0] == pytest.approx(whole, abs=1e-12)
    cuts, n = quality.passage_cuts(text, 500)
    assert n == len(text.split()) and cuts[0] == 0 and cuts[-1] == len(text) and all(len(text[a:b].split()) % quality.PASSAGE_WORDS == 0 for a, b in zip(cuts[:-2], cuts[1:-1], strict=True))


def test_quality_training_bound(spark):
    d = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "x" * 5000), (3, "good"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert len(quality.train_rows(d, labels, 10, 1000)) <= 10 and not [t for t, _ in quality.train_rows(d, labels, 100, 1000) if len(t) > 1000]
    kept = quality.keep_good(d.withColumn("score", F.lit("mine")), labels.limit(0))
    assert kept.count() == d.count() and kept.columns == ["doc_id", "text", "score"]


def test_gradients():
    r = np.random.default_rng(1)
    m, x, bag, y = quality.Mil(5, 3), r.normal(size=(7, 5)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(m.forward(x, bag, 3)[0]) + (1 - y) * np.log(1 - m.forward(x, bag, 3)[0]))
    g = m.gradients(x, bag, 3, y, np.ones(3))
    for k, p in m.p.items():
        at = np.unravel_index(0, p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6), k


def test_dac_round_trip():
    ids = np.random.default_rng(3).integers(0, 70000, 5000).astype(np.uint32)
    ids[::7] %= 200
    reader = tokenfile.DacReader(tokenfile.dac_encode(ids))
    assert (reader.slice(0, 5000) == ids).all() and (reader.slice(1234, 3210) == ids[1234:3210]).all() and all(reader.get(i) == ids[i] for i in range(0, 5000, 37))
    assert tokenfile.DacReader(tokenfile.dac_encode(ids[:0])).n == 0


def test_token_file(spark, docs, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SEGMENT_TOKENS", 500)
    t = Tokenizer.from_file(tokenfile.tokenizer_path())
    tokenfile.write_tokens(docs.select("doc_id", "text"), f"file://{tmp_path}/out")
    got, start = {r.doc_id: r for r in tokenfile.read_tokens(spark, f"file://{tmp_path}/out").collect()}, 0
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("slots", [16, 1 << 20])
def test_encoder_pieces(slots):
    from tokenizers import Tokenizer

    r = random.Random(1)
    signs = [*"ab é'\n\t ,.1²ªµ ΩßĀ́　ñ's", "<|endoftext|>", "  ", "\n\n", " 's", "don't", "\x1c", "\x85"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    plain = [*"ab é'\n\t ,.1²ªµñsrelvmdt\xa0\x00", " ", "  ", "\n\n", " 's", "'s", "'re", "'ll", "'ve", "''", "\x1c", "\x85", " word" * 3]
    texts += ["".join(r.choice(plain) for _ in range(r.randint(0, 30))) for _ in range(20000)] + ["", "x" * 5000, " " * 700 + "y"]
    t = Tokenizer.from_file(tokenfile.tokenizer_path())
    e = tokenfile.WordEncoder(tokenfile.tokenizer_path(), slots)
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        assert all(np.frombuffer(y, e.kind).tolist() == t.encode(x, add_special_tokens=False).ids for x, y in zip(part, e(part), strict=True))
