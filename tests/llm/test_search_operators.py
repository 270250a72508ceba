"""Lexical search, resampling and neighbours: SQL, brute force, ties, odd rows and empty tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs  # noqa: F401
from rasterloom.llm import hash_neighbours, lexical_search, queries, resample

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("key", ["op11_lexical_search", "op12_resample"])
def test_sql(spark, con, key):
    oracle.compare(con, queries.QUERIES[key](spark, SF), queries.ORACLES[key])


# lexical search


def brute_search(docs, items, k=10):
    """Plain form over (doc_id, text) and (item_id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [(i, Counter(split(t)), len(split(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in tf), sum(n for *_, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(split(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c, n in tf:
            m = 100 - 75 + 75 * n * n_docs // max(total, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if t in c)
            if s > 0 and doc is not None:
                scored.append((-s, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


ODD_TEXTS = [
    (1, "Über über ÜBER x_y 12 a-b"), (2, None), (3, ""), (4, "--- ..."), (5, "dup one two"), (5, "dup one two"), (6, "dup one two"),
    (None, "dup hidden"), (7, "one " * 5000), (8, "漢字 one\x00two\u0085three\ttwo"), (9, "İstanbul K kelvin"),
]


def test_search_odd_rows(spark):
    items = [(1, "über x 12"), (2, None), (3, "dup one one"), (3, "two"), (None, "one"), (4, "..."), (5, "two\u0085three 漢字 a b"), (6, "nowhere")]
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id bigint, text string").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0)))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_search(ODD_TEXTS, items)
    assert lexical_search.search(docs.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert lexical_search.search(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0)).count() == 0


def test_search_in_blocks_of_items(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, lexical_search.search(docs, items).collect()))
    for name, value in (("BLOCK_CHARS", 5000), ("CELLS", 100), ("HELD", 50)):
        monkeypatch.setattr(lexical_search, name, value)
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == whole
    assert whole == brute_search(list(docs.select("doc_id", "text").toLocalIterator()), list(items.select("item_id", "text").toLocalIterator()))


def test_terms_end_at_their_borders():
    block = lexical_search.Block([(1, "he hers she x")])
    assert {block.terms[t]: n for t, n in block.scan(b"she he, hers! ushers HE-x x")[1].items()} == {"she": 1, "he": 2, "hers": 1, "x": 2}


# resampling


def brute_draw(docs, target, percent=10, least=20, grams=1):
    def feats(t):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    own = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in feats(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows, able = [], []
    for at, (i, n, f) in enumerate(own):
        weight, score = sum(map(gain, f)), None
        if i is not None:
            h = int(sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                able.append((-score, i, at))
        rows.append([i, len(f), weight, score, None])
    k = min(percent * sum(n >= least for _, n, _ in own) // 100, len(able))
    for r, (*_, at) in enumerate(sorted(able)[:k], 1):
        rows[at][4] = r
    return sorted(map(str, map(tuple, rows)))


def drawn(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("few,grams", [(4096, 1), (3, 2)])
def test_draw(spark, monkeypatch, few, grams):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").repartition(7) for t in ("documents", "benchmark"))
    monkeypatch.setattr(resample.cutoff, "__defaults__", (few,))
    plain = brute_draw(list(docs.select("doc_id", "text").toLocalIterator()), [r.text for r in items.toLocalIterator()], 35, 5, grams)
    assert drawn(resample.draw(docs, items, 35, 5, grams)) == plain


def test_draw_odd_rows(spark):
    texts = [*ODD_TEXTS, *[(20, "w " * 30)] * 6, (21, "one " * 40), (None, "one " * 25)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("weight", F.lit("w")).withColumn("rank", F.lit("r"))
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id bigint, text string")
    for percent in (0, 10, 50, 100):
        assert drawn(resample.draw(docs, items, percent)) == brute_draw(texts, ["one two", None], percent)
    assert drawn(resample.draw(docs, items.limit(0))) == brute_draw(texts, [])
    assert drawn(resample.draw(docs.limit(0), items)) == []


@pytest.mark.parametrize("few", [1, 5])
def test_cutoff_is_the_place(spark, few):
    pick = np.random.default_rng(4)
    keys = [(int(s), int(i)) for s, i in zip(pick.integers(-9, 9, 400), pick.permutation(400))] + [(3, 7)] * 150
    df = spark.createDataFrame(keys, "score bigint, doc_id bigint").repartition(6)
    ranked = sorted((-s, i) for s, i in keys)
    for k in (1, 2, 100, 275, len(keys)):
        s, i = ranked[k - 1]
        assert resample.cutoff(df, k, few) == (-s, i, ranked.index((s, i)))


def test_weighted_median_has_half_on_each_side():
    assert resample.weighted_median([(1, 5, 0), (1, 4, 0), (10, 1, 3), (1, 9, 9)]) == (1, 3)
    assert resample.weighted_median([(2, 5, 2), (2, 5, 1)]) == (5, 1)


# neighbours


def brute_near(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, y in ok:
        if q in asked:
            scored = sorted((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, x in ok if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def close(got, want):
    got = sorted(map(tuple, got.collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def recall(got, want):
    found = {(q, v) for q, _, v, _ in map(tuple, got.collect())}
    return sum((q, v) in found for q, _, v, _ in want) / len(want)


def test_neighbours_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = hash_neighbours.neighbours(vectors, vectors.filter("vec_id % 5 = 0")).cache()
    rows = [(r.vec_id, r.embedding) for r in vectors.toLocalIterator()]
    assert recall(got, brute_near(rows, {i for i, _ in rows if i % 5 == 0}, 5)) >= 0.95
    by_id = {i: np.array(v, float) for i, v in rows}
    for q, rank, v, s in map(tuple, got.collect()):
        assert 1 <= rank <= 5 and q != v
        assert abs(s - by_id[q] @ by_id[v] / np.linalg.norm(by_id[q]) / np.linalg.norm(by_id[v])) < 1e-12


def test_neighbours_in_many_shards_and_without_radius(spark, monkeypatch):
    pick = np.random.default_rng(2)
    rows = [(i, [float(x) for x in pick.normal(size=24)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(hash_neighbours, "SHARD_LEAST", 40)
    monkeypatch.setattr(hash_neighbours, "BLOCK", 9)
    want = brute_near(rows, {i for i, _ in rows if i % 7 == 0}, 5)
    monkeypatch.setattr(hash_neighbours, "measure", lambda *a: 24 * hash_neighbours.ROTATIONS)
    close(hash_neighbours.neighbours(df, df.filter("vec_id % 7 = 0")), want)
    # no code within the radius: every query is asked again over all rows
    monkeypatch.setattr(hash_neighbours, "measure", lambda *a: 0)
    close(hash_neighbours.neighbours(df, df.filter("vec_id % 7 = 0")), want)


def test_probing_misses_no_code_within_the_radius():
    pick = np.random.default_rng(5)
    codes = hash_neighbours.Codes(np.zeros((40, 80)), np.array([0, 16, 32, 48, 64, 80]))
    bits = pick.integers(0, 2, (500, 80), dtype=np.uint8)
    bits[100:200] = bits[:100] ^ (pick.random((100, 80)) < 0.1)
    asked, index = bits[:60], hash_neighbours.Index(codes, bits)
    for radius in (0, 3, 5, 11, 24, 35, 80):
        for q, place in zip(asked, index.within(asked, radius)):
            assert place.tolist() == np.flatnonzero((bits != q).sum(axis=1) <= radius).tolist()


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, [-1.0, 0.0, 0.0]),
        (6, None), (7, [0.0, 0.0, 0.0]), (8, [1.0, nan, 0.0]), (9, [1.0, inf, 0.0]), (10, [0.0, 0.0, 3.0]),
    ]
    extra = [(11, [1.0, None, 0.0]), (12, [1.0]), (None, [1.0, 0.0, 0.0]), (13, []), rows[3], rows[3]]
    df = spark.createDataFrame(rows + extra, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    want = brute_near(rows, {0, 5, 10}, 5)
    close(hash_neighbours.neighbours(df, df.filter("vec_id % 5 = 0")), want)
    assert hash_neighbours.neighbours(df.limit(0), df).count() == 0
    assert hash_neighbours.neighbours(df, df.limit(0)).count() == 0
    assert hash_neighbours.neighbours(df.filter("vec_id = 3"), df.filter("vec_id = 3")).count() == 0


def test_repeated_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.1]), (1, [0.2, 1.0]), (1, [1.0, 0.0]), (2, [0.9, 0.3]), (3, [-1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r)[:3] for r in hash_neighbours.neighbours(df, df.filter("vec_id < 2"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2)]


def test_odd_documents(spark, odd_docs, no_docs):  # noqa: F811
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    assert lexical_search.search(odd_docs, items).count() > 0
    assert resample.draw(odd_docs, items).count() == odd_docs.count()
    assert lexical_search.search(no_docs, items).count() == resample.draw(no_docs, items).count() == 0
