"""Vector searches and the licence scan against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import types as T

from logsift.llm import block_topk, license_scan, queries, tile_search

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("rank", T.StringType()),
        T.StructField("vector", T.StringType()),
    ]
)
NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def _usable(vector):
    return bool(vector) and all(x is not None and np.isfinite(x) for x in vector)


def _plain(rows, every, k, score, best_low, skip_zero):
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and _usable(v)})
    rows = [(i, v) for i, v in rows if not skip_zero or any(v)]
    out = []
    for query in sorted({i for i, _ in rows if i % every == 0}):
        own = min(v for i, v in rows if i == query)
        found = {(score(own, v), i) for i, v in rows if i != query and len(v) == len(own)}
        ranked = sorted(found, key=lambda x: (x[0] if best_low else -x[0], x[1]))[:k]
        out += [(query, n + 1, i, s) for n, (s, i) in enumerate(ranked)]
    return out


def _distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return float(np.sqrt(total))


def _product(a, b):
    return sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b))


def _rows(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def _odd_vectors():
    random = np.random.default_rng(3)
    rows = [(i, random.normal(0, 0.2, 6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 420)]  # one vector many times
    rows += [rows[20], rows[20], rows[7]]  # repeated rows
    rows += [(500, None), (600, []), (700, [0.0] * 6), (800, [None] * 6), (900, [NAN] + [1.0] * 5)]
    rows += [(901, [INF] * 6), (None, [1.0] * 6), (1000, [1.0, 2.0]), (1001, [1.0, 2.5]), (1100, [3.0])]
    return rows


def test_nearest_equals_plain_search(spark):
    rows = _odd_vectors()
    got = _rows(tile_search.nearest(_vectors(spark, rows)))
    assert got == _plain(rows, 100, 10, _distance, True, True)


def test_top_products_equal_plain_search(spark):
    rows = _odd_vectors()
    got = _rows(block_topk.top_products(_vectors(spark, rows)))
    assert got == _plain(rows, 20, 20, _product, False, False)


def test_large_components_are_exact(spark):
    random = np.random.default_rng(6)
    rows = [(i, (random.normal(0, 1, 5) * 10.0 ** random.integers(0, 8)).tolist()) for i in range(200)]
    rows += [(300, [5.0e6, 0.0, 1.0, 0.0, 0.0]), (301, [5.0e6, 0.0, 1.0, 0.0, 1.0]), (320, [1e7, -1e7, 1e7, 3.0, 0.1])]
    rows += [(340, [0.0, 0.0, 0.0, 1e12, 0.0]), (341, [0.0, 0.0, 0.0, 2.5, 7.0])]
    plain = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in rows]
    got = _rows(block_topk.top_products(_vectors(spark, rows)))
    assert got == _plain(plain, 20, 20, _product, False, False)
    assert max(s for *_, s in got) > 2**53


def test_scores_beyond_64_bits_are_an_error():
    tile = block_topk.TopTile(np.array([0]), np.array([[1e12, 1e12]]), 2)
    with pytest.raises(OverflowError):
        tile.scan(np.array([1]), np.array([[1e12, 1.0]]))
    with pytest.raises(OverflowError):
        tile.scan(np.array([1]), np.array([[1e307, 1.0]]))
    tile.scan(np.array([1]), np.array([[0.0, 3.0]]))
    assert tile.best()[2].tolist() == [64 * 10**12 * 192]


def test_searches_of_few_and_no_vectors(spark):
    few = _vectors(spark, [(100, [1.0, 0.0]), (3, [0.5, 0.5]), (200, [1.0, 0.0])])
    assert len(_rows(tile_search.nearest(few))) == 4
    assert len(_rows(block_topk.top_products(few))) == 4
    none = _vectors(spark, [])
    assert _rows(tile_search.nearest(none)) == [] == _rows(block_topk.top_products(none))


def test_error_bounds_hold():
    random = np.random.default_rng(8)
    a, b = random.normal(size=(50, 64)), random.normal(size=(70, 64)) * 3
    low, high = tile_search.NearestTile(np.arange(50), a, 5)._bounds(tile_search.Quantised(b))
    true = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    assert ((high - low) / true).max() < 0.2


def test_pruning_skips_ranges():
    scored = []

    class Watched(block_topk.TopTile):
        def _product(self, left, right):
            scored.append(len(right))
            return super()._product(left, right)

    random = np.random.default_rng(1)
    data = random.normal(0, 1, (4096, 8)) * np.linspace(0.01, 3, 4096)[:, None]
    tile = Watched(np.array([0]), data[-1:], 5)
    tile.scan(np.arange(4096), data)
    assert sum(scored) < 4096 / 2


def test_searches_over_the_given_vectors(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    near = _rows(queries.op6_block_matrix_neighbours(spark, small))
    assert near == _plain(rows, 100, 10, _distance, True, True)
    top = _rows(queries.op10_block_top_k(spark, small))
    assert top == _plain(rows, 20, 20, _product, False, False)


# --- licences ----------------------------------------------------------------------------------

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = PLAIN_WORD.findall(lower)
    places = []
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def test_base_phrases_of_all_documents(spark, odd, nothing, small):
    given = spark.read.parquet(f"{small}/documents.parquet")
    for docs in (given, odd):
        texts = [r.text for r in docs.select("text").collect()]
        got = license_scan.scan(docs).collect()
        assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [
            _plain_base(t) for t in texts
        ]
        for r in got:
            assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
            assert 0 <= r.score <= 1
    assert license_scan.scan(nothing).count() == 0
    assert queries.op7_license_scan(spark, small).count() == given.count()


def test_notices_need_their_place_and_their_phrases():
    index = license_scan.Index(100, {})
    for label, (text, _) in license_scan.TEMPLATES.items():
        found = license_scan.scan_text(index, f"Copyright 2020 by someone.\n{text.upper()}.\nrest of file")
        assert label in found[5].split(",") and found[6] == 1.0
    words = license_scan.TEMPLATES["mit"][0].split()
    assert "mit" not in license_scan.scan_text(index, " ".join(sorted(words)))[5]
    changed = " ".join(words).replace("free of charge", "free as beer")
    assert "mit" not in license_scan.scan_text(index, changed)[5]


def test_phrases_over_the_pieces_of_a_long_text():
    index = license_scan.Index(100, {})
    filler = "lorem ipsum " * 90_000  # over one piece of text
    notice = license_scan.TEMPLATES["apache-2.0"][0]
    for shift in range(0, 60, 7):
        text = filler[: (1 << 20) - 40 + shift] + " all rights reserved " + notice + " cc by " + filler
        found = license_scan.scan_text(index, text)
        assert found[:5] == _plain_base(text) and "apache-2.0" in found[5]
