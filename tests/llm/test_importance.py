"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logsift.llm import importance
from tests.llm.conftest import documents


def _features(text):
    plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _plain(rows, target, percent=5):
    corpus, aim = Counter(), Counter()
    found = [(_id, *_features(text)) for _id, text in rows]
    for _, _, buckets in found:
        corpus.update(buckets)
    for text in target:
        aim.update(_features(text)[1])
    big, aims = sum(corpus.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log((aim[b] + 1) * (big + 10_000) / ((corpus[b] + 1) * (aims + 10_000))))

    out = []
    for _id, n_words, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if _id is None else _id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([_id, n_words, len(buckets), weight, score, None])
    order = sorted(
        (r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] if r[0] is not None else 0, r[2])
    )
    for i, row in enumerate(order[: len(order) * percent // 100]):
        row[5] = i + 1
    return sorted((tuple(r) for r in out), key=repr)


def _got(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_documents_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resampled(docs, target)
    assert got.columns == ["doc", "n_words", "n_features", "weight", "score", "rank"]
    assert _got(got) == _plain(rows, [r.text for r in target.collect()])


def test_odd_documents(spark, odd, nothing):
    target = spark.createDataFrame([("The Quick brown fox",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for percent in (5, 60, 100):
        got = importance.resampled(odd, target, percent)
        assert _got(got) == _plain(rows, ["The Quick brown fox", None, ""], percent)
    assert _got(importance.resampled(odd, target.limit(0))) == _plain(rows, [])
    assert importance.resampled(nothing, target).count() == 0


def test_many_ties_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(i % 40 if i % 9 else None, text) for i in range(400)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    target = spark.createDataFrame([(text,)], "text string")
    got, want = importance.resampled(docs, target), _plain(rows, [text])
    assert _got(got) == want and got.filter("rank is not null").count() == 20


def test_bracket_is_proven_or_widened(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("score"))
    every = sorted((r.score for r in rows.collect()), reverse=True)
    for accuracy in (4, 50, 5000):  # a poor sketch misses, and the bracket grows until counts prove it
        for k in (1, 999, 20_000):
            found = importance.bracket(rows, k, 20_000, accuracy)
            assert found.low <= every[k - 1] <= found.high
            assert found.above == sum(s > found.high for s in every)
            assert found.inside == sum(found.low <= s <= found.high for s in every)
    assert importance.bracket(rows, 1000, 20_000).inside < 200


def test_checksums_of_joined_strings():
    sums, random = importance.Checksums(), np.random.default_rng(3)
    words = [random.bytes(int(n)) for n in [*range(1, 300), 5000, 70_000]]
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    length = np.array([len(w) for w in words])
    ends = np.full(len(words), len(words))
    for size, (at, got) in enumerate(sums.runs(crc, length, ends), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i : i + size])) for i in at]
        assert len(at) == len(words) - size + 1


def test_words_of_a_slice():
    texts = pa.array(["skip", "A-b Ünïcödé 中文 x9", None, ""])
    begins, found = importance.features(texts.slice(1), importance.Checksums(), 10_000)
    assert begins.tolist() == [0, 5, 5, 5] and [len(at) for at, _ in found] == [5, 4, 3]
