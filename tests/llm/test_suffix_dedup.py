"""Removal of repeated strings against a plain version."""

import random

import numpy as np
import pytest

from logsift.llm import suffix_dedup
from tests.llm.conftest import documents


def _plain(rows, length=50):
    """Every string of every document in a dictionary, with the smallest id it starts in."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, data in texts:
        if i is not None:
            for at in range(len(data) - length + 1):
                s = data[at : at + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, data in texts:
        gone = bytearray(len(data))
        if i is not None:
            for at in range(len(data) - length + 1):
                if first[data[at : at + length]] < i:
                    gone[at : at + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", dtype=np.int8)))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        out.append((i, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def _got(rows):
    found = [(r.doc, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in rows.collect()]
    return sorted(found, key=repr)


def test_documents_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = _plain([(r.doc_id, r.text) for r in docs.collect()])
    assert any(spans for _, _, spans, _ in want)
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == ["doc", "n_bytes", "spans", "kept"]
    assert _got(got) == want


@pytest.mark.parametrize("block_bytes", [200, 3000])
def test_runs_of_every_length_and_offset(spark, block_bytes):
    """Passages around the length that counts, at all offsets, in documents whose ids lie across the input."""
    random.seed(block_bytes)

    def noise(n):
        return "".join(random.choice("abcdefgh ü") for _ in range(n))

    passages = [noise(n) for n in (45, 49, 50, 51, 60, 69, 70, 71, 90, 150, 400)]
    rows = []
    for i in range(220):
        text = noise(random.randrange(60))
        for _ in range(random.randrange(4)):
            passage = random.choice(passages)
            start = random.randrange(max(1, len(passage) - 48))
            text += passage[start : start + random.choice([50, 55, 80, 1000])] + noise(random.randrange(40))
        rows.append((random.randrange(300), text))
    rows += [(i, rows[i % 7][1]) for i in range(300, 330)]  # copies
    rows += [rows[3], rows[3], (400, "x" * 500), (401, "x" * 120), (402, "x" * 49)]
    random.shuffle(rows)
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows]).repartition(5)
    assert _got(suffix_dedup.without_repeats(docs, block_bytes=block_bytes)) == _plain(rows)


def test_odd_documents(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id is null or doc_id <> 8").collect()]
    got = suffix_dedup.without_repeats(odd)
    assert got.count() == odd.count()
    assert _got(got.filter("doc is null or doc <> 8")) == _plain(rows)
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_no_table_is_left(spark, small):
    suffix_dedup.without_repeats(spark.read.parquet(f"{small}/documents.parquet").limit(20))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]


def test_other_lengths(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(200))
    rows = [(1, text), (2, text[30:70]), (3, text[30:61]), (4, "y" + text[10:42] + "z")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    got = suffix_dedup.without_repeats(docs, length=32, period=7, cover=(1, 2, 4))
    assert _got(got) == _plain(rows, 32)
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(docs, length=32, period=7, cover=(1, 2))


def test_keys_on_their_way():
    random.seed(5)
    for n in (1, 2, 1000):
        keys = np.sort(np.array([random.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        assert (suffix_dedup.unpacked(suffix_dedup.packed(keys)) == keys).all()
