"""Removal of repeated strings: every byte that a string of a given length covers which also starts in
a document with a smaller id.

The suffixes of all texts are compared by their first `length` bytes. They are dealt into buckets, and one
bucket at a time is sorted by one task. Most suffixes never get there: a difference cover says which.
Of every `period` places in a row a few are in the cover, chosen so that two places of any two
texts have an offset below the period at which both are in it. So suffixes that tie over
`length` bytes tie at a cover place over the `length - period + 1` bytes that follow it. The cover places
alone are ranked first: those of a string that stands once get no rank, and only suffixes with a ranked cover
place within the period can have a long tie; only these are sorted.

Texts are packed into blocks of neighbouring ids, one compressed row each, in a table bucketed by block.
Every step meets a block with what is known about it without moving the texts again. A block sends
each string once, as a digest, and gets back one bit for it; digests are sorted, so that neighbours differ
in few bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import (
    bucket_edges,
    deleted,
    discarded,
    expanded,
    free_shuffles,
    give_back_memory,
    mixed,
    risen,
    rising,
    small_batches,
    squeezed,
    written,
)
from logsift.session import fresh_folder

LENGTH = 50
# A perfect difference set: every difference but 0 modulo PERIOD is one of two of its members, once.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
# A block closes at this many bytes; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
# Suffixes that one task sorts at a time, about, in bytes of text.
BUCKET_BYTES = 64 << 20
# Kinds of what is known about a block.
COPIES, RANKED, EARLIER = 0, 1, 2
KNOWN = "block bigint, kind int, bucket int, data binary, places array<int>"
SENT = "bucket int, block bigint, data binary"


# --- digests on their way ----------------------------------------------------------------------------


def packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as bytes."""
    return squeezed(rising(keys))


def unpacked(data: bytes) -> np.ndarray:
    return risen(expanded(data)[0])


def _sent(block: int, keys: np.ndarray, buckets: int) -> pa.Table:
    edges = bucket_edges(keys, buckets)
    full = np.flatnonzero(np.diff(edges))
    return pa.table(
        {
            "bucket": pa.array(full.astype(np.int32)),
            "block": pa.array(np.full(full.size, block)),
            "data": pa.array([packed(keys[edges[b] : edges[b + 1]]) for b in full.tolist()], pa.binary()),
        }
    )


def _answers(blocks: list[int], bucket: int, kind: int, bits: list[np.ndarray]) -> pa.Table:
    """One bit for each key that was sent; nothing where none is set."""
    some = [i for i, b in enumerate(bits) if b.any()]
    return pa.table(
        {
            "block": pa.array([blocks[i] for i in some], pa.int64()),
            "kind": pa.array([kind] * len(some), pa.int32()),
            "bucket": pa.array([bucket] * len(some), pa.int32()),
            "data": pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()),
            "places": pa.nulls(len(some), pa.list_(pa.int32())),
        }
    )


# --- blocks --------------------------------------------------------------------------------------------


class Block:
    """Texts of neighbouring ids, one after the other."""

    def __init__(self, row: pa.Table, known: pa.Table, length: int, period: int, cover: tuple[int, ...]):
        self.length, self.period, self.cover = length, period, cover
        self.name = row.column("block")[0].as_py()
        self.docs = np.frombuffer(row.column("docs")[0].as_py(), dtype="<i8")
        self.sizes = np.frombuffer(row.column("sizes")[0].as_py(), dtype="<i8")
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.total = int(self.begins[-1])
        text = pa.decompress(row.column("payload")[0].as_py(), self.total, codec="zstd", asbytes=True)
        self.bytes = np.frombuffer(text + bytes(8), dtype=np.uint8)
        self.words = np.ndarray((self.total + 1,), "<u8", buffer=self.bytes.data, strides=(1,))
        # equal ids are one document; a smaller id has a smaller number
        self.order = np.cumsum(np.diff(self.docs, prepend=self.docs[:1]) != 0)
        self.later = np.zeros(self.docs.size, dtype=bool)  # copies of documents with smaller ids
        kinds = known.column("kind").to_pylist()
        self.bits: dict[int, dict[int, bytes]] = {RANKED: {}, EARLIER: {}}
        for i, kind in enumerate(kinds):
            if kind == COPIES:
                self.later[known.column("places")[i].as_py()] = True
            else:
                self.bits[kind][known.column("bucket")[i].as_py()] = known.column("data")[i].as_py()
        # what is left of its document at each place; nothing of copies
        ends = np.where(self.later, -1, self.begins[1:])
        self.left = np.repeat(ends, self.sizes) - np.arange(self.total)

    def digests(self, at: slice | np.ndarray, size: int) -> np.ndarray:
        """Digests of so many bytes from the given places."""
        key = np.full(1, size, dtype=np.uint64)
        for back in (*range(0, size - 8, 8), size - 8):
            if isinstance(at, slice):
                word = self.words[at.start + back : at.stop + back : at.step]
            else:
                word = self.words[at + back]
            key = mixed((key ^ word) + np.uint64(0x9E3779B97F4A7C15))
        return key

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cover and digests of what follows them."""
        size = self.length - self.period + 1
        places, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for first in self.cover:
            at = np.arange(first, self.total - size + 1, self.period)
            if at.size:
                whole = self.left[at] >= size
                # a bucket and 32 bits below it: two strings taken for one only add to what is sorted
                key = self.digests(slice(first, int(at[-1]) + 1, self.period), size)[whole]
                keys.append(key & np.uint64(0xFFFFFFFFFF000000))
                places.append(at[whole])
        return np.concatenate(places), np.concatenate(keys)

    def answered(self, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
        """The bits that came back for ascending keys."""
        out = np.zeros(keys.size, dtype=bool)
        edges = bucket_edges(keys, buckets)
        for bucket, data in self.bits[kind].items():
            start, stop = int(edges[bucket]), int(edges[bucket + 1])
            out[start:stop] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=stop - start)
        return out

    def suffixes(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with a ranked cover place within the period, and digests of the strings there."""
        places, keys = self.samples()
        distinct, group, counts, _ = _grouped(keys)
        ranked = self.answered(RANKED, distinct, buckets) | (counts > 1)
        before = np.zeros(self.total + self.period + 1, dtype=np.int32)
        before[places[ranked[group]] + 1] = 1
        before = np.cumsum(before, dtype=np.int32)
        near = before[self.period : self.period + self.total] > before[: self.total]
        at = np.flatnonzero(near & (self.left >= self.length))
        return at, self.digests(at, self.length)

    def repeated(self, buckets: int) -> np.ndarray:
        """Whether each byte is covered by a string that starts in a document with a smaller id."""
        at, keys = self.suffixes(buckets)
        distinct, group, _, order = _grouped(keys)
        own = np.repeat(self.order, self.sizes)[at]
        first = np.zeros(0, dtype=own.dtype)
        if at.size:
            heads = np.flatnonzero(np.diff(group[order], prepend=-1))
            first = np.minimum.reduceat(own[order], heads)
        again = self.answered(EARLIER, distinct, buckets)[group] | (own > first[group])
        edges = np.zeros(self.total + 1, dtype=np.int32)
        edges[at[again]] += 1
        edges[at[again] + self.length] -= 1
        covered = np.cumsum(edges[:-1]) > 0
        return covered | np.repeat(self.later & (self.sizes >= self.length), self.sizes)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending; the place of each key among them; how often each occurs; the order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(keys.size, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    group = np.empty(keys.size, dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return ordered[heads], group, np.diff(np.append(heads, keys.size)), order


def pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, part, last, held, docs, sizes, payload) of docs (doc, text binary), in the order of ids in each part.

    A block is named by its first id. Rows with one id are in one block.
    """
    small_batches(docs.sparkSession)
    names = ["block", "part", "last", "held", "docs", "sizes", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        docs: list[int] = []
        texts: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal docs, texts, held
            values = [
                pa.array([docs[0]], pa.int64()),
                pa.array([part], pa.int32()),
                pa.array([docs[-1]], pa.int64()),
                pa.array([held], pa.int64()),
                pa.array([np.array(docs, dtype="<i8").tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], dtype="<i8").tobytes()], pa.binary()),
                pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary()),
            ]
            docs, texts, held = [], [], 0
            return pa.RecordBatch.from_arrays(values, names)

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                if held >= block_bytes and doc != docs[-1]:
                    yield closed()
                docs.append(doc)
                texts.append(text)
                held += len(text)
        if docs:
            yield closed()
        give_back_memory()

    return docs.sortWithinPartitions("doc").mapInArrow(
        run, "block bigint, part int, last bigint, held bigint, docs binary, sizes binary, payload binary"
    )


def _in_order(blocks: DataFrame) -> bool:
    """Whether no id of one part lies between those of another; one row a part comes to the driver."""
    spans = blocks.groupBy("part").agg(F.min("block").alias("first"), F.max("last").alias("last")).collect()
    spans = sorted((r["first"], r["last"]) for r in spans)
    return all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


class _Blocks:
    """The table of blocks, and steps that meet each block with what is known about it."""

    def __init__(self, docs: DataFrame, block_bytes: int, options: tuple):
        self.spark, self.options = docs.sparkSession, options
        self.parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self._save(pack(docs, block_bytes))
        if not _in_order(self.table):
            # ids lie across the input: only then texts are moved
            self.drop()
            self._save(pack(docs.repartitionByRange(self.parts, "doc"), block_bytes))
        held = self.table.agg(F.sum("held")).first()[0] or 0
        self.buckets = max(2 * self.parts, -(-held // BUCKET_BYTES))

    def _save(self, blocks: DataFrame) -> None:
        """A table dealt by block, so that meeting it by block moves nothing of it."""
        self.name, self.path = f"blocks_{uuid.uuid4().hex}", fresh_folder(self.spark, "blocks")
        blocks.write.bucketBy(self.parts, "block").option("path", self.path).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        deleted(self.spark, self.path)

    def met(self, known: DataFrame, work: Callable[[Block], pa.Table], schema: str) -> DataFrame:
        options = self.options

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = work(Block(left, right, *options))
            give_back_memory()
            return found

        rows = self.table.select("block", "docs", "sizes", "payload")
        return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def _copies(blocks: DataFrame, length: int) -> DataFrame:
    """What is known of whole texts: places in their block of those that a smaller id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = np.frombuffer(batch.column("docs")[i].as_py(), dtype="<i8")
                sizes = np.frombuffer(batch.column("sizes")[i].as_py(), dtype="<i8")
                begins = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                text = memoryview(pa.decompress(batch.column("payload")[i].as_py(), begins[-1], codec="zstd"))
                at = np.flatnonzero(sizes >= length)
                keys = [xxhash.xxh3_128_digest(text[begins[n] : begins[n + 1]]) for n in at.tolist()]
                halves = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                columns = [np.full(at.size, batch.column("block")[i].as_py()), at.astype(np.int32), docs[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*columns, halves[:, 0], halves[:, 1])], ["block", "place", "doc", "k1", "k2"]
                )

    shape = "block bigint, place int, doc bigint, k1 bigint, k2 bigint"
    texts = blocks.select("block", "docs", "sizes", "payload").mapInArrow(run, shape)
    firsts = (
        texts.groupBy("k1", "k2")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("final"))
        .filter("first < final")
    )
    later = texts.join(firsts, ["k1", "k2"]).filter("doc > first")
    found = later.groupBy("block").agg(F.collect_list("place").alias("places"))  # at most a block's documents
    return found.select(
        "block", F.lit(COPIES).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("data"), "places"
    )


def _shared(rows: pa.Table) -> pa.Table:
    """Ranks of one bucket of cover places: a bit for each string that more than one block has."""
    sent = [unpacked(d) for d in rows.column("data").to_pylist()]
    every = np.sort(np.concatenate(sent))
    twice = every[1:][every[1:] == every[:-1]]
    bits = [_within(keys, twice) for keys in sent]
    return _answers(rows.column("block").to_pylist(), rows.column("bucket")[0].as_py(), RANKED, bits)


def _earlier(rows: pa.Table) -> pa.Table:
    """One bucket of suffixes, sorted: a bit for each string that a block of smaller ids has too."""
    blocks = rows.column("block").to_pylist()
    order = sorted(range(len(blocks)), key=blocks.__getitem__)
    sent = [unpacked(rows.column("data")[i].as_py()) for i in order]
    every = np.sort(np.concatenate(sent))
    twice = every[1:][every[1:] == every[:-1]]
    several = [_within(keys, twice) for keys in sent]
    # only strings of several blocks are looked at block by block
    keys = np.concatenate([k[s] for k, s in zip(sent, several)])
    by_key = np.argsort(keys, kind="stable")  # blocks stay in their order
    first = np.ones(keys.size, dtype=bool)
    first[1:] = keys[by_key][1:] != keys[by_key][:-1]
    again = np.empty(keys.size, dtype=bool)
    again[by_key] = ~first
    bits = []
    for part, mask in zip(np.split(again, np.cumsum([s.sum() for s in several])[:-1]), several):
        out = np.zeros(mask.size, dtype=bool)
        out[mask] = part
        bits.append(out)
    return _answers([blocks[i] for i in order], rows.column("bucket")[0].as_py(), EARLIER, bits)


def _within(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    if not members.size:
        return np.zeros(keys.size, dtype=bool)
    return members[np.minimum(np.searchsorted(members, keys), members.size - 1)] == keys


def _cut(block: Block, covered: np.ndarray) -> pa.Table:
    """What is removed of every document of a block, and what is left."""
    opens = np.zeros(block.total + 1, dtype=bool)  # where a document begins, and the end
    opens[block.begins] = True
    beyond = np.concatenate([[False], covered, [False]])
    starts = np.flatnonzero(covered & (opens[:-1] | ~beyond[:-2]))
    stops = np.flatnonzero(covered & (opens[1:] | ~beyond[2:])) + 1
    owner = np.searchsorted(block.begins, starts, side="right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(starts - block.begins[owner]), pa.array(stops - block.begins[owner])], ["start", "stop"]
    )
    offsets = np.searchsorted(owner, np.arange(block.docs.size + 1)).astype(np.int32)
    left = np.concatenate([[0], np.cumsum(~covered)])[block.begins].astype(np.int64)
    kept = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        block.docs.size,
        [None, pa.py_buffer(left.tobytes()), pa.py_buffer(block.bytes[: block.total][~covered].tobytes())],
    )
    return pa.table(
        {
            "doc": pa.array(block.docs),
            "n_bytes": pa.array(block.sizes),
            "spans": pa.ListArray.from_arrays(pa.array(offsets), spans),
            "kept": kept.cast(pa.binary()),
        }
    )


def _covers(period: int, cover: tuple[int, ...]) -> bool:
    """Whether every difference modulo the period is one of two places of the cover."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc, n_bytes, spans, kept) of every row of docs.

    spans are the removed runs (start, stop) in bytes of the UTF-8 text, kept is what is left, which may
    be cut within a character. Matches stay within documents and are judged on the whole input. A null
    text is empty; texts shorter than length lose nothing. Rows with one id are one document as far as
    order goes: they don't remove each other's strings. A row without an id has no place in the order: it
    loses nothing and removes nothing. Repeated rows come back as often as they occur. The memory a
    task takes follows the block or, if that is longer, the longest document.

    Strings are told apart by digests of 64 bits; n of them meet by chance n * n / 2**65 times.
    """
    spark = docs.sparkSession
    if length - period + 1 < 8 or not _covers(period, cover):
        raise ValueError("the cover does not fit the length")
    slim = docs.select(
        F.col(id_column).cast("bigint").alias("doc"),
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
    )
    named = slim.filter("doc is not null")
    options = (length, period, cover)
    blocks = _Blocks(named, block_bytes, options)
    buckets = blocks.buckets
    copies = written(_copies(blocks.table, length), "copies")

    def cover_places(block: Block) -> pa.Table:
        return _sent(block.name, np.unique(block.samples()[1]), buckets)

    def suffixes(block: Block) -> pa.Table:
        return _sent(block.name, np.unique(block.suffixes(buckets)[1]), buckets)

    sent = blocks.met(copies, cover_places, SENT)
    ranked = written(sent.groupBy("bucket").applyInArrow(_shared, KNOWN), "ranked")
    free_shuffles(spark)
    sent = blocks.met(copies.unionByName(ranked), suffixes, SENT)
    earlier = written(sent.groupBy("bucket").applyInArrow(_earlier, KNOWN), "earlier")
    free_shuffles(spark)

    def cut(block: Block) -> pa.Table:
        return _cut(block, block.repeated(buckets))

    known = copies.unionByName(ranked).unionByName(earlier)
    shape = "doc bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    found = written(blocks.met(known, cut, shape), "without-repeats")
    discarded(copies, ranked, earlier)
    blocks.drop()
    unnamed = slim.filter("doc is null").select(
        "doc",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
        F.col("text").alias("kept"),
    )
    return found.unionByName(unnamed)


# The same by all strings of the length, for a second engine; bytes as two hex digits.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (  -- a thousand bytes at a time, as a place in a long string is found by counting
  SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS c
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d)
), p AS (
  SELECT doc_id, 1000 * k + j AS i, substr(c, 2 * j + 1, 100) AS s
  FROM (SELECT doc_id, k, c, unnest(range(0, len(c) // 2 - 49)) AS j FROM c)
), f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s),
hits AS (SELECT doc_id, i FROM p JOIN f USING (s) WHERE least < doc_id),
edges AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new
  FROM hits
), runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
borders AS (
  SELECT doc_id, b AS low FROM spans UNION ALL SELECT doc_id, 0 FROM d
), pieces AS (
  SELECT doc_id, low, coalesce(min(a), -1) AS high
  FROM borders LEFT JOIN spans USING (doc_id) WHERE a >= low OR a IS NULL GROUP BY doc_id, low
  UNION ALL
  SELECT doc_id, max(low), -1 FROM borders GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN high < 0 THEN substr(h, 2 * low + 1)
                                 ELSE substr(h, 2 * low + 1, 2 * (high - low)) END, '' ORDER BY low, high) AS k
  FROM (SELECT DISTINCT doc_id, low, high FROM pieces) JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS m FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(m, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
