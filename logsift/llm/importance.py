"""Importance resampling towards a target: documents whose word runs look like those of a benchmark.

Every run of one to three words falls into one of a fixed number of buckets. Two passes over the texts
suffice: the first adds up two arrays of bucket counts, the corpus's and the target's; the second
adds up, document by document, the logarithm of their ratio, looked up in an array. A key that depends
on the document alone is added to the weight, so the highest sums are a sample drawn without
replacement in proportion to the weights.

The cut-off is found without sorting the corpus: a quantile sketch brackets it, exact counts outside the
bracket prove that it lies within or widen it, and only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import distinct_words, give_back_memory, small_batches, written

BUCKETS = 10_000
LONGEST_RUN = 3
PERCENT = 5
MIN_WORDS = 20
SEED = 42
# Gains and keys are whole thousandths of a nat.
UNIT = 1000
# Of the quantile sketch: it misses a rank by one part in so many of all rows.
ACCURACY = 2000
# Rows that one task ranks, beyond the number of shuffle partitions.
SLICE_ROWS = 1_000_000
# Lengths below have a table each; longer ones are put together from powers of two.
SHORT = 128


def _folding() -> bytes:
    """Bytes that are no part of a word become spaces, capital letters small ones."""
    to = bytearray(range(256))
    for first, last in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        to[first : last + 1] = b" " * (last + 1 - first)
    to[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
    return bytes(to)


FOLDING = _folding()


# --- checksums of runs of words ------------------------------------------------------------------------


class Checksums:
    """crc32 of joined strings from the crc32 of their parts.

    The checksum of a and b, one after the other, is that of a moved on by the length of b, xor that of b. Moving
    on is linear, so four lookups by byte do it for any length that has a table.
    """

    def __init__(self) -> None:
        one = np.array([_moved_one(b) for b in range(256)], dtype=np.uint32)
        table = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        short = [table]
        for _ in range(SHORT):
            table = one[table & np.uint32(255)] ^ (table >> np.uint32(8))
            short.append(table)
        self.short = np.stack(short[:SHORT]).reshape(-1)
        self.powers = [table.reshape(-1)]  # SHORT, 2 * SHORT, 4 * SHORT ... bytes
        for _ in range(24):
            last = self.powers[-1]
            self.powers.append(self._looked_up(last, last, 0))
        self.space = np.uint32(zlib.crc32(b" "))

    @staticmethod
    def _looked_up(table: np.ndarray, crc: np.ndarray, base) -> np.ndarray:
        byte = np.uint32(255)
        out = table[base + (crc & byte)]
        for k in (1, 2, 3):
            out = out ^ table[base + (256 * k + (crc >> np.uint32(8 * k) & byte))]
        return out

    def moved(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self._looked_up(self.short, crc, length % SHORT * 1024)
        rest = length // SHORT
        if rest.any():
            for k, table in enumerate(self.powers):
                at = np.flatnonzero(rest >> k & 1)
                out[at] = self._looked_up(table, out[at], 0)
        return out

    def runs(self, crc: np.ndarray, length: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the first word, checksum) of all runs of one, two and three words.

        ends: for each word the place after the last word of its document.
        """
        places = np.arange(crc.size)
        yield places, crc
        tail, reach = crc, length  # checksum and length of the run that begins at a word
        with_space = self.moved(crc, np.ones_like(length)) ^ self.space
        for size in range(2, LONGEST_RUN + 1):
            at = places[: max(crc.size - size + 1, 0)]
            tail = self.moved(with_space[at], reach[at + 1]) ^ tail[at + 1]
            reach = length[at] + 1 + reach[at + 1]
            whole = at + size <= ends[at]
            yield at[whole], tail[whole]


def _moved_one(byte: int) -> int:
    """What a last byte of a checksum becomes when a byte is appended."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def _folded(texts: pa.Array) -> pa.Array:
    texts = texts.fill_null("")
    kept, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(FOLDING))
    return pa.Array.from_buffers(texts.type, len(texts), [kept, offsets, data], texts.null_count, texts.offset)


def features(texts: pa.Array, sums: Checksums, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The place where each text's words begin, with the end; and (place of the first word, bucket) of all
    runs, by their number of words."""
    found, places, begins = distinct_words(_folded(texts))
    raw = [w.encode() for w in found]
    crc = np.fromiter((zlib.crc32(w) for w in raw), dtype=np.uint32, count=len(raw))
    length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    ends = np.repeat(begins[1:], np.diff(begins))
    runs = sums.runs(crc[places], length[places], ends)
    return begins, [(at, (value % np.uint32(buckets)).astype(np.int64)) for at, value in runs]


# --- the two passes --------------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text_column: str = "text") -> np.ndarray:
    """How many features fall into each bucket; a task passes on one array, so do all tasks together."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = Checksums(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0), sums, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])
        give_back_memory()

    parts = texts.select(text_column).mapInArrow(run, "bucket bigint, n bigint")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the ratio of both smoothed shares."""
    many = len(corpus)
    whole, aim = int(corpus.sum()) + many, int(target.sum()) + many
    ratios = (float((int(t) + 1) * whole) / float((int(s) + 1) * aim) for s, t in zip(corpus, target))
    return np.array([math.floor(UNIT * math.log(r)) for r in ratios], dtype=np.int64)


def weighed(
    docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc, n_words, n_features, weight) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for batch in batches:
            begins, found = features(batch.column("text"), sums, len(gain))
            n_features = np.zeros(batch.num_rows, dtype=np.int64)
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            for at, bucket in found:
                # runs are in the order of their first words
                edges = np.searchsorted(at, begins)
                n_features += np.diff(edges)
                weight += np.diff(np.concatenate([[0], np.cumsum(gain[bucket])])[edges])
            columns = [np.diff(begins).astype(np.int64), n_features, weight]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *map(pa.array, columns)], ["doc", "n_words", "n_features", "weight"]
            )
        give_back_memory()

    slim = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.col(text_column).alias("text"))
    return slim.mapInArrow(run, "doc bigint, n_words bigint, n_features bigint, weight bigint")


def random_key(doc: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-F.lit(float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


# --- the cut-off -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bracket:
    low: int
    high: int
    above: int  # rows with a higher score than high
    inside: int


def bracket(rows: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> Bracket:
    """Scores between which the k-th highest of n rows (score) lies, proven by exact counts."""
    margin = 2.0 / accuracy
    while True:
        share = 1.0 - k / n
        asked = [max(share - margin, 0.0), min(share + margin, 1.0)]
        found = rows.agg(
            F.percentile_approx("score", asked, accuracy).alias("q"),
            F.min("score").alias("least"),
            F.max("score").alias("most"),
        ).first()
        low = found["q"][0] if asked[0] > 0 else found["least"]
        high = found["q"][1] if asked[1] < 1 else found["most"]
        counts = rows.agg(
            F.count_if(F.col("score") > high).alias("above"),
            F.count_if(F.col("score").between(low, high)).alias("inside"),
        ).first()
        if counts["above"] < k <= counts["above"] + counts["inside"]:
            return Bracket(low, high, counts["above"], counts["inside"])
        margin *= 8  # in the end it takes in the lowest and the highest score


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """Adds rank, from 1: higher scores first, ties to the smaller doc, null last; n is the number of rows.

    Ranges of the order are sorted apart, and each starts where those before it end.
    """
    spark = rows.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE_ROWS))
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("n_features").asc()]
    dealt = written(rows.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "slices")
    sizes = {r["slice"]: r["n"] for r in dealt.groupBy("slice").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for slice_ in sorted(sizes):  # as many as there are slices
        starts.append((slice_, before))
        before += sizes[slice_]
    offsets = F.broadcast(spark.createDataFrame(starts, "slice int, before bigint"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy(*order))
    return (
        dealt.withColumn("place", place)
        .join(offsets, "slice")
        .withColumn("rank", F.col("before") + F.col("place"))
        .drop("slice", "before", "place")
    )


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """Adds rank to scored (doc, n_words, n_features, weight, score): null for rows that are not drawn."""
    enough = F.col("n_words") >= min_words
    rows = scored.filter(enough)
    n = rows.count()
    k = n * percent // 100
    none = F.lit(None).cast("bigint")
    if not k:
        return scored.withColumn("rank", none)
    found = bracket(rows, k, n, accuracy)
    inside = ranked(rows.filter(F.col("score").between(found.low, found.high)), found.inside)
    last = inside.filter(F.col("rank") == k - found.above).first()
    score, doc = F.col("score"), F.col("doc")
    if last["doc"] is None:
        upto = F.lit(True)
    else:
        upto = F.coalesce(doc <= last["doc"], F.lit(False))
    taken = enough & ((score > last["score"]) | ((score == last["score"]) & upto))
    # rows equal to the last one may be more than there is room for
    order = ranked(scored.filter(taken), k)
    order = order.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return order.unionByName(scored.filter(~taken).withColumn("rank", none))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank) of every row of docs.

    The given share of the documents with enough words is drawn, those with the highest scores. A null or
    an empty text has no words, weighs nothing and is never drawn where words are asked for. Ties go to
    the smaller id, a null id comes last; rows with the same id have the same random key, and repeated
    rows are drawn one by one. An empty target or an empty corpus is a share of nothing: all buckets of
    it count alike. Texts of any length are read whole.
    """
    gain = gains(bucket_counts(docs, buckets, text_column), bucket_counts(target, buckets, target_column))
    rows = weighed(docs, gain, id_column, text_column)
    scored = rows.withColumn("score", F.col("weight") + random_key(F.col("doc"), seed))
    return drawn(written(scored, "weights"), percent, min_words)


# The same with checksums byte by byte, for a second engine.
ORACLE = """
WITH t AS (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                          b) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256)) AS b)
), w AS (
  SELECT 0 AS target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), r AS (
  SELECT target, doc_id, array_to_string(words[i:i + size - 1], ' ') AS feature
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i
        FROM w, (SELECT unnest([1, 2, 3]) AS size))
), n AS (SELECT target, doc_id, feature, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM n)),
b AS (
  SELECT feature, xor(list_reduce(
      list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
      lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM h, t
), s AS (
  SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t
  FROM n JOIN b USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM s
), weights AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features
  FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE target = 0 GROUP BY doc_id
), scored AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT)
             + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (doc_id) WHERE w.target = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS many
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * many // 100 THEN place END AS rank
FROM placed
"""
