"""Costs of documents under an interpolated modified Kneser-Ney model of word pairs.

The model grows with the trusted text and stays in tables. The cost of a word is split into terms that
are looked up on their own: the cost of the word alone and of leaving it as a context, and what a pair
changes in that. A document's cost is the sum of the terms of its words and pairs.

Pairs that occur once, and words that occur once, have no terms of their own: their share goes to what the
context leaves for unseen pairs, and to unseen words, so probabilities still add up to one. That is the usual cut-off,
without which most of the model would be words nobody meets again.

Words and pairs are digests. A task sends those of a batch of texts as a few compressed arrays, one for
each range of digests, and what meets there are arrays too: counts and terms are joined by merging
sorted digests. Scoring goes over the ranges in rounds, so that only a part of the digests of all texts is on
its way at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import (
    bucket_edges,
    discarded,
    distinct_words,
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

# Costs are whole millionths of a nat, so that sums don't depend on their order.
UNIT = 1_000_000
# The terms of so many of the most frequent keys go to every task: what hot words add is summed up there
# and never shuffled. The result is the same without.
HOT = 1 << 16
# Scoring looks up the ranges of digests in so many rounds.
ROUNDS = 3
# Texts of one batch, 65,536 at most.
BATCH_ROWS = 2048
# Pairs and words that occur less often have no terms.
LEAST_COUNT = 2
SEED = 9
# Digests are of 48 bits, the highest of 64: two of n are the same about n * n / 2**49 times.
_TOP = np.uint64(0xFFFFFFFFFFFF0000)
_START, _END = np.uint64(1 << 16), np.uint64(2 << 16)
_SENT = "bucket int, block bigint, data binary"


def keys(*words: np.ndarray) -> np.ndarray:
    """One 64-bit key for each sequence of words of this length."""
    key = np.full(words[0].size, len(words), dtype=np.uint64)
    for word in words:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + word)
    return key


def digests(*words: np.ndarray) -> np.ndarray:
    return keys(*words) & _TOP


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word digests of some texts with a start and an end mark, and where each begins."""
    found, places, begins = distinct_words(texts.fill_null(""))
    digest = xxhash.xxh64_intdigest
    hashes = (digest(w.encode("utf-8", "surrogatepass"), SEED) for w in found)
    hashes = np.fromiter(hashes, dtype=np.uint64, count=len(found)) & _TOP
    sizes = np.diff(begins)
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    words = np.empty(starts[-1], dtype=np.uint64)
    words[starts[:-1]] = _START
    words[starts[1:] - 1] = _END
    words[np.arange(places.size) + np.repeat(2 * np.arange(sizes.size) + 1, sizes)] = hashes[places]
    return words, starts


def _pair_places(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the first words of all pairs."""
    inner = np.ones(words.size, dtype=bool)
    inner[starts[1:] - 1] = False
    return np.flatnonzero(inner)


def _heads(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if ordered.size else np.zeros(0, np.int64)


def _buckets(rows: DataFrame) -> int:
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _arrays(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first of them ascending."""
    return squeezed(rising(columns[0])) + b"".join(map(squeezed, columns[1:]))


def _columns(data: bytes, count: int) -> list[np.ndarray]:
    first, *rest = expanded(data, count)
    return [risen(first), *rest]


# --- counts --------------------------------------------------------------------------------------------


def pair_counts(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """(bucket, block, data): the pairs of words of every batch with their counts, by the digest of the pair."""
    small_batches(texts.sparkSession, BATCH_ROWS)
    buckets = _buckets(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, starts = sequences(batch.column(0))
            at = _pair_places(words, starts)
            key = digests(words[at], words[at + 1])
            order = np.argsort(key)
            heads = _heads(key[order])
            first = order[heads]
            n = np.diff(np.append(heads, order.size)).astype(np.uint64)
            edges = bucket_edges(key[first], buckets)
            found = [(b, first[edges[b] : edges[b + 1]], n[edges[b] : edges[b + 1]]) for b in range(buckets)]
            found = [(b, where[o], n[o]) for b, where, n in found if where.size for o in [np.argsort(words[at[where]])]]
            data = [_arrays(words[at[where]], words[at[where] + 1], n) for _, where, n in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, *_ in found], pa.int32()),
                    pa.array([0] * len(found), pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                ["bucket", "block", "data"],
            )
        give_back_memory()

    return texts.select(text_column).mapInArrow(run, _SENT)


def _summed(by: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct numbers of by, ascending, and the sum of each of the values over their places."""
    order = np.argsort(by)
    heads = _heads(by[order])
    if not heads.size:
        return [by, *(np.zeros(0, np.int64) for _ in values)]
    return [by[order][heads], *(np.add.reduceat(v[order].astype(np.int64), heads) for v in values)]


def _histogram(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n.astype(np.int64), 5), minlength=6)[1:5]


# Rows of the counted tables: pairs that have terms, what a bucket adds to the counts of words, and how many
# pairs occur once, twice, three and four times.
_PAIRS, _WORDS, _TIMES = 0, 1, 2
_COUNTED = "kind int, bucket int, data binary"


def _add_up(buckets: int):
    """A bucket of pairs: their counts over all batches, and what they are for the words they are of."""

    def run(rows: pa.Table) -> pa.Table:
        found = [_columns(d, 3) for d in rows.column("data").to_pylist()]
        a, b, n = (np.concatenate(c) for c in zip(*found))
        key = digests(a, b)
        order = np.argsort(key)
        heads = _heads(key[order])
        first = order[heads]
        n = np.add.reduceat(n[order].astype(np.int64), heads)
        a, b = a[first], b[first]
        often = np.flatnonzero(n >= LEAST_COUNT)
        often = often[np.argsort(a[often])]
        out = [(_PAIRS, rows.column("bucket")[0].as_py(), _arrays(a[often], b[often], n[often]))]
        out.append((_TIMES, 0, squeezed(_histogram(n))))
        # of every word: as a context its pairs' counts, and how many are 1, 2 and more; and its left neighbours
        one, ones = (n == 1).astype(np.int64), np.ones(n.size, np.int64)
        two = (n == 2).astype(np.int64)
        left, total, n1, n2, pairs = _summed(a, n, one, two, ones)
        right, many = _summed(b, ones)
        word = np.union1d(left, right)
        values = np.zeros((5, word.size), dtype=np.int64)
        values[:4, np.searchsorted(word, left)] = total, n1, n2, pairs - n1 - n2
        values[4, np.searchsorted(word, right)] = many
        spread = mixed(word)
        by_digest = np.argsort(spread)
        edges = bucket_edges(spread[by_digest], buckets)
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            part = np.sort(by_digest[edges[bucket] : edges[bucket + 1]])
            out.append((_WORDS, bucket, _arrays(word[part], *values[:, part])))
        give_back_memory()
        return pa.table(
            {
                "kind": pa.array([r[0] for r in out], pa.int32()),
                "bucket": pa.array([r[1] for r in out], pa.int32()),
                "data": pa.array([r[2] for r in out], pa.binary()),
            }
        )

    return run


# Words that have terms: total, n1, n2, n3 as contexts, left as the number of their left neighbours. A row of
# every bucket without a word has the sums over all its words: left neighbours, words, and how many words have
# 1, 2, 3 and 4 of them.
_WORD_ROWS = "word bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, left bigint, words bigint, l1 bigint, l2 bigint, l3 bigint, l4 bigint"


def _word_rows(rows: pa.Table) -> pa.Table:
    found = [_columns(d, 6) for d in rows.column("data").to_pylist()]
    word, total, n1, n2, n3, left = _summed(*(np.concatenate(c) for c in zip(*found)))
    often = (left >= LEAST_COUNT) | (total >= LEAST_COUNT)
    names = [part.split()[0] for part in _WORD_ROWS.split(", ")]
    own = [word.view(np.int64), total, n1, n2, n3, left]
    sums = [int(left.sum()), word.size, *_histogram(left[left > 0])]
    columns = [pa.array(np.append(c[often], 0), mask=np.append(np.zeros(often.sum(), bool), True)) for c in own[:5]]
    columns.append(pa.array(np.append(left[often], sums[0])))
    columns += [pa.array([None] * int(often.sum()) + [int(v)], pa.int64()) for v in sums[1:]]
    return pa.table(dict(zip(names, columns)))


def discounts(times: list[int]) -> list[float]:
    """The modified discounts of counts 1, 2 and 3 or more; fixed ones where data are too few."""
    n = [float(t) for t in times]
    if 0 in n[:3]:
        return [0.5, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) for k in range(3)]


# --- the model -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """terms (key, n, value): of words and pairs; n is for their order of frequency only."""

    terms: DataFrame
    unseen: int  # the cost of a word without terms


def _keyed(table: DataFrame, *words: str) -> DataFrame:
    """(key, n, value) of a table of words, n and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in words]
            key = digests(*parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("n"), batch.column("value")], ["key", "n", "value"])

    return table.select(*words, "n", "value").mapInArrow(run, "key bigint, n bigint, value bigint")


def _pair_rows(counted: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = [pa.array(c.view(np.int64)) for c in _columns(data, 3)]
                yield pa.RecordBatch.from_arrays(found, ["a", "b", "n"])

    return counted.filter(F.col("kind") == _PAIRS).select("data").mapInArrow(run, "a bigint, b bigint, n bigint")


def fit(texts: DataFrame, text_column: str = "text") -> Model:
    """The model of all pairs of words of some texts.

    A pair is its discounted count plus, weighted by what the context's other pairs leave, the word
    alone; a word alone is the discounted number of its left neighbours, mixed with the uniform
    distribution over all words and one more.
    """
    spark, buckets = texts.sparkSession, _buckets(texts)
    sent = pair_counts(texts, text_column).select("bucket", "data")
    counted = written(sent.groupBy("bucket").applyInArrow(_add_up(buckets), _COUNTED), "pair-counts")
    free_shuffles(spark)
    parts = counted.filter(F.col("kind") == _WORDS).select("bucket", "data")
    words = written(parts.groupBy("bucket").applyInArrow(_word_rows, _WORD_ROWS), "word-counts")
    sums = words.filter("word is null").agg(
        *[F.sum(c).alias(c) for c in ("left", "words", "l1", "l2", "l3", "l4")]
    ).first()
    if not sums["left"]:
        return Model(spark.createDataFrame([], "key bigint, n bigint, value bigint"), 0)
    times = [0, 0, 0, 0]
    for row in counted.filter(F.col("kind") == _TIMES).select("data").collect():  # four numbers a bucket
        times = [t + int(v) for t, v in zip(times, expanded(row["data"])[0])]
    d, below = discounts(times), discounts([sums[f"l{k}"] for k in range(1, 5)])

    def held(n: str, d: list[float]) -> Column:
        return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])

    def cost(p: Column) -> Column:
        return F.round(-F.log(p) * UNIT).cast("bigint")

    own = words.filter("word is not null")
    kept = F.when(F.col("left") > 0, F.col("left") - held("left", below)).otherwise(0.0)
    # whole numbers, whose sums don't depend on their order
    many = own.agg(
        F.sum("left").alias("all"), *[F.count_if(c).alias(n) for n, c in (("one", F.col("left") == 1), ("two", F.col("left") == 2), ("more", F.col("left") > 2))]
    ).first()
    whole = (many["all"] or 0) - below[0] * many["one"] - below[1] * many["two"] - below[2] * many["more"]
    unseen = (sums["left"] - whole) / sums["left"] / (sums["words"] + 1)
    unseen_cost = round(-np.log(unseen) * UNIT)
    # pairs that occur once leave all of their count to the others
    spare = F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")
    known = written(
        own.select(
            "word",
            (F.col("total") + F.col("left")).alias("n"),
            "total",
            F.when(F.col("total") > 0, spare).otherwise(0.0).alias("spare"),
            (kept / sums["left"] + unseen).alias("p"),
            F.col("left") > 0,
        ).toDF("word", "n", "total", "spare", "p", "follows"),
        "word-costs",
    )
    leave = F.when(F.col("total") > 0, cost(F.col("spare") / F.col("total"))).otherwise(0)
    alone = F.when(F.col("follows"), cost(F.col("p")) - unseen_cost).otherwise(0)
    pairs = _pair_rows(counted)
    contexts = known.select(F.col("word").alias("a"), "total", "spare", leave.alias("leave"))
    ends = known.select(F.col("word").alias("b"), F.col("p").alias("p1"))
    p2 = (F.col("n") - held("n", d) + F.col("spare") * F.col("p1")) / F.col("total")
    joined = pairs.join(contexts, "a").join(ends, "b")
    terms = _keyed(known.select("word", "n", (alone + leave).alias("value")), "word").unionByName(
        _keyed(joined.select("a", "b", "n", (cost(p2) - F.col("leave") - cost(F.col("p1"))).alias("value")), "a", "b")
    )
    found = written(terms, "word-terms")
    discarded(counted, words, known)
    free_shuffles(spark)
    return Model(found, unseen_cost)


# --- scoring -------------------------------------------------------------------------------------------


def _turns(key: np.ndarray, rounds: int) -> np.ndarray:
    """The round that looks a digest up."""
    return (key >> np.uint64(16)) % np.uint64(rounds)


def _tables(terms: DataFrame, ranges: int, rounds: int) -> DataFrame:
    """(turn, bucket, data): the terms of each round and range of digests as arrays."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column("key").to_numpy(zero_copy_only=False)).view(np.uint64)
            order = np.argsort(key)
            key = key[order]
            bucket = np.repeat(np.arange(ranges, dtype=np.int32), np.diff(bucket_edges(key, ranges)))
            values = batch.column("value").to_numpy(zero_copy_only=False)[order]
            columns = [_turns(key, rounds).astype(np.int32), bucket, key.view(np.int64), values]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["turn", "bucket", "key", "value"])

    def gathered(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        order = order[_heads(key[order])]
        data = _arrays(key[order], _zigzag(rows.column("value").to_numpy()[order]))
        return pa.table({"turn": rows.column("turn")[:1], "bucket": rows.column("bucket")[:1], "data": pa.array([data], pa.binary())})

    rows = terms.select("key", "value").mapInArrow(ranged, "turn int, bucket int, key bigint, value bigint")
    return rows.groupBy("turn", "bucket").applyInArrow(gathered, "turn int, bucket int, data binary")


def _zigzag(values: np.ndarray) -> np.ndarray:
    """Whole numbers as ones from 0, small where they are small."""
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def _hot(terms: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the most frequent keys; a fixed number of rows, whatever the corpus."""
    found = terms.orderBy(F.desc("n"), "key").limit(hot).select("key", "value").toArrow()
    key = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], found.column("value").to_numpy()[order]


def _looked_up(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in an ascending table, and where."""
    if not table.size:
        return np.zeros(key.size, dtype=bool), np.zeros(key.size, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, key), table.size - 1)
    return table[at] == key, at


def costs(docs: DataFrame, model: Model, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """(k1, k2, n, cost) of docs (k1, k2, text): words and end mark, and their cost.

    Rows with one k1 and k2 have one text; there is one row of the result for them.
    """
    spark, ranges = docs.sparkSession, _buckets(docs)
    hot_keys, hot_values = _hot(model.terms, hot)
    tables = written(_tables(model.terms, ranges, rounds), "word-tables")
    unseen = model.unseen

    def sender(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _batch(batch, turn)
            give_back_memory()

        return run

    def _batch(batch: pa.RecordBatch, turn: int) -> pa.RecordBatch:
        words, starts = sequences(batch.column("text"))
        sizes = np.diff(starts)
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        at = _pair_places(words, starts)
        key = np.concatenate([digests(words), digests(words[at], words[at + 1])])
        owner = np.concatenate([doc, doc[at]])
        base = np.zeros(batch.num_rows, dtype=np.int64)
        if turn == 0:
            base += (sizes - 1) * unseen
        mine = _turns(key, rounds) == turn
        key, owner = key[mine], owner[mine]
        if hot_keys.size:
            hit, place = _looked_up(hot_keys, key)
            np.add.at(base, owner[hit], hot_values[place[hit]])
            key, owner = key[~hit], owner[~hit]
        # a digest leaves its lowest 16 bits free, and a batch has no more rows than they can number
        marked = np.sort(key | owner.astype(np.uint64))
        heads = _heads(marked)
        times = np.diff(np.append(heads, marked.size))
        key, owner = marked[heads] & _TOP, marked[heads] & ~_TOP
        k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        block = xxhash.xxh64_intdigest(k1.tobytes() + k2.tobytes()) >> 1
        edges = bucket_edges(key, ranges)
        full = np.flatnonzero(np.diff(edges))
        data = [
            _arrays(key[edges[b] : edges[b + 1]], owner[edges[b] : edges[b + 1]], times[edges[b] : edges[b + 1]])
            for b in full.tolist()
        ]
        about = b"".join([squeezed(k1.view(np.uint64)), squeezed(k2.view(np.uint64)), squeezed(sizes - 1), squeezed(_zigzag(base))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *full.tolist()], pa.int32()),
                pa.array([block] * (1 + full.size), pa.int64()),
                pa.array([about, *data], pa.binary()),
            ],
            ["bucket", "block", "data"],
        )

    # the rows of a batch itself go to one of many tasks, as its digests do
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod("block", F.lit(ranges))).otherwise(F.col("bucket")).cast("int")
    known = tables.select("turn", "bucket", F.col("data").alias("terms"))
    parts = []
    for turn in range(rounds):
        small_batches(spark, BATCH_ROWS)
        sent = docs.select("k1", "k2", "text").mapInArrow(sender(turn), _SENT).withColumn("bucket", spread)
        met = sent.groupBy("bucket").cogroup(known.filter(F.col("turn") == turn).groupBy("bucket")).applyInArrow(_met, "block bigint, about boolean, data binary")
        sums = met.groupBy("block").applyInArrow(_totals, "k1 bigint, k2 bigint, n bigint, cost bigint")
        parts.append(written(sums.withColumn("turn", F.lit(turn)), "word-sums"))
        free_shuffles(spark)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # a row that occurs several times has several equal rows in every round
    once = every.groupBy("k1", "k2", "turn").agg(F.max("n").alias("n"), F.max("cost").alias("cost"))
    found = written(once.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.sum("cost").alias("cost")), "word-scores")
    discarded(tables, *parts)
    return found


def _met(sent: pa.Table, tables: pa.Table) -> pa.Table:
    """What a range of the terms adds to the documents of every batch."""
    shape = {"block": pa.int64(), "about": pa.bool_(), "data": pa.binary()}
    if not sent.num_rows:
        return pa.table({k: pa.array([], t) for k, t in shape.items()})
    blocks, data = sent.column("block"), sent.column("data").to_pylist()
    if sent.column("bucket")[0].as_py() < 0:
        return pa.table({"block": blocks, "about": pa.array([True] * len(data)), "data": pa.array(data, pa.binary())})
    if not tables.num_rows:
        return pa.table({k: pa.array([], t) for k, t in shape.items()})
    table, values = _columns(tables.column("terms")[0].as_py(), 2)
    values, out, names = _signed(values), [], []
    for block, each in zip(blocks.to_pylist(), data):
        key, owner, times = _columns(each, 3)
        hit, at = _looked_up(table, key)
        if hit.any():
            owner, found = _summed(owner[hit], values[at[hit]] * times[hit].view(np.int64))
            out.append(_arrays(owner, _zigzag(found)))
            names.append(block)
    give_back_memory()
    return pa.table(
        {"block": pa.array(names, pa.int64()), "about": pa.array([False] * len(out), pa.bool_()), "data": pa.array(out, pa.binary())}
    )


def _totals(rows: pa.Table) -> pa.Table:
    """The documents of one batch with the sums of all that was found for them."""
    about = rows.column("about").to_pylist()
    data = rows.column("data").to_pylist()
    # equal batches have equal rows: all of them say the same of themselves, each has its sums once
    copies = sum(about)
    k1, k2, n, base = expanded(data[about.index(True)], 4)
    cost = _signed(base).copy() * copies
    for own, each in zip(about, data):
        if not own:
            owner, found = _columns(each, 2)
            cost[owner.view(np.int64)] += _signed(found)
    return pa.table(
        {
            "k1": pa.array(k1.view(np.int64)),
            "k2": pa.array(k2.view(np.int64)),
            "n": pa.array(n.view(np.int64)),
            "cost": pa.array(cost // copies),
        }
    )
