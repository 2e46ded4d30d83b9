"""Near-duplicate documents by SimHash fingerprints and a generalised pigeonhole.

Two fingerprints that differ in at most tau of 64 bits are found without comparing all pairs: the
bits are dealt into m partitions, and partition i gets a threshold t_i so that the t_i add up to
tau - m + 1. Were every partition i to differ in t_i + 1 bits or more, the total would be over
tau; so linked fingerprints are close in one partition at least. Correlated bits go into the same
partition, and the thresholds are chosen by dynamic programming on the number of rows and
candidates they would cost, from bit statistics over all fingerprints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import give_back_memory, row_keys, small_batches, word_runs, written
from logsift.llm.components import components

BITS = 64
SEED = 42  # fixed by the contract
SECOND_SEED = 1042
MAX_PARTITION_THRESHOLD = 2
# Costs of one row to shuffle and one pair to compare, in seconds; only their ratio matters.
ROW_COST, PAIR_COST = 2e-6, 4e-9
# A run of rows with one key is compared in cells of at most about this many rows a side.
CELL_ROWS = 4096

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_BYTE_PLACE = np.arange(8, dtype=np.int64) * 256


# --- fingerprints -----------------------------------------------------------------------------


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_PLACE
    by_value = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    return (by_value @ _BYTE_BITS.astype(np.int64)).reshape(64)


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int, seeds: tuple[int, ...]) -> list[int]:
    """The fingerprint of a whole text for each seed; zero if it has no word.

    Only A-Z are lower-cased. Fewer words than a shingle holds: the whole sequence is the shingle.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts = [np.zeros(BITS, dtype=np.int64) for _ in seeds]
    total, carried = 0, []
    for run in word_runs(data):
        words = carried + run
        if len(words) >= shingle:
            grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
            total += len(grams)
            for count, seed in zip(counts, seeds):
                digest = xxhash.xxh64_intdigest
                count += _bit_counts(
                    np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64, count=len(grams))
                )
            words = words[len(words) - shingle + 1 :] if shingle > 1 else []
        carried = words
    if not total and carried:
        return [xxhash.xxh64_intdigest(b" ".join(carried), seed) for seed in seeds]
    return [_pack(2 * count > total) for count in counts]


def fingerprints(
    docs: DataFrame,
    shingle: int = 3,
    second: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc, k1, k2, fp, fp2) of every row of docs; fp2 is 0 unless second is set.

    k1 and k2 identify the row by its id and text. Fingerprints are signed 64-bit integers.
    """
    small_batches(docs.sparkSession)
    k1, k2 = row_keys(id_column, text_column)
    slim = docs.select(
        F.col(id_column).alias("doc"), k1.alias("k1"), k2.alias("k2"), F.col(text_column).alias("text")
    )
    schema = T.StructType(
        [slim.schema["doc"]] + [T.StructField(c, T.LongType()) for c in ("k1", "k2", "fp", "fp2")]
    )
    seeds = (SEED, SECOND_SEED) if second else (SEED,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 2), dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                found[i, : len(seeds)] = fingerprint(text.as_py(), shingle, seeds)
            signed = found.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("k1"), batch.column("k2")]
                + [pa.array(np.ascontiguousarray(signed[:, j])) for j in (0, 1)],
                ["doc", "k1", "k2", "fp", "fp2"],
            )
        give_back_memory()

    return slim.mapInArrow(run, schema)


# --- bit statistics and the choice of partitions -------------------------------------------------


def _as_bits(fps: np.ndarray) -> np.ndarray:
    packed = fps.astype("<i8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(packed, axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _as_bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(cells.size, dtype=np.int32)), pa.array(cells)], ["cell", "n"]
        )

    sums = nodes.select("fp").mapInArrow(run, "cell int, n bigint")
    rows = sums.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows at most
    cells = np.zeros(BITS * BITS + 1)
    for row in rows:
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


@dataclass(frozen=True)
class Partition:
    """Some of the 64 bits, and in how many of them linked fingerprints may differ here."""

    bits: tuple[int, ...]
    threshold: int


def _correlation(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size; each grows by the bit that correlates most with it."""
    strength = np.abs(_correlation(n, both))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _dependence(n: int, both: np.ndarray, bits: list[int]) -> float:
    """How much likelier all bits of two fingerprints agree than independent bits would.

    Along a spanning tree of the strongest pairs: agreement of i and j over the product of both.
    """
    if n < 2:
        return 1.0
    share = both / n
    p = np.diag(share)
    ratio = {}
    for i, j in itertools.combinations(bits, 2):
        one = share[i, j]
        cells = np.array([one, p[i] - one, p[j] - one, 1 - p[i] - p[j] + one])
        apart = (p[i] ** 2 + (1 - p[i]) ** 2) * (p[j] ** 2 + (1 - p[j]) ** 2)
        ratio[i, j] = float((cells**2).sum() / apart)
    reached, factor = {bits[0]}, 1.0
    while len(reached) < len(bits):
        best, new = max(
            (r, j if i in reached else i)
            for (i, j), r in ratio.items()
            if (i in reached) != (j in reached)
        )
        reached.add(new)
        factor *= max(best, 1.0)
    return factor


def estimated_costs(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """The cost of a partition at thresholds 0 to most: rows made and pairs compared.

    With threshold t a fingerprint is listed under its value and under those with up to t of its
    ones cleared: two values differing in t bits or fewer have one such value in common, the
    bits they share. The sums run over the ways to clear x ones of the one and y of the other.
    """
    p = np.diag(both) / max(n, 1)
    meets = np.zeros((most + 1, most + 1))
    meets[0, 0] = 1
    made = np.zeros(most + 1)
    made[0] = 1
    for b in bits:
        one, none, mixed = p[b] ** 2, (1 - p[b]) ** 2, p[b] * (1 - p[b])
        step = meets * (one + none)
        step[1:, :] += meets[:-1, :] * mixed
        step[:, 1:] += meets[:, :-1] * mixed
        step[1:, 1:] += meets[:-1, :-1] * one
        meets = step
        grown = made.copy()
        grown[1:] += made[:-1] * p[b]
        made = grown
    factor = _dependence(n, both, bits)
    costs = []
    for t in range(most + 1):
        pairs = n * n / 2 * meets[: t + 1, : t + 1].sum() * factor
        costs.append(n * made[: t + 1].sum() * ROW_COST + pairs * PAIR_COST)
    return costs


def allocate(n: int, both: np.ndarray, tau: int) -> list[Partition]:
    """The partitions and thresholds of least estimated cost; thresholds of -1 are left out."""
    best: tuple[float, list[Partition]] = (math.inf, [])
    for m in range(1, tau + 2):
        groups = group_bits(n, both, m)
        goal = tau - m + 1  # what the thresholds add up to
        # least[s]: cost and thresholds so far, with thresholds + 1 adding up to s
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            costs = [0.0] + estimated_costs(n, both, bits, MAX_PARTITION_THRESHOLD)
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (cost, chosen) in least.items():
                for t1, more in enumerate(costs):
                    if t1 > len(bits) + 1:
                        continue
                    option = (cost + more, chosen + (t1 - 1,))
                    if total + t1 not in grown or option < grown[total + t1]:
                        grown[total + t1] = option
            least = grown
        if goal + m in least and least[goal + m][0] < best[0]:
            cost, chosen = least[goal + m]
            best = (cost, [Partition(tuple(g), t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


# --- probing and verification -----------------------------------------------------------------------


def _masks(partition: Partition) -> tuple[np.uint64, list[np.uint64]]:
    whole = sum(1 << b for b in partition.bits)
    cleared = [
        np.uint64(sum(1 << b for b in some))
        for k in range(1, partition.threshold + 1)
        for some in itertools.combinations(partition.bits, k)
    ]
    return np.uint64(whole), cleared


def listed(nodes: DataFrame, partitions: list[Partition]) -> DataFrame:
    """Each fingerprint under every key it is compared by: (part, value, fp, fp2)."""
    masks = [_masks(p) for p in partitions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            fp2 = batch.column("fp2").to_numpy(zero_copy_only=False)
            for part, (whole, cleared) in enumerate(masks):
                places, values = [np.arange(fp.size)], [fp & whole]
                for some in cleared:  # only ones that are set can be cleared
                    at = np.flatnonzero((fp & some) == some)
                    places.append(at)
                    values.append((fp[at] & whole) ^ some)
                at = np.concatenate(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(at.size, part, dtype=np.int32)),
                        pa.array(np.concatenate(values).view(np.int64)),
                        pa.array(fp[at].view(np.int64)),
                        pa.array(fp2[at]),
                    ],
                    ["part", "value", "fp", "fp2"],
                )

    return nodes.select("fp", "fp2").mapInArrow(run, "part int, value bigint, fp bigint, fp2 bigint")


def _in_cells(rows: DataFrame) -> DataFrame:
    """Splits keys with many rows into cells of chunk pairs; every two rows meet in one cell."""
    sizes = rows.groupBy("part", "value").count().filter(F.col("count") > CELL_ROWS)
    large = sizes.select("part", "value", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("chunks"))
    chunked = rows.join(large, ["part", "value"], "left")
    chunk = F.pmod(F.xxhash64("fp", "fp2"), F.col("chunks")).cast("int")
    others = F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)
    return (
        chunked.withColumn("own", F.coalesce(chunk, F.lit(0)))
        .withColumn("other", F.explode(others))
        .select(
            "part",
            "value",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            "fp",
            "fp2",
        )
    )


class _Forest:
    """Which rows of a run are connected already; only links that connect more are passed on."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = self.label[self.label[i]]
            i = int(self.label[i])
        return i

    def add(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        apart = self.label[left] != self.label[right]
        new = []
        for i, j in zip(left[apart].tolist(), right[apart].tolist()):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.label[max(x, y)] = min(x, y)
                new.append((i, j))
        if new:
            while True:
                flat = self.label[self.label]
                if np.array_equal(flat, self.label):
                    break
                self.label = flat
        return new


def _links_within(
    run: np.ndarray, fp: np.ndarray, fp2: np.ndarray, tau: int, tau_both: int | None
) -> list[tuple[int, int]]:
    """Links of a forest over rows sorted by run number; compares every two rows of a run."""
    size = run.size
    ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, size)
    left_in_run = ends[np.searchsorted(ends, np.arange(size), side="right")] - np.arange(size) - 1
    forest, links = _Forest(size), []
    at = np.flatnonzero(left_in_run > 0)
    step = 1
    while at.size:
        other = at + step
        apart = np.bitwise_count(fp[at] ^ fp[other])
        hit = apart <= tau
        if tau_both is not None:
            hit &= apart + np.bitwise_count(fp2[at] ^ fp2[other]) <= tau_both
        if hit.any():
            links += forest.add(at[hit], other[hit])
        step += 1
        at = at[left_in_run[at] >= step]
    return links


def probe(rows: DataFrame, tau: int, tau_both: int | None = None) -> DataFrame:
    """Verified links (u, v) between fingerprints that meet under a key.

    The links of a run form a forest: enough for its components, and never more than its rows,
    also where thousands of near copies all lie within tau of each other.
    """
    keys = ["part", "value", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(part: pa.Table) -> pa.RecordBatch:
            columns = [part.column(c).to_numpy() for c in (*keys, "fp", "fp2")]
            new = np.zeros(part.num_rows, dtype=bool)
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            fp = columns[4].view(np.uint64)
            links = _links_within(np.cumsum(new), fp, columns[5].view(np.uint64), tau, tau_both)
            pair = np.array(links, dtype=np.int64).reshape(-1, 2)
            ends = np.stack([columns[4], columns[5]], axis=1)
            u, v = ends[pair[:, 0]], ends[pair[:, 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(x[:, j])) for x in (u, v) for j in (0, 1)],
                ["u", "u2", "v", "v2"],
            )

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < 1 << 16:
                continue
            # the last key may go on in the next batch
            last = [held.column(c)[-1].as_py() for c in keys]
            same = np.ones(held.num_rows, dtype=bool)
            for c, value in zip(keys, last):
                same &= held.column(c).to_numpy() == value
            cut = int(np.argmax(same))
            if cut:
                yield found(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield found(held)
        held = None
        give_back_memory()

    schema = "u bigint, u2 bigint, v bigint, v2 bigint"
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def linked_classes(fps: DataFrame, tau: int, tau_both: int | None = None) -> DataFrame:
    """(fp, fp2, label_fp, label_fp2): the class of every distinct fingerprint.

    Fingerprints are linked if they differ in tau bits or fewer and, with tau_both, in that many
    of the 128 bits of both. A class is what links connect.
    """
    nodes = written(fps.select("fp", "fp2").distinct(), "simhash-nodes")
    spark = nodes.sparkSession
    small_batches(spark, 4096)
    n, both = bit_statistics(nodes)
    rows = written(listed(nodes, allocate(n, both, tau)), "simhash-listed")
    found = probe(_in_cells(rows), tau, tau_both)
    links = written(
        found.select(F.struct("u", "u2").alias("u"), F.struct("v", "v2").alias("v")), "simhash-links"
    )
    labels = components(
        links.select(
            F.struct(F.col("u.u").alias("fp"), F.col("u.u2").alias("fp2")).alias("u"),
            F.struct(F.col("v.v").alias("fp"), F.col("v.v2").alias("fp2")).alias("v"),
        )
    ).select(
        F.col("node.fp").alias("fp"),
        F.col("node.fp2").alias("fp2"),
        F.col("label.fp").alias("label_fp"),
        F.col("label.fp2").alias("label_fp2"),
    )
    small_batches(spark)
    return nodes.join(labels, ["fp", "fp2"], "left").select(
        "fp",
        "fp2",
        F.coalesce("label_fp", "fp").alias("label_fp"),
        F.coalesce("label_fp2", "fp2").alias("label_fp2"),
    )


# --- the operator ------------------------------------------------------------------------------


def near_classes(docs: DataFrame, shingle: int = 3, tau: int = 3) -> DataFrame:
    """(doc, fingerprint, component): one row for each row of docs.

    fingerprint: 16 lowercase hex digits; component: the smallest doc id that links reach, itself
    included. Null texts count as empty, texts without a word have fingerprint zero and are
    linked like any other. Repeated rows come back repeated. A null id is never a component's
    name unless all its members' ids are null. Other columns of docs don't matter.
    """
    fps = written(fingerprints(docs, shingle).select("doc", "fp", "fp2"), "simhash-fps")
    classes = linked_classes(fps, tau)
    least = fps.groupBy("fp").agg(F.min("doc").alias("least"))
    named = classes.join(least, "fp")
    names = named.groupBy("label_fp").agg(F.min("least").alias("component"))
    by_fp = written(named.join(names, "label_fp").select("fp", "component"), "simhash-names")
    return fps.join(by_fp, "fp").select(
        "doc", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component"
    )


def one_of_each(
    docs: DataFrame,
    shingle: int = 5,
    tau: int = 12,
    tau_both: int | None = 23,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of docs without near copies: of every class the row with the smallest id stays.

    Five-word shingles. Texts of similarity 0.8 (shared shingles over all shingles) differ in
    about 15 % of the bits of a fingerprint; linked are those that differ in at most tau of the
    first 64 and tau_both of 128 bits, where unrelated texts practically never are. Being an
    estimate, this finds about three of four pairs at 0.8 and nearly all from 0.9. Ties of the id
    go to the row hash; of rows equal in id and text one stays. Texts without a word are copies of
    each other. All columns are kept.
    """
    fps = written(
        fingerprints(docs, shingle, tau_both is not None, id_column, text_column), "simhash-fps"
    )
    classes = linked_classes(fps, tau, tau_both)
    first = F.min(F.struct(F.isnull("doc").alias("none"), "doc", "k1", "k2"))
    least = fps.groupBy("fp", "fp2").agg(first.alias("least"))
    stay = (
        least.join(classes, ["fp", "fp2"])
        .groupBy("label_fp", "label_fp2")
        .agg(F.min("least").alias("least"))
        .select(F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"))
    )
    k1, k2 = row_keys(id_column, text_column)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    kept = keyed.join(stay, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return kept.select("row.*")
