"""One document of each group of near copies, by exact similarity of five-word shingles.

Candidates come in two ways. SimHash fingerprints that the generalised pigeonhole links (`simhash`) find copies
that differ little. At a similarity of 0.8 fingerprints differ in ten bits and more, which no probing
reaches; so candidates are also those that share a band of min-hashes: two sets of similarity 0.8 do
with a probability of 1 - (1 - 0.8**5)**24, all but one in ten thousand. The similarity of candidates
is then computed from their whole sets of shingles, and only pairs that reach it are linked.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm import simhash
from logsift.llm.common import distinct_words, give_back_memory, row_keys, small_batches, written
from logsift.llm.components import components
from logsift.llm.word_model import keys

SIMILARITY = 0.8
BANDS, ROWS = 24, 5
# Bits that fingerprints of candidates may differ in.
TAU = 3
# From one class of sizes to the next.
CLASS_STEP = 1.05
# A sketch has 64 bits a word; a shingle flips the bit that its lowest bits name.
SKETCH_WORDS = 16
_FLIPPED = f"if((token >> 6) & {SKETCH_WORDS - 1} = {{word}}, 1L << cast(token & 63 as int), 0L)"
SEED = 42
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, none of a text without a word.

    Only A-Z are lower-cased. Fewer words than a shingle holds: the whole sequence is the shingle.
    """
    found, places, begins = distinct_words(pc.ascii_lower(texts.fill_null("")))
    hashes = (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in found)
    words = np.fromiter(hashes, dtype=np.uint64, count=len(found))[places]
    for start, end in zip(begins[:-1], begins[1:]):
        own = words[start:end]
        size = min(shingle, own.size)
        yield np.unique(keys(*(own[i : own.size - size + 1 + i] for i in range(size)))) if size else own


def _bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, found.size, 4096):
        part = found[None, start : start + 4096] * _TIMES[:, None] + _PLUS[:, None]
        least = np.minimum(least, part.min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return keys(np.arange(BANDS, dtype=np.uint64), *(np.ascontiguousarray(rows[:, j]) for j in range(ROWS)))


def signatures(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(doc, k1, k2, s1, s2, size, bands) of every row; s1 and s2 identify its set of shingles."""
    small_batches(docs.sparkSession)
    k1, k2 = row_keys(id_column, text_column)
    slim = docs.select(
        F.col(id_column).alias("doc"), k1.alias("k1"), k2.alias("k2"), F.col(text_column).alias("text")
    )
    schema = T.StructType(
        [slim.schema["doc"]]
        + [T.StructField(c, T.LongType()) for c in ("k1", "k2", "s1", "s2", "size")]
        + [T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, bands = [], [], []
            for found in shingle_sets(batch.column("text"), shingle):
                names.append([xxhash.xxh64_intdigest(found.tobytes(), s) for s in (1, 2)])
                sizes.append(found.size)
                bands.append(_bands(found).view(np.int64) if found.size else [])
            s = np.array(names, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("k1"), batch.column("k2")]
                + [pa.array(np.ascontiguousarray(s[:, j])) for j in (0, 1)]
                + [pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                schema.names,
            )
        give_back_memory()

    return slim.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(node, found): the shingles of the wanted (node, k1, k2)."""
    k1, k2 = row_keys(id_column, text_column)
    slim = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_column).alias("text")).join(wanted, ["k1", "k2"])
    # rows equal in id and text are all there
    slim = slim.select("node.s1", "node.s2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.view(np.int64) for f in shingle_sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("s1"), batch.column("s2"), pa.array(found, pa.list_(pa.int64()))], ["s1", "s2", "found"]
            )
        give_back_memory()

    rows = slim.mapInArrow(run, "s1 bigint, s2 bigint, found array<bigint>")
    rows = rows.groupBy("s1", "s2").agg(F.first("found").alias("found"))
    return rows.select(F.struct("s1", "s2").alias("node"), "found")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this similarity."""
    met = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("found").alias("one")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("found").alias("other")), "v")
        .withColumn("shared", F.size(F.array_intersect("one", "other")))
    )
    union = F.size("one") + F.size("other") - F.col("shared")
    return met.filter(F.col("shared") >= F.lit(similarity) * union - 1e-9).select("u", "v")


def _by_fingerprints(docs: DataFrame, nodes: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(node, size, head) of the nodes whose fingerprints are linked; head is the first of their class."""
    fps = simhash.fingerprints(docs, shingle, False, id_column, text_column).select("k1", "k2", "fp", "fp2")
    own = nodes.select("node", "size", "row.k1", "row.k2").join(fps.distinct(), ["k1", "k2"])
    own = written(own.select("node", "size", "fp", "fp2"), "near-fps")
    classes = simhash.linked_classes(own, TAU).select("fp", "label_fp")
    named = written(own.join(classes, "fp").select("node", "size", "label_fp"), "near-classes")
    firsts = named.groupBy("label_fp").agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("many"))
    return named.join(firsts.filter("many > 1"), "label_fp").select("node", "size", "head")


def _open_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): every pair of nodes with different labels that may have the similarity, and few others.

    A prefix filter. The shingles of a node are put in one order for all, rarest first. Two sets of sizes
    a and b need at least similarity / (1 + similarity) * (a + b) shared shingles; so the first one they share
    stands, in both, among those before which fewer are left out than may be missing. What the pages of a template
    have in common comes late in that order, so pages that are less alike don't meet, however many there are.
    Nodes meet by such a shingle and the class of the smaller one's size, since the shares depend on both sizes.
    Those that meet are compared by sketches first: bits that each shingle flips. Sets differ in no fewer shingles
    than their sketches in bits, so no pair is lost.
    """
    tokens = nodes.join(sets, "node").select("node", "size", "label", F.explode("found").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("many"))
    ordered = tokens.join(often, "token").groupBy("node", "size", "label").agg(
        F.array_sort(F.collect_list(F.struct("many", "token"))).alias("found"),
        F.array(*[F.bit_xor(F.expr(_FLIPPED.format(word=w))) for w in range(SKETCH_WORDS)]).alias("sketch"),
    )
    share = similarity / (1 + similarity)

    def missing(own, other):
        """How many shingles of a set of size own may be missing in one of size other."""
        return own - F.ceil(F.lit(share) * (own + other) - 1e-9)

    def size_class(size):
        return F.floor(F.log(size) / F.log(F.lit(CLASS_STEP)) + 1e-9)

    size, most = F.col("size"), F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9)
    ordered = ordered.withColumn("found", F.slice("found", 1, (most + 1).cast("int")))
    # a shingle of one node alone keeps its place and meets nobody
    placed = ordered.select("node", "size", "label", "sketch", F.posexplode("found").alias("place", "one")).filter("one.many > 1")
    placed = written(placed.select("node", "size", "label", "sketch", "place", F.col("one.token").alias("token")), "near-prefixes")
    smaller = placed.filter(F.col("place") <= missing(size, size)).withColumn("class", size_class(size))
    least = F.lit(similarity) * size - 1e-9
    classes = F.sequence(size_class(F.greatest(least, F.lit(1.0))), size_class(size))
    begin = F.greatest(least, F.pow(F.lit(CLASS_STEP), F.col("class")) * (1 - 1e-6))
    larger = placed.withColumn("class", F.explode(classes)).filter(F.col("place") <= missing(size, begin))
    a, b = smaller.alias("a"), larger.alias("b")
    flips = [F.bit_count(F.col("a.sketch")[w].bitwiseXOR(F.col("b.sketch")[w])) for w in range(SKETCH_WORDS)]
    apart = missing(F.col("a.size"), F.col("b.size")) + missing(F.col("b.size"), F.col("a.size"))
    met = a.join(b, ["token", "class"]).filter(
        (F.col("a.label") != F.col("b.label"))
        & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") < F.col("b.node"))))
        & (F.col("a.size") >= F.lit(similarity) * F.col("b.size") - 1e-9)
        & (F.col("a.place") <= missing(F.col("a.size"), F.col("b.size")))
        & (F.col("b.place") <= missing(F.col("b.size"), F.col("a.size")))
        & (reduce(operator.add, flips) <= apart)
    )
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def links(docs: DataFrame, found: DataFrame, shingle: int, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """(u, v): links that connect whatever verified pairs of candidates connect.

    In a first round every node of a class of fingerprints and of a band meets the first one there; large
    groups of copies are connected by that. In a second the nodes of all bands that still hold unconnected ones
    meet by the rare shingles they share (_open_pairs), in whatever band.
    """
    nodes = found.filter("size > 0").groupBy("s1", "s2").agg(
        F.min(F.struct("k1", "k2")).alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    nodes = written(nodes.select(F.struct("s1", "s2").alias("node"), "row", "size", "bands"), "near-nodes")
    listed = nodes.select("node", "size", F.explode("bands").alias("band"))
    firsts = listed.groupBy("band").agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("many"))
    met = written(listed.join(firsts.filter("many > 1"), "band").select("band", "node", "size", "head"), "near-bands")
    alike_bits = written(_by_fingerprints(docs, nodes, shingle, id_column, text_column), "near-alike")
    asked = met.select("node").union(alike_bits.select("node")).distinct()
    wanted = nodes.join(asked, "node", "left_semi")
    wanted = wanted.select("node", "row.k1", "row.k2")
    sets = written(_sets(docs, wanted, shingle, id_column, text_column), "near-sets")

    def alike(a: str, b: str):
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9

    stars = met.select("node", "size", "head").union(alike_bits).filter(alike("size", "head.size")).filter("node <> head.node")
    stars = stars.select(F.col("head.node").alias("u"), F.col("node").alias("v")).distinct()
    first = written(_verified(stars, sets, similarity), "near-links")
    labels = written(components(first), "near-labels")
    named = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labels.select(F.col("node").alias("head_node"), F.col("label").alias("head_label"))
    named = named.join(heads, F.col("head.node") == F.col("head_node"), "left")
    named = named.withColumn("head_label", F.coalesce("head_label", "head.node"))
    named = written(named.select("band", "node", "size", "label", "head_label"), "near-named")
    # of two nodes that are not connected one at least is not connected with the first of the band
    divided = named.filter("label <> head_label").select("band").distinct()
    open_nodes = named.join(divided, "band", "left_semi").select("node", "size", "label").distinct()
    rest = written(_open_pairs(written(open_nodes, "near-open"), sets, similarity), "near-rest")
    return first.select("u", "v").union(_verified(rest, sets, similarity).select("u", "v"))


def one_of_each(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = SIMILARITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of docs without near copies: of every group the row with the smallest id stays.

    A group is what pairs connect whose similarity, shared shingles over all shingles, each counted
    once, is at least the given one. Ties of the id go to the row hash; of rows equal in id and text one
    stays. Texts without a word are copies of each other. All columns are kept.
    """
    found = written(signatures(docs, shingle, id_column, text_column), "near-signatures")
    linked = written(links(docs, found, shingle, similarity, id_column, text_column), "near-all-links")
    labels = components(linked)
    first = F.min(F.struct(F.isnull("doc").alias("none"), "doc", "k1", "k2"))
    least = found.groupBy("s1", "s2").agg(first.alias("least"))
    least = least.select(F.struct("s1", "s2").alias("node"), "least")
    stay = (
        least.join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.min("least").alias("least"))
        .select(F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"))
    )
    k1, k2 = row_keys(id_column, text_column)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    kept = keyed.join(stay, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return kept.select("row.*")
