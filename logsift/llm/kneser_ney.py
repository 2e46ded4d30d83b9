"""Quality filter: perplexity under interpolated modified Kneser-Ney models of trusted text.

Two models judge a document, and it must pass both. The one that gives its perplexity is of words
(`word_model`): it grows with the trusted text and tells words and their order. The other is a feature that
tells the shape of a text, and is described here: it counts three symbols in a row, over a fixed
alphabet of 64 that texts are folded into: letters, runs of capitals, the kinds of punctuation, and a
symbol for a word that repeats the word before it.

Both are fitted on trusted documents but a share of them, which is held out. Scores are costs a word and a
symbol; a document is rejected above the quantile of the held-out documents of its language that are
about as long as it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm import word_model
from logsift.llm.common import discarded, give_back_memory, row_keys, small_batches, written

SYMBOLS = 64
CODES = SYMBOLS**3
# Costs are whole millionths of a nat, so that sums don't depend on their order.
UNIT = word_model.UNIT
# A language needs this many held-out documents for limits of its own, and all together for any.
LANGUAGE_DOCS = 4
# One in so many trusted documents is held out. Their scores set the limits: a bound that QUANTILE of
# good documents lie below, which a sample of ENOUGH_DOCS or more gives with 95 % confidence.
HELD_OUT = 5
QUANTILE = 0.995
CONFIDENCE = 1.645
ENOUGH_DOCS = 599
# Documents are as long as others of the same number of binary digits, up to this.
LONGEST = 12

_REPEAT, _START, _END = 61, 62, 63


def _alphabet() -> np.ndarray:
    """The symbol of each byte of a UTF-8 text."""
    to = np.full(256, 43, dtype=np.int32)  # other characters below 128
    to[:32] = 42  # control characters
    to[ord("a") : ord("z") + 1] = np.arange(26)
    to[ord("A") : ord("Z") + 1] = 26
    to[ord("0") : ord("9") + 1] = 27
    to[ord(" ")] = 28
    to[ord("\n")] = 29
    for i, mark in enumerate(b".,!?*$%&#|-'"):
        to[mark] = 30 + i
    to[0x80:0xC0] = 44 + (np.arange(64) & 15)  # what follows in a letter beyond ASCII
    to[0xC0:] = 60  # the first byte of one
    to[1], to[2], to[3] = _REPEAT, _START, _END
    return to


_TO = _alphabet()


def codes(text: str | None) -> np.ndarray:
    """The sequences of three symbols of a text, after two start marks and up to its end mark."""
    data = (text or "").encode()
    if data.translate(None, bytes([1, 2, 3])) != data:  # these bytes are marks here
        data = data.translate(bytes([0, 0, 0, 0, *range(4, 256)]))
    words = data.split(b" ")
    folded = words[:1] + [b"\1" if a == b else b" " + a for a, b in zip(words[1:], words)]
    s = _TO[np.frombuffer(b"\2\2" + b"".join(folded) + b"\3", dtype=np.uint8)]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


# --- the model of symbols ------------------------------------------------------------------------


def sequence_counts(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """(code, n): how often each sequence of three occurs; each task passes on its sums only."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen, n = np.unique(codes(text.as_py()), return_counts=True)
                total[seen] += n
        seen = np.flatnonzero(total)
        for start in range(0, seen.size, 1 << 16):
            part = seen[start : start + (1 << 16)]
            columns = [pa.array(part.astype(np.int32)), pa.array(total[part])]
            yield pa.RecordBatch.from_arrays(columns, ["code", "n"])
        give_back_memory()

    parts = texts.select(text_column).mapInArrow(run, "code int, n bigint")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> np.ndarray:
    """The cost of every sequence of three, in whole millionths of a nat, of counts (code, n).

    Each order is its discounted counts plus, weighted by what the discounts hold back in the
    context, the order below; the orders below count distinct continuations, and the lowest is
    mixed with the uniform one. Counts and costs have a place for each of the sequences that the
    alphabet allows.
    """
    three = np.zeros((SYMBOLS,) * 3)
    rows = counts.toArrow()  # 64**3 at most
    three.reshape(-1)[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    p: np.ndarray | float = 1.0 / SYMBOLS
    two = (three > 0).sum(axis=0).astype(float)
    for n in ((two > 0).sum(axis=0).astype(float), two, three):
        d = np.array([0.0, *word_model.discounts([int((n == k).sum()) for k in range(1, 5)])])
        held = d[np.minimum(n, 3).astype(int)]
        total = n.sum(axis=-1, keepdims=True)
        mixed = (n - held + held.sum(axis=-1, keepdims=True) * p) / np.maximum(total, 1)
        p = np.where(total > 0, mixed, p)
    return np.round(-np.log(p) * UNIT).astype(np.int32).reshape(-1)


def scorer(table: np.ndarray):
    """A column function: text to (n, cost), the scored symbols and their cost."""
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("cost", T.LongType())])

    def work(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            n, cost = [], []
            for text in texts:
                found = codes(text)
                n.append(found.size)
                cost.append(int(table[found].sum(dtype=np.int64)))
            yield pd.DataFrame({"n": n, "cost": cost})
        give_back_memory()

    # annotations of this module are strings; Spark reads them to tell the kind of function
    work.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(work, kind)


# --- limits ----------------------------------------------------------------------------------------


def trusted_ids(labels: DataFrame, bound: int | None = None) -> DataFrame:
    """Ids of documents labelled good and nothing else: all of them, unless a caller bounds them.

    With a bound more than that many are cut to about as many by a hash of their ids.
    """
    good = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("least"))
        .filter("least = 1")
        .select("doc_id")
    )
    ids = written(good, "trusted")
    if bound is not None:
        count = ids.count()
        if count > bound:
            share = int(1_000_000 * bound / count)
            ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    return ids


def length_class(n: Column) -> Column:
    """The number of binary digits, up to LONGEST."""
    return F.least(F.length(F.bin(n)), F.lit(LONGEST))


def _bound(counts: dict[int, int]) -> float:
    """What QUANTILE of the documents lie below, from their scores in thousandths of a nat."""
    docs, q = sum(counts.values()), QUANTILE
    rank = min(docs, q * docs + CONFIDENCE * (docs * q * (1 - q)) ** 0.5)
    below = 0
    for score in sorted(counts):
        below += counts[score]
        if below >= rank:
            break
    return (score + 1) / 1000.0


def limits(scores: DataFrame) -> list[tuple[bool, str | None, int, float]]:
    """(rest, lang, length, upper) from the scores (lang, n, score) of held-out documents.

    A class of lengths with too few documents takes in those of the next shorter ones, whose scores
    vary more, then of longer ones. A language with too few documents at all takes the limit of all
    together where that is higher; the rows marked rest are of all together, for languages without any.
    What comes to the driver are counts by language, length and score in steps of a thousandth: a cost
    is some tens of nats at most, so they don't grow with the documents.
    """
    shown = scores.select("lang", length_class(F.col("n")).alias("length"), F.floor(F.col("score") * 1000).alias("score"))
    found: dict[tuple[bool, str | None], dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for row in shown.groupBy("lang", "length", "score").agg(F.count("*").alias("n")).collect():
        for group in ((False, row["lang"]), (True, None)):
            found[group][row["length"]][row["score"]] += row["n"]
    out: dict[tuple[bool, str | None, int], float] = {}
    for group in sorted(found, key=lambda g: not g[0]):  # all together first
        lengths = found[group]
        if sum(sum(c.values()) for c in lengths.values()) < LANGUAGE_DOCS:
            continue
        for length in range(1, LONGEST + 1):
            merged: dict[int, int] = defaultdict(int)
            for near in (*range(length, 0, -1), *range(length + 1, LONGEST + 1)):
                if sum(merged.values()) >= ENOUGH_DOCS:
                    break
                for score, n in lengths.get(near, {}).items():
                    merged[score] += n
            upper = _bound(merged)
            if sum(merged.values()) < ENOUGH_DOCS:
                upper = max(upper, out.get((True, None, length), upper))
            out[(*group, length)] = upper
    return [(*key, upper) for key, upper in out.items()]


def _limited(spark: SparkSession, rows: DataFrame, found: list, lang: str, n: str, name: str) -> DataFrame:
    """Adds the limit of each row's language and length; null if there is none at all."""
    own = [(lang_, length, upper) for rest, lang_, length, upper in found if not rest]
    pooled = [(length, upper) for rest, _, length, upper in found if rest]
    by_lang = spark.createDataFrame(own, "l_lang string, l_length int, l_upper double")
    by_length = spark.createDataFrame(pooled, "p_length int, p_upper double")
    length = length_class(F.col(n))
    return (
        rows.join(F.broadcast(by_lang), F.col(lang).eqNullSafe(F.col("l_lang")) & (length == F.col("l_length")), "left")
        .join(F.broadcast(by_length), length == F.col("p_length"), "left")
        .withColumn(name, F.coalesce("l_upper", "p_upper"))
        .drop("l_lang", "l_length", "l_upper", "p_length", "p_upper")
    )


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    bound: int | None = None,
) -> DataFrame:
    """(row, n_symbols, perplexity, score, limit, n_words, word_score, word_limit, keep) of every row of docs.

    row holds its columns. perplexity is that of the words, word_score its logarithm, the cost a word in
    nats; n_words counts the end of the text as one. score is the cost a symbol. Both have to keep to
    their limits.

    labels: (doc_id, quality). Trusted are the documents labelled 1 and never 0. An empty or a null
    text is kept. A null language is a language. With too few trusted documents nothing can be judged:
    all are kept, with null limits. Rows repeat as they do in docs; very long texts are scored whole.
    """
    spark = docs.sparkSession
    ids = trusted_ids(labels, bound)
    k1, k2 = row_keys(id_column, text_column)
    slim = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(lang_column).alias("lang"),
        F.col(text_column).alias("text"),
        k1.alias("k1"),
        k2.alias("k2"),
    )
    trusted = slim.join(ids, "doc_id", "left_semi")
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0
    known = trusted.filter(~held)
    model = word_model.fit(known)
    words = word_model.costs(slim, model)
    discarded(model.terms)
    shape = scorer(fit(sequence_counts(known)))
    small_batches(spark)
    shapes = written(slim.select("k1", "k2", shape("text").alias("s")).select("k1", "k2", "s.*").distinct(), "shapes")
    by_words = words.select("k1", "k2", F.col("n").alias("w_n"), (F.col("cost") / UNIT / F.col("n")).alias("w_score"))
    by_shape = shapes.select("k1", "k2", F.col("n").alias("s_n"), (F.col("cost") / UNIT / F.col("n")).alias("s_score"))
    scores = written(by_words.join(by_shape, ["k1", "k2"]), "scores")
    discarded(words, shapes)
    set_aside = written(trusted.filter(held).select("k1", "k2", "lang").join(scores, ["k1", "k2"]), "held-out")
    word_limits = limits(set_aside.select("lang", F.col("w_n").alias("n"), F.col("w_score").alias("score")))
    shape_limits = limits(set_aside.select("lang", F.col("s_n").alias("n"), F.col("s_score").alias("score")))
    discarded(set_aside, ids)
    met = docs.select(F.struct("*").alias("row"), F.col(lang_column).alias("its_lang"), k1.alias("k1"), k2.alias("k2"))
    met = met.join(scores, ["k1", "k2"], "left")
    met = _limited(spark, met, word_limits, "its_lang", "w_n", "w_limit")
    met = _limited(spark, met, shape_limits, "its_lang", "s_n", "s_limit")
    passes = F.coalesce(F.col("s_score") <= F.col("s_limit"), F.lit(True)) & F.coalesce(
        F.col("w_score") <= F.col("w_limit"), F.lit(True)
    )
    return met.select(
        "row",
        F.col("s_n").alias("n_symbols"),
        F.exp("w_score").alias("perplexity"),
        F.col("s_score").alias("score"),
        F.col("s_limit").alias("limit"),
        F.col("w_n").alias("n_words"),
        F.col("w_score").alias("word_score"),
        F.col("w_limit").alias("word_limit"),
        ((F.col("s_n") <= 1) | passes).alias("keep"),
    )


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the models do not reject, with all their columns."""
    return judged(docs, labels, **options).filter("keep").select("row.*")
