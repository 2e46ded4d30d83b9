"""Audit of filters that overlap: what each one removes in every order, and its share over all orders.

The states of a cleaning run are the sets of filters that have been applied. An edge of this lattice
applies one more filter, and what it removes there depends on the state alone, not on the order that
led to it. So documents are counted once, by part and by the set of filters they fail; those few counts
give every edge. Forward counts say how many orders reach a state, backward counts how many lead from
it to the end: their product weighs an edge in the Shapley sum, and the steps of each order are
read from the same edges.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import row_keys, written

# White space of the word contracts.
SPACES = " \t\n\x0b\f\r"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The lattice has 2**n states and there are n! orders.
MOST_FILTERS = 7


def _words(text: Column) -> Column:
    plain = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(plain, " "), "")


def few_words(text: Column) -> Column:
    return F.size(_words(text)) < MIN_WORDS


def repetitive(text: Column) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words)


def shouting(text: Column) -> Column:
    length = F.char_length(text)
    return 100 * (length - F.char_length(F.translate(text, CAPITALS, ""))) > MAX_CAPITALS_PERCENT * length


def marked(text: Column) -> Column:
    return F.rlike(text, F.lit(MARKS))


# The conditions a document fails by its own text, and the letter of the filter against copies.
CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "A": few_words,
    "B": repetitive,
    "C": shouting,
    "D": marked,
}
COPIES = "E"


# --- the lattice -----------------------------------------------------------------------------------


def edge_weights(n: int) -> dict[tuple[int, int], int]:
    """(state, filter) to the number of orders that take this edge, by forward and backward counts."""
    if n > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders")
    states = 1 << n
    reaching, leaving = [0] * states, [0] * states
    reaching[0] = leaving[states - 1] = 1
    for state in range(states):
        for f in range(n):
            if not state >> f & 1:
                reaching[state | 1 << f] += reaching[state]
    for state in reversed(range(states)):
        for f in range(n):
            if not state >> f & 1:
                leaving[state] += leaving[state | 1 << f]
    return {
        (state, f): reaching[state] * leaving[state | 1 << f]
        for state in range(states)
        for f in range(n)
        if not state >> f & 1
    }


def _steps(names: str, edges: dict[tuple[int, int], int]) -> list[dict]:
    """Every step of every order: its filter, and the numbers of the edges up to and including it."""
    n = len(names)
    rows = []
    for order in itertools.permutations(range(n)):
        state, path = 0, []
        for step, f in enumerate(order):
            path.append(edges[state, f])
            rows.append(
                {
                    "filter_order": "".join(names[i] for i in order),
                    "step": step + 1,
                    "f": f,
                    "path": list(path),
                    "alone": edges[0, f],
                    "last": edges[(1 << n) - 1 - (1 << f), f],
                }
            )
            state |= 1 << f
    return rows


# --- counts by part and pattern of failures ----------------------------------------------------------


def patterns(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Callable[[Column], Column]] = CONDITIONS,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters they fail.

    Bit i of mask is the i-th condition; the bit above them is the filter against copies. Texts are
    compared by two hashes; what is shuffled are rows of hashes and ids, summed before and after.
    """
    parts = docs.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.coalesce(F.col(part_column), F.lit("")).alias("part"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    k1, k2 = row_keys("text")
    bits = [F.when(fails(F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(conditions.values())]
    slim = parts.select("id", "part", k1.alias("k1"), k2.alias("k2"), sum(bits, F.lit(0)).alias("own"))
    # the texts are read once; all that follows starts from these rows
    rows = written(slim.groupBy("id", "part", "k1", "k2", "own").agg(F.count("*").alias("n")), "filter-rows")
    known = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    marks = rows.join(known, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    # Copies of one text fail the same conditions, so that a text is one row for each part and label.
    texts = marks.groupBy("k1", "k2", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("at_first"),
    )
    firsts = texts.groupBy("k1", "k2").agg(F.min("first").alias("least"), F.count("*").alias("rows"))
    several = firsts.filter("rows > 1").select("k1", "k2", "least")
    met = texts.join(several, ["k1", "k2"], "left")
    originals = F.col("unnamed") + F.when(
        F.col("first") == F.coalesce("least", "first"), F.col("at_first")
    ).otherwise(0)
    copy_bit = 1 << len(conditions)
    split = met.select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("own").alias("mask"), originals.alias("n")),
                F.struct((F.col("own") + copy_bit).alias("mask"), (F.col("n") - originals).alias("n")),
            )
        ).alias("s"),
    )
    return (
        split.filter("s.n > 0")
        .groupBy("part", F.col("s.mask").alias("mask"))
        .agg(
            F.sum("s.n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"),
        )
    )


# --- the audit ---------------------------------------------------------------------------------------


def steps_of_orders(counts: DataFrame, names: str) -> DataFrame:
    """The rows of audit from counts (part, mask, n, good, toxic); names: a letter for each bit of mask."""
    spark, n = counts.sparkSession, len(names)
    weights = edge_weights(n)
    edges = {edge: i for i, edge in enumerate(weights)}
    # n * 3**(n - 1) rows: which edges remove a document with this pattern
    removals = spark.createDataFrame(
        [
            (mask, i, f, weights[state, f])
            for (state, f), i in edges.items()
            for mask in range(1 << n)
            if not mask & state and mask >> f & 1
        ],
        "mask int, edge int, f int, weight bigint",
    )
    removed = (
        counts.join(F.broadcast(removals), "mask")
        .groupBy("part", "edge", "f", "weight")
        .agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    )
    by_part = removed.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("edge", F.struct("n", "good", "toxic")))).alias("edges"),
        F.array(
            *[F.sum(F.when(F.col("f") == f, F.col("weight") * F.col("n")).otherwise(0)) for f in range(n)]
        ).alias("shares"),
    )
    whole = counts.groupBy("part").agg(F.sum("n").alias("docs"))
    shape = "array<struct<filter_order:string,step:int,f:int,path:array<int>,alone:int,last:int>>"
    every_step = F.from_json(F.lit(json.dumps(_steps(names, edges))), shape)
    rows = whole.join(by_part, "part", "left").select("*", F.explode(every_step).alias("s"))

    def at(edge: Column, field: str) -> Column:
        return F.coalesce(F.col("edges")[edge][field], F.lit(0))

    here = F.element_at("s.path", -1)
    kept = F.aggregate("s.path", F.col("docs"), lambda left, edge: left - at(edge, "n"))
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        kept.alias("kept"),
        at(here, "n").alias("removed"),
        (at(F.col("s.alone"), "n") - at(here, "n")).alias("redundant"),
        at(F.col("s.last"), "n").alias("unique_fails"),
        at(here, "good").alias("good_lost"),
        at(here, "toxic").alias("toxic_lost"),
        F.coalesce(F.get("shares", F.col("s.f")), F.lit(0)).cast("bigint").alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Callable[[Column], Column]] = CONDITIONS,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the filters and step. labels: (doc_id, quality, toxic); a document
    with several rows there is good or toxic if one of them says so. The filter against copies fails a
    document whose text one with a smaller id has; rows with one id are no copies of each other, a row
    without an id is a copy of nothing and nothing of it. A null text is empty, a null part the empty
    string, repeated rows count as often as they occur. No documents give no parts and so no rows.
    """
    counts = written(patterns(docs, labels, conditions, id_column, text_column, part_column), "filter-patterns")
    return steps_of_orders(counts, "".join(conditions) + COPIES)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order
  FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k)
  JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), s AS (
  SELECT filter_order, step, filter_order[step] AS k, filter_order[1:step - 1] AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, k,
         sum(CASE WHEN translate(fails, before || k, '') = fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = k THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r
"""
