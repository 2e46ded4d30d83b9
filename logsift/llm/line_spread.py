"""Removal of lines that stand on many sites, found by sketches and settled exactly.

Every distinct line gets a HyperLogLog sketch of the sites it stands on; sketches merge by
aggregation, so a line that a third of all documents share is summed up in every task before
anything is shuffled. A sketch far above or below the threshold decides; for lines near it the
sites are counted exactly. Built-in expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import row_keys, written

MIN_SITES = 10
# 2**LOG_BUCKETS buckets: a standard error of about 4 % beyond the counts that sketches hold exactly.
LOG_BUCKETS = 9
# Estimates within so many standard errors of the threshold are settled by exact counts.
ERRORS = 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _content(line: Column) -> Column:
    """What a line is compared by: its text without white space around it."""
    return F.trim(F.translate(line, "\r\t\x0b\x0c", "    "))


def spread_lines(docs: DataFrame, min_sites: int, site_column: str, text_column: str) -> DataFrame:
    """(h1, h2): hashes of the lines that stand on at least min_sites distinct sites.

    A null site is a site. Lines of white space alone don't count.
    """
    content = _content(F.col("line"))
    lines = (
        docs.select(F.col(site_column).alias("site"), F.explode(_lines(F.col(text_column))).alias("line"))
        .select("site", content.alias("line"))
        .filter("line <> ''")
    )
    # two hashes of one line: 128 bits, so that different lines practically never meet
    h1, h2 = row_keys("line")
    site = F.xxhash64("site", F.isnull("site").cast("int"))
    slim = lines.select(h1.alias("h1"), h2.alias("h2"), site.alias("site"))
    sketches = slim.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"))
    estimated = sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = ERRORS * 1.04 / math.sqrt(2**LOG_BUCKETS)
    judged = written(
        estimated.filter(F.col("sites") >= math.floor(min_sites * (1 - margin))).select(
            "h1", "h2", (F.col("sites") > math.ceil(min_sites * (1 + margin))).alias("sure")
        ),
        "line-estimates",
    )
    near = judged.filter(~F.col("sure")).select("h1", "h2")
    exact = (
        slim.join(near, ["h1", "h2"], "left_semi")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    return judged.filter("sure").select("h1", "h2").union(exact.select("h1", "h2"))


def spread_copies(docs: DataFrame, min_sites: int, site_column: str, text_column: str, id_column: str) -> DataFrame:
    """(k1, k2): keys of the rows whose set of lines, as a whole, stands on at least min_sites sites.

    These are copies of a document: their own number makes their lines spread ones.
    """
    k1, k2 = row_keys(id_column, text_column)
    lines = F.filter(F.transform(_lines(F.col(text_column)), _content), lambda x: x != "")
    sets = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        F.xxhash64(site_column, F.isnull(site_column).cast("int")).alias("site"),
        F.array_sort(F.array_distinct(lines)).alias("lines"),
    ).filter(F.size("lines") > 0)
    s1, s2 = row_keys("lines")
    sets = written(sets.select("k1", "k2", "site", s1.alias("s1"), s2.alias("s2")), "line-sets")
    copied = (
        sets.select("s1", "s2", "site")
        .distinct()
        .groupBy("s1", "s2")
        .agg(F.count("*").alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    return sets.join(copied, ["s1", "s2"], "left_semi").select("k1", "k2").distinct()


def without_spread_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    site_column: str = "source",
    text_column: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """Every row of docs as row, with clean, n_lines and n_removed.

    Lines are cut at line feeds and compared without white space around them. A line on at least
    min_sites distinct sites is removed wherever it stands; blank lines stay. Only a document whose lines
    stand together, as a whole, on min_sites sites is left as it is: it is a copy of a document, not a
    page with boilerplate. clean is the text without the removed lines, the text
    itself if none is, null if it is null (with 0 lines; an empty text is one line). Repeated
    rows stay repeated, and other columns, whatever their names, don't matter.
    """
    spread = written(spread_lines(docs, min_sites, site_column, text_column), "spread-lines")
    k1, k2 = row_keys(id_column, text_column)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    # lines travel as hashes; texts are shuffled once, to meet the places of their removed lines
    h1, h2 = row_keys("line")
    # keys first: beside the lines they would be computed from the whole text for each of them
    split = docs.select(k1.alias("k1"), k2.alias("k2"), _lines(F.col(text_column)).alias("lines"))
    placed = (
        split.select("k1", "k2", F.posexplode("lines").alias("place", "raw"))
        .select("k1", "k2", "place", _content(F.col("raw")).alias("line"))
        .filter("line <> ''")
        .select("k1", "k2", "place", h1.alias("h1"), h2.alias("h2"))
    )
    # rows equal in id and text have the same places; a set holds each once
    shared = (
        placed.join(spread, ["h1", "h2"], "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_set("place").alias("places"))
    )
    copies = spread_copies(docs, min_sites, site_column, text_column, id_column)
    shared = shared.join(copies, ["k1", "k2"], "left_anti")
    met = keyed.join(shared, ["k1", "k2"], "left")
    text = F.col(f"row.{text_column}")
    return met.select(
        "row",
        F.when(F.size("places") > 0, _without(text, F.col("places"))).otherwise(text).alias("clean"),
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).alias("n_lines"),
        F.greatest(F.size(F.coalesce("places", F.array().cast("array<int>"))), F.lit(0)).alias("n_removed"),
    )


def _without(text: Column, places: Column) -> Column:
    """A text without the lines at some places, in time that grows with the lines.

    The outer function binds the lines, so that they are not split anew for each of them.
    """
    parts = F.array(F.struct(_lines(text).alias("lines"), places.alias("places")))

    def joined(part: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(part["lines"]) - 1)
        return F.array_join(F.transform(F.array_except(every, part["places"]), lambda i: part["lines"][i]), "\n")

    return F.transform(parts, joined)[0]


def cleaned(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", **options) -> DataFrame:
    """The rows of docs with their columns, the text cleaned and its length brought up to date."""
    rows = without_spread_lines(docs, text_column=text_column, **options)
    changed = {
        text_column: F.col("clean"),
        length_column: F.length("clean").cast(docs.schema[length_column].dataType)
        if length_column in docs.columns
        else None,
    }
    return rows.select(
        *[
            changed[c].alias(c) if changed.get(c) is not None else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


# The same rule with exact counts, for a second engine.
ORACLE = """
WITH lines AS (
    SELECT doc_id, text, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM {docs}
), compared AS (
    SELECT *, trim(translate(raw, chr(13) || chr(9) || chr(11) || chr(12), '    ')) AS line FROM lines
), spread AS (
    SELECT line FROM compared WHERE line <> ''
    GROUP BY line HAVING count(DISTINCT source) + max((source IS NULL)::int) >= {min_sites}
), sets AS (
    SELECT doc_id, text, source, list_sort(list(DISTINCT line)) AS content
    FROM compared WHERE line <> '' GROUP BY doc_id, text, source
), whole AS (
    SELECT content FROM sets
    GROUP BY content HAVING count(DISTINCT source) + max((source IS NULL)::int) >= {min_sites}
), copies AS (
    SELECT DISTINCT doc_id, text, true AS copied FROM sets SEMI JOIN whole USING (content)
), shared AS (
    SELECT doc_id, text, list(DISTINCT place) AS places
    FROM compared SEMI JOIN spread USING (line) GROUP BY doc_id, text
), met AS (
    SELECT d.*, CASE WHEN c.copied THEN [] ELSE s.places END AS places
    FROM {docs} d
    LEFT JOIN shared s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.text IS NOT DISTINCT FROM s.text
    LEFT JOIN copies c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text IS NOT DISTINCT FROM c.text
)
SELECT doc_id, lang, source,
       CASE WHEN len(places) > 0 THEN coalesce(array_to_string(
           list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(places, i)), chr(10)), '')
       ELSE text END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       coalesce(len(places), 0) AS n_removed
FROM met
"""
