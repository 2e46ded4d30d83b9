"""A training corpus from raw documents: filtered, cleaned, deduplicated, mixed and encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import kneser_ney, line_spread, merge_dropout, mixing, near_copies
from logsift.llm.common import table, written
from logsift.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text does not reject."""
    return kneser_ney.kept(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sources."""
    return line_spread.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the smallest id."""
    return near_copies.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document of the mix, and whether they decode to its text."""
    model = tokenizer_path("piece_bpe_32k.model")
    rows = merge_dropout.decode(merge_dropout.encode(docs, model), model)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.lang").alias("lang"),
        F.col("row.source").alias("source"),
        "ids",
        F.size("ids").alias("n_pieces"),
        (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("lossless"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece_encode", encode),
]

# Perplexities, fingerprints, hashes that draw documents and merges are beyond SQL; the tests compare
# the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def all_oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
