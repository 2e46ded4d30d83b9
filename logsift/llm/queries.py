"""One registered query for each operator, over the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import (
    block_topk,
    filter_audit,
    importance,
    kneser_ney,
    license_scan,
    line_spread,
    merge_dropout,
    mixing,
    simhash,
    suffix_dedup,
    tile_search,
    token_files,
    trie_counts,
)
from logsift.llm.common import table


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers, or of LOGSIFT_TOKENIZERS where they differ."""
    folder = os.environ.get("LOGSIFT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as the files give them back: place, number, checksum."""
    docs = table(spark, sf_dir, "documents")
    path = token_files.write(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path, with_ids=False).select(
        F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on many sites."""
    rows = line_spread.without_spread_lines(table(spark, sf_dir, "documents"))
    return rows.select(
        "row.doc_id", "row.lang", "row.source", F.col("clean").alias("text"), "n_lines", "n_removed"
    )


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    counted = trie_counts.token_counts(
        table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    )
    return counted.select(F.col("doc").alias("doc_id"), "n_words", "n_tokens")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint over three-word shingles and its component."""
    classes = simhash.near_classes(table(spark, sf_dir, "documents"), shingle=3, tau=3)
    return classes.select(
        F.col("doc").alias("doc_id"), "fingerprint", F.col("component").alias("component_id")
    )


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces under merge-dropout, and whether they decode to its text."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    rows = merge_dropout.decode(merge_dropout.encode(docs, model), model)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").alias("n_pieces"),
        "ids",
        (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("lossless"),
    )


def op6_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    return tile_search.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("doc").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted text, and whether it is kept."""
    rows = kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.lang").alias("lang"),
        "n_symbols",
        "perplexity",
        "score",
        "limit",
        "n_words",
        "word_score",
        "word_limit",
        "keep",
    )


def op10_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return block_topk.top_products(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier one has."""
    rows = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return rows.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at every step of every order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's distribution, and its place in the draw."""
    rows = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_line_spread": op2_line_spread,
        "op3_trie_token_counts": op3_trie_token_counts,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_merge_dropout": op5_merge_dropout,
        "op6_block_matrix_neighbours": op6_block_matrix_neighbours,
        "op7_license_scan": op7_license_scan,
        "op8_pivotal_mix": op8_pivotal_mix,
        "op9_kneser_ney_quality": op9_kneser_ney_quality,
        "op10_block_top_k": op10_block_top_k,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_filter_audit": op12_filter_audit,
        "op13_importance_resampling": op13_importance_resampling,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op2_line_spread": line_spread.ORACLE.format(docs="documents", min_sites=line_spread.MIN_SITES),
        "op11_suffix_dedup": suffix_dedup.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_importance_resampling": importance.ORACLE,
    }
