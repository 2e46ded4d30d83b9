"""From a run's templates to what is sent for analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.masking import mask

# --- fixed values ---------------------------------------------------------------------------
DEFAULT_PROMPT_LIMIT = 150
BENIGN = "benign"


def suppress_benign(templates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Templates without those an operator has called benign."""
    benign = verdicts.filter(F.col("classification") == BENIGN).select("template_hash")
    return templates.join(benign, "template_hash", "left_anti")


def pending_templates(
    occurrences: DataFrame, history: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Each run's templates with lifetime history and verdict, benign ones left out.

    The verdict table is small in practice but not by construction, so no broadcast is asked
    for; Spark broadcasts it when its measured size allows.
    """
    window = occurrences.select(
        "run_id",
        "template_hash",
        F.col("count").alias("window_count"),
        "window_start",
        "window_end",
        "exemplar_lines",
    )
    marks = verdicts.select("template_hash", "classification", "note")
    return (
        window.join(marks, "template_hash", "left")
        .filter(F.col("classification").isNull() | (F.col("classification") != BENIGN))
        .join(history, "template_hash")
        .withColumn("new_this_window", F.col("first_seen") >= F.col("window_start"))
    )


def select_for_prompt(pending: DataFrame, limit: int = DEFAULT_PROMPT_LIMIT) -> DataFrame:
    """The first ``limit`` templates of each run: new ones first, then by volume in the window.

    ``rank`` is the place in that order. A limit of zero or less selects nothing.
    """
    order = Window.partitionBy("run_id").orderBy(
        F.col("new_this_window").desc(), F.col("window_count").desc(), "template_hash"
    )
    return pending.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(
        F.col("rank") <= max(limit, 0)
    )


def assign_template_refs(selected: DataFrame) -> DataFrame:
    """Short names t1, t2, ... for the templates of a run, in rank order."""
    return selected.withColumn("template_ref", F.concat(F.lit("t"), F.col("rank").cast("string")))


def template_refs(selected: DataFrame) -> DataFrame:
    return assign_template_refs(selected).select("run_id", "template_ref", "template_hash")


def run_overflow_counts(pending: DataFrame, limit: int = DEFAULT_PROMPT_LIMIT) -> DataFrame:
    """Per run: templates eligible, sent, and left out by the cap."""
    limit = max(limit, 0)
    return (
        pending.groupBy("run_id")
        .agg(F.count("*").alias("eligible"))
        .withColumn("sent", F.least("eligible", F.lit(limit).cast("bigint")))
        .withColumn("over_cap", F.col("eligible") - F.col("sent"))
    )


def window_total_events(selected: DataFrame) -> DataFrame:
    return selected.groupBy("run_id").agg(F.sum("window_count").alias("total_events"))


def _rfc3339(column: str):
    """Up to nine fraction digits in groups of three, only as many as the value needs."""
    seconds = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(column, "SSSSSS")
    fraction = (
        F.when(micros == "000000", F.lit(""))
        .when(F.substring(micros, 4, 3) == "000", F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(seconds, fraction, F.lit("+00:00"))


def payload_entries(selected: DataFrame, redact_exemplars: bool = False) -> DataFrame:
    """One row per template sent, with the fields the analysis is given; never the hash."""
    exemplars = F.col("exemplar_lines")
    if redact_exemplars:
        exemplars = F.transform(exemplars, mask)
    return assign_template_refs(selected).select(
        "run_id",
        "rank",
        "template_ref",
        F.col("service_name").alias("service"),
        "logger",
        F.col("template_text").alias("template"),
        F.col("window_count").alias("count"),
        F.col("total_count").alias("lifetime_count"),
        "new_this_window",
        _rfc3339("first_seen").alias("first_seen"),
        _rfc3339("last_seen").alias("last_seen"),
        exemplars.alias("exemplar_lines"),
        F.col("classification").alias("verdict"),
        F.col("note").alias("operator_note"),
    )


def prompt_payload(selected: DataFrame, redact_exemplars: bool = False) -> DataFrame:
    """Per run, the window and its templates as one JSON array; at most the cap's entries."""
    entries = payload_entries(selected, redact_exemplars)
    fields = [c for c in entries.columns if c not in ("run_id", "rank")]
    bounds = selected.select("run_id", "window_start", "window_end").dropDuplicates(["run_id"])
    listed = entries.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("entry")))).alias("l")
    )
    return listed.join(bounds, "run_id").select(
        "run_id",
        _rfc3339("window_start").alias("window_start"),
        _rfc3339("window_end").alias("window_end"),
        F.to_json(F.transform("l", lambda e: e["entry"]), {"ignoreNullFields": "false"}).alias(
            "payload"
        ),
    )
