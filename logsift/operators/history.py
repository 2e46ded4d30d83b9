"""History of templates across runs, and the operators' verdicts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.schemas import CLASSIFICATIONS


def merge_templates(history: DataFrame, new: DataFrame) -> DataFrame:
    """Fold a run's templates into the history.

    First seen is the earlier, last seen the later, counts add up, and the descriptive columns
    keep their old value. Both sides hold a template once, so the join key cannot be hot.
    """
    h, n = history.alias("h"), new.alias("n")
    keep = ["service_name", "logger", "template_text"]
    return h.join(n, F.col("h.template_hash") == F.col("n.template_hash"), "full_outer").select(
        F.coalesce("h.template_hash", "n.template_hash").alias("template_hash"),
        *[F.coalesce(f"h.{c}", f"n.{c}").alias(c) for c in keep],
        F.least("h.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("h.last_seen", "n.last_seen").alias("last_seen"),
        (F.coalesce("h.total_count", F.lit(0)) + F.coalesce("n.total_count", F.lit(0))).alias(
            "total_count"
        ),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One row a template from several partial histories; the merge of all of them at once.

    The descriptive columns follow from the hash. Partial sums meet in each task first, so that a template
    which every part has stays cheap.
    """
    return parts.groupBy("template_hash").agg(
        *[F.min(c).alias(c) for c in ("service_name", "logger", "template_text")],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("total_count").alias("total_count"),
    )


def template_history(occurrences: DataFrame) -> DataFrame:
    """The history rebuilt from all recorded occurrences; a pure rollup, safe to repeat."""
    return occurrences.groupBy("template_hash", "service_name", "logger", "template_text").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("count").alias("total_count"),
    )


def non_overlapping_windows(runs: DataFrame) -> DataFrame:
    """Runs with the part of each window that no earlier run covered.

    Windows end when a run starts and look back a fixed span, so two runs closer together than
    the span count the lines between twice. A run's own part starts where the runs before it
    ended. The latest end so far is found within each month, then carried over the months: only
    one row per month ever meets in one task.
    """
    monthly = runs.withColumn("month", F.date_trunc("month", "window_end"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        monthly.groupBy("month")
        .agg(F.max("window_end").alias("month_end"))
        .withColumn("carried", F.max("month_end").over(before))
        .select("month", "carried")
    )
    earlier = (
        Window.partitionBy("month").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.greatest(F.max("window_end").over(earlier), F.col("carried"))
    return (
        monthly.join(carried, "month")
        .withColumn(
            "own_start", F.least("window_end", F.greatest("window_start", covered))
        )
        .select("id", "window_start", "window_end", "own_start")
    )


def current_verdicts(events: DataFrame) -> DataFrame:
    """The last verdict set on each template; all of its columns come from that one event.

    ``max_by`` combines inside each task, so a template with very many events stays cheap.
    """
    fields = F.struct("classification", "note", "set_by", "set_at")
    return (
        events.groupBy("template_hash")
        .agg(
            F.max_by(
                fields, F.struct("set_at", "classification", F.coalesce("note", F.lit("")), "set_by")
            ).alias("v")
        )
        .select("template_hash", "v.*")
    )


def validate_verdicts(events: DataFrame) -> DataFrame:
    """Verdicts that must not be stored, with the reason.

    The classification is checked first; a digest may use upper or lower case.
    """
    reason = F.when(
        ~F.col("classification").isin(CLASSIFICATIONS) | F.col("classification").isNull(),
        F.lit("classification"),
    ).when(
        ~F.rlike("template_hash", F.lit("^[0-9a-fA-F]{64}$")) | F.col("template_hash").isNull(),
        F.lit("template_hash"),
    )
    return events.withColumn("reason", reason).filter("reason is not null")
