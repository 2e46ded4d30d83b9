"""Life of a run: which one is analysed next, what became of it, what it reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_pending_run(runs: DataFrame) -> DataFrame:
    """The run with the largest id that is still running; no row if there is none."""
    return (
        runs.filter(F.col("status") == "running")
        .orderBy(F.col("id").desc())
        .limit(1)
        .select(F.col("id").alias("run_id"), "window_start", "window_end")
    )


def abandon_superseded(runs: DataFrame) -> DataFrame:
    """The run table with every running run older than the newest one given up."""
    newest = runs.filter(F.col("status") == "running").agg(F.max("id")).scalar()
    superseded = (F.col("status") == "running") & (F.col("id") < newest)
    return runs.withColumn(
        "status", F.when(superseded, F.lit("abandoned")).otherwise(F.col("status"))
    )


def run_outcome(
    gate: DataFrame, selected_counts: DataFrame, decoded: DataFrame
) -> DataFrame:
    """Final status per run.

    The budget is checked first, then whether anything was selected, then whether the report
    could be read. ``gate`` has run_id and exhausted, ``selected_counts`` run_id and sent,
    ``decoded`` run_id and report.
    """
    report = decoded.select("run_id", F.col("report").isNotNull().alias("readable"))
    nothing_sent = F.coalesce("sent", F.lit(0)) == 0
    status = (
        F.when(F.col("exhausted"), F.lit("budget_exhausted"))
        .when(nothing_sent, F.lit("completed"))
        .when(~F.coalesce("readable", F.lit(False)), F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    return (
        gate.join(selected_counts.select("run_id", "sent"), "run_id", "left")
        .join(report, "run_id", "left")
        .select("run_id", status.alias("status"))
    )


# --- fixed values: the note on dropped findings, around their number ---------------------------
DROPPED_BEFORE = "\n\nNote: "
DROPPED_AFTER = (
    " finding(s) were dropped because the model cited a template_ref that was not in this"
    " run's input (see the triage journal)."
)


def _dropped_note(count: Column) -> Column:
    return F.concat(F.lit(DROPPED_BEFORE), count.cast("string"), F.lit(DROPPED_AFTER))


def run_summary(reports: DataFrame, rejected: DataFrame) -> DataFrame:
    """Health, summary and reported event total per analysed run.

    The summary says how many findings were dropped, if any were.
    """
    dropped = rejected.groupBy("run_id").agg(F.count("*").alias("dropped"))
    return reports.join(dropped, "run_id", "left").select(
        "run_id",
        F.col("health").alias("health_verdict"),
        F.concat(
            "summary", F.when(F.col("dropped") > 0, _dropped_note(F.col("dropped"))).otherwise("")
        ).alias("summary"),
        "total_events",
    )


def write_summary(runs: DataFrame, summaries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The run table with summaries and outcomes of the analysed runs filled in."""
    new = summaries.select(
        F.col("run_id").alias("id"),
        F.col("health_verdict").alias("_health"),
        F.col("summary").alias("_summary"),
        F.col("total_events").alias("_events"),
    )
    ended = outcomes.select(F.col("run_id").alias("id"), F.col("status").alias("_status"))
    done = F.col("_status") == "completed"
    return (
        runs.join(ended, "id", "left")
        .join(new, "id", "left")
        .select(
            "id",
            "started_at",
            "window_start",
            "window_end",
            F.when(done, F.coalesce("_health", "health_verdict"))
            .otherwise(F.col("health_verdict"))
            .alias("health_verdict"),
            F.when(done, F.coalesce("_summary", "summary"))
            .otherwise(F.col("summary"))
            .alias("summary"),
            F.coalesce("_status", "status").alias("status"),
            F.when(done, F.coalesce("_events", "total_events"))
            .otherwise(F.col("total_events"))
            .alias("total_events"),
        )
    )

