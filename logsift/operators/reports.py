"""Reports and dashboard queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.schemas import SEVERITIES

# --- fixed values ---------------------------------------------------------------------------
CONDENSED = ["LOW", "INFO"]
CONDENSED_SHOWN = 10
WITH_RECOMMENDATION = ["CRITICAL", "HIGH"]
TEMPLATE_WIDTH = 120
TOP_RECURRING = 20
NEW_TEMPLATES = 50


def time_range_filter(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Rows whose time lies in a dashboard range, both ends included."""
    return df.filter(F.col(column).between(start, end))


def findings_by_severity(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings per day and severity; counted per run before the run table is joined."""
    per_run = findings.groupBy("run_id", "severity").agg(F.count("*").alias("n"))
    days = runs.select(F.col("id").alias("run_id"), F.date_trunc("day", "started_at").alias("time"))
    return (
        per_run.join(days, "run_id")
        .groupBy("time", F.col("severity").alias("metric"))
        .agg(F.sum("n").alias("value"))
    )


def _short_template(width: int) -> Column:
    return F.left("template_text", F.lit(width)).alias("template")


def top_recurring_templates(
    history: DataFrame, limit: int = TOP_RECURRING, width: int = TEMPLATE_WIDTH
) -> DataFrame:
    """The most frequent templates; the hash breaks ties."""
    return (
        history.orderBy(F.col("total_count").desc(), "template_hash")
        .limit(limit)
        .select("service_name", "logger", _short_template(width), "total_count", "last_seen")
    )


def new_templates(
    history: DataFrame, limit: int = NEW_TEMPLATES, width: int = TEMPLATE_WIDTH
) -> DataFrame:
    """The templates first seen last; the hash breaks ties."""
    return (
        history.orderBy(F.col("first_seen").desc(), "template_hash")
        .limit(limit)
        .select("service_name", "logger", _short_template(width), "first_seen")
    )


def run_health_history(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).select(
        F.col("started_at").alias("time"), "status", "health_verdict", "total_events", "summary"
    )


def severity_sections(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Every run with all five sections, in report order, and the findings in each."""
    counts = findings.groupBy("run_id", "severity").agg(F.count("*").alias("findings"))
    sections = F.array(
        *[
            F.struct(F.lit(i + 1).alias("section"), F.lit(s).alias("severity"))
            for i, s in enumerate(SEVERITIES)
        ]
    )
    return (
        runs.select(F.col("id").alias("run_id"), F.inline(sections))
        .join(counts, ["run_id", "severity"], "left")
        .withColumn("findings", F.coalesce("findings", F.lit(0).cast("bigint")))
        .select("run_id", F.col("section").cast("bigint").alias("section"), "severity", "findings")
    )


def condensed_sections(findings: DataFrame, limit: int = CONDENSED_SHOWN) -> DataFrame:
    """LOW and INFO findings as a report shows them: the first few, and how many more."""
    low = findings.filter(F.col("severity").isin(CONDENSED))
    order = Window.partitionBy("run_id", "severity").orderBy("id")
    shown = low.withColumn("position", F.row_number().over(order).cast("bigint")).filter(
        F.col("position") <= limit
    )
    more = low.groupBy("run_id", "severity").agg(
        F.greatest(F.count("*") - limit, F.lit(0).cast("bigint")).alias("more")
    )
    return shown.join(more, ["run_id", "severity"]).select(
        "run_id", "severity", "position", "issue", "more"
    )


def report_sections(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """The body of every report, one row per entry, ordered by section and finding id.

    An empty section has the single entry "None". Entries stay rows instead of one array per
    section, so a run with very many findings is no group to be held in one task.
    """
    recommendation = F.when(
        F.col("severity").isin(WITH_RECOMMENDATION) & (F.col("recommendation") != ""),
        F.col("recommendation"),
    )
    entries = findings.select(
        "run_id",
        "severity",
        F.col("id").alias("finding_id"),
        F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.col("issue")).alias("entry"),
        recommendation.alias("recommendation"),
    )
    sections = severity_sections(runs, findings).withColumn(
        "heading",
        F.concat("severity", F.lit(" ("), F.col("findings").cast("string"), F.lit(")")),
    )
    filled = sections.filter("findings > 0").join(entries, ["run_id", "severity"])
    empty = sections.filter("findings = 0").withColumns(
        {
            "finding_id": F.lit(None).cast("bigint"),
            "entry": F.lit("None"),
            "recommendation": F.lit(None).cast("string"),
        }
    )
    columns = ["run_id", "section", "heading", "finding_id", "entry", "recommendation"]
    return filled.select(*columns).unionByName(empty.select(*columns))


def _money(amount: Column, pattern: str = "#0.00") -> Column:
    return F.call_function("format_number", amount, F.lit(pattern))


# --- fixed value: the summary of a run that the budget stopped ---------------------------------
BUDGET_SUMMARY = (
    "Monthly budget exhausted — AI triage skipped this run. Aggregation and history are still"
    " current; no severity classification was performed."
)


def report_header(
    runs: DataFrame, gate: DataFrame, costs: DataFrame, budget: float
) -> DataFrame:
    """Period, health, events, summary and cost line of every run that sends a report.

    A run stopped by the budget reports unknown health and no events; one that sent nothing is
    completed without a report and has no row. ``gate`` has run_id, spend and exhausted, ``costs``
    run_id and run_cost_usd.
    """
    minute = "yyyy-MM-dd HH:mm"
    stopped = F.col("exhausted")
    cost = F.when(stopped, F.lit(0.0)).otherwise(F.coalesce("run_cost_usd", F.lit(0.0)))
    return (
        runs.filter(
            (F.col("status") == "budget_exhausted")
            | ((F.col("status") == "completed") & F.col("health_verdict").isNotNull())
        )
        .withColumnRenamed("id", "run_id")
        .join(gate.select("run_id", "spend", "exhausted"), "run_id")
        .join(costs, "run_id", "left")
        .select(
            "run_id",
            F.concat(
                F.date_format("window_start", minute),
                F.lit(" .. "),
                F.date_format("window_end", minute),
                F.lit(" UTC"),
            ).alias("period"),
            F.upper(F.when(stopped, F.lit("unknown")).otherwise(F.col("health_verdict"))).alias(
                "health"
            ),
            F.when(stopped, F.lit(0).cast("bigint"))
            .otherwise(F.col("total_events"))
            .alias("total_events"),
            F.when(stopped, F.lit(BUDGET_SUMMARY)).otherwise(F.col("summary")).alias("summary"),
            F.concat(
                F.lit("Cost: this run $"),
                _money(cost, "#0.0000"),
                F.lit(" | month-to-date $"),
                _money(F.col("spend") + cost),
                F.lit(" / $"),
                _money(F.lit(float(budget))),
                F.lit(" budget"),
            ).alias("cost_line"),
        )
    )
