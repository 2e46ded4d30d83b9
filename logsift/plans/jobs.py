"""The two scheduled jobs: collecting a window of logs, and analysing what was collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.identity import add_logger, add_service
from logsift.functions.masking import normalize_lines
from logsift.operators import buckets, cost, findings, history, lifecycle, templates, triage
from logsift.session import fresh_folder
from logsift.sources import streams
from logsift.sources.snapshots import DAY_SECONDS
from logsift.sources.tables import Tables, hash_range


def run_entries(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The bucket entries of every run's own window."""
    return add_service(templates.lines_of_runs(buckets.tag_buckets(lines), runs))


def run_occurrences(
    entries: DataFrame, runs: DataFrame, exemplars: int = templates.DEFAULT_EXEMPLARS
) -> DataFrame:
    """The occurrence rows of all runs.

    Bucket entries are little data but much work per byte. Spark would merge them into few tasks
    by size, so they are dealt over a fixed number of partitions before they are masked; the
    lines are not shuffled again after that.
    """
    sliced = templates.in_slices(entries)
    counted = templates.occurrences(normalize_lines(add_logger(sliced)), exemplars)
    windows = runs.select(F.col("id").alias("run_id"), "window_start", "window_end")
    return counted.join(windows, "run_id").select(
        "template_hash",
        "run_id",
        "service_name",
        "logger",
        "template_text",
        "count",
        templates.ns_to_timestamp("first_ns").alias("first_seen"),
        templates.ns_to_timestamp("last_ns").alias("last_seen"),
        "window_start",
        "window_end",
        "exemplar_lines",
    )


def _ids(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("id").alias("run_id"))


def _listed(tables: Tables, runs: DataFrame) -> DataFrame:
    """The runs as a table of their own: they are met many times, and may be derived from a large table."""
    path = fresh_folder(tables.spark, "runs")
    rows = runs.select("id", "started_at", "window_start", "window_end")
    rows.write.parquet(path)
    return tables.spark.read.schema(rows.schema).parquet(path)


def collect(
    tables: Tables, lines: DataFrame, runs: DataFrame, limits: dict[str, int] | None = None
) -> None:
    """Record the runs and what occurred in their windows, then bring the history up to date.

    All bucket entries count. With limits, only the newest entries of a run and bucket do, and how
    many were kept and dropped is recorded. New runs add to the history without touching the rest of
    it. Repeating a call changes nothing: if a run has been collected before, the ranges of hashes it
    had or has templates in are rebuilt from the occurrences instead of being added to.
    """
    runs = _listed(tables, runs)
    tables.start_runs(runs)
    _collect(tables, run_entries(lines, runs), runs, limits)


def collect_buckets(
    tables: Tables, paths: dict[str, str], runs: DataFrame, limits: dict[str, int] | None = None
) -> None:
    """The same from folders of lines that were selected bucket by bucket before.

    A bucket that is missing or can't be read, or files of it, don't end the run: what could be
    read counts, and what could not is recorded for every run.
    """
    spark = tables.spark
    runs = _listed(tables, runs)
    tables.start_runs(runs)
    covered = _ids(runs)
    losses = streams.bucket_losses(spark, paths).collect()  # a row a bucket
    found = spark.createDataFrame(losses, "bucket string, state string, files bigint, broken_files bigint, lost_rows bigint")
    of_runs = covered.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in paths]))).join(found, "bucket")
    tables.replace_runs("bucket_loss", of_runs, covered)
    order = F.create_map(*[F.lit(x) for pair in zip(buckets.BUCKETS, range(len(buckets.BUCKETS))) for x in pair])
    lines = streams.bucket_fallback(spark, paths, found).withColumn("bucket_ord", order[F.col("bucket")])
    _collect(tables, add_service(templates.lines_of_runs(lines, runs)), runs, limits)


def _collect(tables: Tables, entries: DataFrame, runs: DataFrame, limits: dict[str, int] | None) -> None:
    covered = _ids(runs)
    if limits is not None:
        kept = buckets.bucket_limit(entries, limits)
        tables.replace_runs("bucket_count", buckets.limit_counts(entries, limits), covered)
    else:
        kept = entries
    before = tables.read("template_occurrence").join(covered, "run_id", "left_semi")
    seen = tables.recorded_runs("template_occurrence").join(covered, "run_id", "left_semi")
    again = not seen.isEmpty()
    tables.append_occurrences(run_occurrences(kept, runs), covered)
    recorded = tables.read("template_occurrence")
    now = recorded.join(covered, "run_id", "left_semi")
    if again:
        touched = before.select("template_hash").union(now.select("template_hash"))
        ranges = touched.select(hash_range(F.col("template_hash")).alias("r")).distinct().collect()
        ranges = [r["r"] for r in ranges]  # sixteen at most
        inside = recorded.filter(hash_range(F.col("template_hash")).isin(ranges))
        tables.rebuild_history(history.template_history(inside), ranges)
    else:
        tables.add_history(history.template_history(now))


def tidy(tables: Tables, grace: float = DAY_SECONDS) -> int:
    """Deletes what writes have superseded for longer than grace seconds. To be run now and then."""
    return tables.vacuum(grace)


def claim(tables: Tables) -> DataFrame:
    """The newest running run, or no row; older running runs are given up in the run table."""
    runs = tables.read("run")
    before = runs.select("id", F.col("status").alias("before"))
    changed = lifecycle.abandon_superseded(runs).join(before, "id").filter("status <> before").drop("before")
    tables.put_runs(changed)
    newest = lifecycle.newest_pending_run(tables.read("run"))
    return tables.read("run").join(newest.select(F.col("run_id").alias("id")), "id", "left_semi")


def select(
    tables: Tables, runs: DataFrame | None = None, limit: int = triage.DEFAULT_PROMPT_LIMIT
) -> DataFrame:
    """What each of the runs sends for analysis; all recorded runs if none are named.

    A run's selection is made once. Later verdicts and later history don't change it, so that the
    names t1, t2, ... of a run keep meaning the templates that were sent.
    """
    asked = _ids(tables.read("run") if runs is None else runs)
    new = asked.join(tables.recorded_runs("prompt_selection"), "run_id", "left_anti")
    if not new.isEmpty():
        pending = triage.pending_templates(
            tables.read("template_occurrence").join(new, "run_id", "left_semi"),
            tables.read("log_template"),
            history.current_verdicts(tables.read("verdict_event")),
        )
        tables.replace_runs("prompt_selection", triage.select_for_prompt(pending, limit), new)
    return tables.read("prompt_selection").join(asked, "run_id", "left_semi")


def _status(new: DataFrame, stored: DataFrame, single: bool) -> DataFrame:
    """One run is compared with the latest other run stored, several with the runs before them."""
    known = stored.join(new.select("template_hash").distinct(), "template_hash", "left_semi")
    if single:
        return findings.status_against(new, known)
    batch = new.select("run_id").distinct()
    others = known.join(batch, "run_id", "left_anti").select(*new.columns)
    ranked = findings.finding_status(others.unionByName(new))
    return ranked.join(batch, "run_id", "left_semi")


def record_findings(
    tables: Tables,
    responses: DataFrame,
    runs: DataFrame | None = None,
    budget: float = cost.DEFAULT_MONTHLY_BUDGET,
) -> None:
    """The findings of these reports with their status, and the outcome of their runs.

    responses: (run_id, response_json). Other runs keep theirs; runs names the runs, if some of
    them have no response.
    """
    every = tables.read("run")
    covered = (responses if runs is None else _ids(runs)).select("run_id").distinct()
    mine = every.join(covered.select(F.col("run_id").alias("id")), "id", "left_semi")
    decoded = findings.decode_reports(responses)
    reports = findings.parse_reports(decoded)
    sent = tables.read("prompt_selection").join(covered, "run_id", "left_semi")
    refs = triage.template_refs(sent)
    tables.replace_runs(
        "resolved_finding", findings.resolve_refs(findings.explode_findings(reports), refs), covered
    )
    resolved = tables.read("resolved_finding").join(covered, "run_id", "left_semi")
    kept = findings.kept_findings(resolved)
    single = len(covered.limit(2).collect()) < 2
    stored = tables.read("finding").drop("status")
    tables.append_findings(_status(kept, stored, single), every, tables.read("log_template"), covered)
    gate = cost.budget_gate(mine, tables.read("api_call"), budget)
    counts = sent.groupBy("run_id").agg(F.count("*").alias("sent"))
    outcomes = lifecycle.run_outcome(gate, counts, decoded)
    summaries = lifecycle.run_summary(reports, findings.rejected_findings(resolved))
    tables.put_runs(lifecycle.write_summary(mine, summaries, outcomes))


def analyse(
    tables: Tables,
    ask: Callable[[DataFrame], DataFrame],
    budget: float = cost.DEFAULT_MONTHLY_BUDGET,
    limit: int = triage.DEFAULT_PROMPT_LIMIT,
) -> int | None:
    """One cycle: claim the newest run, give up older ones, check the budget, ask, record.

    ask turns a run's payload into its response, (run_id, response_json). Returns the run, or None
    if none is waiting. A run over budget or without anything to send is not asked about.
    """
    run = claim(tables)
    found = run.select("id").first()
    if found is None:
        return None
    gate = cost.budget_gate(run, tables.read("api_call"), budget)
    sent = None if gate.filter("exhausted").count() else select(tables, run, limit)
    if sent is None or sent.isEmpty():
        counts = tables.spark.createDataFrame([], "run_id bigint, sent bigint")
        nothing = tables.spark.createDataFrame([], "run_id bigint, report string")
        summaries = tables.spark.createDataFrame(
            [], "run_id bigint, health_verdict string, summary string, total_events bigint"
        )
        outcomes = lifecycle.run_outcome(gate, counts, nothing)
        tables.put_runs(lifecycle.write_summary(run, summaries, outcomes))
    else:
        record_findings(tables, ask(triage.prompt_payload(sent)), run, budget)
    return found["id"]
