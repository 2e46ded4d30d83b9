"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.identity import add_logger, add_service, template_hash
from logsift.functions.masking import normalize_lines
from logsift.functions.refs import expand_refs
from logsift.functions.severity import severity_rank
from logsift.operators import (
    buckets,
    cost,
    findings,
    history,
    lifecycle,
    quality,
    reports,
    templates,
    triage,
)
from logsift.plans import jobs
from logsift.session import configure, fresh_folder
from logsift.sources import adapters, streams
from logsift.sources.snapshots import Folder
from logsift.sources.tables import Tables
from logsift.streaming import jobs as streaming

Query = Callable[[SparkSession, str], DataFrame]

DAY_NS = adapters.DAY_NS
FIRST_END_NS = adapters.EPOCH_NS + DAY_NS
# Low enough to cut off something in the small tables as well.
TIGHT_LIMITS = {"critical_fatal": 8, "errors": 12, "warnings": 5, "system_issues": 20}
PROMPT_LIMIT = 25
BUDGET = 5.0
LATE_NS = adapters.EPOCH_NS + 12 * DAY_NS
FROM, TO = "2024-01-05 06:30:00", "2024-01-20 18:00:00"

_recorded: dict[tuple[str, str], Tables] = {}


def recorded(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables the two jobs leave behind, computed once per application and input.

    The reporting queries start from recorded tables, as they do in production; the shared
    folder holds them, so that losing an executor loses none of them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _recorded:
        tables = Tables(spark, fresh_folder(spark, "tables"))
        jobs.collect(tables, adapters.log_lines(spark, sf_dir), adapters.daily_runs(spark, sf_dir))
        tables.append_verdicts(adapters.verdict_events(tables.read("log_template")))
        tables.append_api_calls(adapters.event_calls(spark, sf_dir))
        selected = jobs.select(tables)
        runs = tables.read("run").select(F.col("id").alias("run_id"))
        responses = tables.replace_runs("model_report", adapters.model_reports(selected), runs)
        jobs.record_findings(tables, responses, tables.read("run"))
        _recorded[key] = tables
    return _recorded[key]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.log_lines(spark, sf_dir)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.tag_buckets(_lines(spark, sf_dir))


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _labels_shown(df: DataFrame) -> DataFrame:
    """The label map as two plain columns."""
    shown = {
        name: F.try_element_at("labels", F.lit(name))
        for name in ("compose_service", "container_name")
    }
    return df.withColumns(shown).drop("labels")


# --- sources and sinks ----------------------------------------------------------------------


def q_read_log_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all entries as stream responses, then read a range of them back."""
    folder = _responses(spark, sf_dir, broken=0)
    start = adapters.EPOCH_NS + 4 * DAY_NS
    return _labels_shown(streams.read_log_streams(spark, folder, start, start + 9 * DAY_NS))


def _responses(spark: SparkSession, sf_dir: str, broken: int) -> str:
    """A folder of responses, one for each entry; of every so many events one is cut off."""
    folder = fresh_folder(spark, "streams")
    entries = adapters.log_entries(spark, sf_dir)
    stream = F.struct(F.col("labels").alias("stream"), F.array("entry").alias("values"))
    whole = F.to_json(F.struct(F.struct(F.array(stream).alias("result")).alias("data")))
    cut = F.lit(False)
    if broken:
        number = F.try_element_at("entry", F.lit(1)).try_cast("bigint")
        cut = F.coalesce(number % broken == 0, F.lit(False))
    (
        entries.select(whole.alias("whole"), cut.alias("cut"))
        .select(F.expr("if(cut, substring(whole, 1, length(whole) - 2), whole)").alias("value"))
        .write.text(folder)
    )
    return folder


def q_failed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses cut off on their way: counted, and without lines."""
    return streams.failed_responses(spark, _responses(spark, sf_dir, broken=50))


def q_read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "lines")
    streams.write_log_lines(_lines(spark, sf_dir), folder)
    start = adapters.EPOCH_NS + 2 * DAY_NS + DAY_NS // 2
    return streams.read_log_lines(spark, folder, start, start + 3 * DAY_NS).select(
        "job", "ts_ns", "line"
    )


def q_lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.daily_runs(spark, sf_dir)
    return runs.select(
        "id",
        "window_end",
        templates.lookback_window(F.col("window_end")).alias("day_start"),
        templates.lookback_window(F.col("window_end"), 36).alias("long_start"),
    )


def q_assign_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per run when every run looks back 36 hours, so that windows overlap."""
    assigned = templates.assign_runs(_lines(spark, sf_dir), FIRST_END_NS, 24, 36)
    return assigned.groupBy("run_id", "job").agg(
        F.count("*").alias("lines"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )


def q_drop_malformed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_shown(streams.drop_malformed_entries(adapters.log_entries(spark, sf_dir)))


def q_append_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record the same runs twice; the second time must replace the first."""
    tables = Tables(spark, fresh_folder(spark, "occurrences"))
    rows = recorded(spark, sf_dir).read("template_occurrence")
    tables.append_occurrences(rows)
    tables.append_occurrences(rows.filter("run_id % 2 = 0"))
    return tables.read("template_occurrence").drop("exemplar_lines")


def q_append_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = recorded(spark, sf_dir)
    tables = Tables(spark, fresh_folder(spark, "findings"))
    rows, runs, known = (source.read(t) for t in ("finding", "run", "log_template"))
    tables.append_findings(rows, runs, known)
    tables.append_findings(rows.filter("run_id % 3 = 0"), runs, known)
    return tables.read("finding")


def q_append_api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, fresh_folder(spark, "calls"))
    calls = adapters.order_calls(spark, sf_dir)
    tables.append_api_calls(calls.filter("id % 2 = 0"))
    tables.append_api_calls(calls.filter("id % 2 = 1"))
    return tables.read("api_call").select("id", "run_id", "model", "estimated_cost_usd")


def q_start_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, fresh_folder(spark, "runs"))
    tables.start_runs(adapters.daily_runs(spark, sf_dir))
    return tables.read("run").select("id", "started_at", "window_start", "window_end", "status")


def q_bucket_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two buckets are there, two are missing."""
    root = fresh_folder(spark, "buckets")
    lines = _lines(spark, sf_dir)
    for name in ("errors", "system_issues"):
        buckets.bucket(lines, name).write.parquet(f"{root}/{name}")
    found = streams.bucket_fallback(spark, {b: f"{root}/{b}" for b in buckets.BUCKETS})
    return found.select("bucket", "job", "ts_ns", "line")


def q_bucket_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bucket with a broken file among others, one of broken files alone, two that are missing."""
    root = fresh_folder(spark, "buckets")
    buckets.bucket(_lines(spark, sf_dir), "errors").repartition(3).write.parquet(f"{root}/errors")
    for name in ("errors", "warnings"):
        Folder(spark, f"{root}/{name}").create("PAR1 cut off", "part-cut-off.parquet")
    paths = {b: f"{root}/{b}" for b in buckets.BUCKETS}
    losses = streams.bucket_losses(spark, paths)
    kept = streams.bucket_fallback(spark, paths, losses).groupBy("bucket").agg(F.count("*").alias("lines"))
    return losses.join(kept, "bucket", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


# --- filters --------------------------------------------------------------------------------


def _bucket_query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return buckets.bucket(_lines(spark, sf_dir), name).select("job", "ts_ns", "line")

    return query


def q_tag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select(
        "bucket", F.col("bucket_ord").cast("bigint").alias("bucket_ord"), "job", "ts_ns", "line"
    )


def q_union_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    parts = [
        buckets.bucket(lines, name).select(F.lit(name).alias("bucket"), "job", "ts_ns", "line")
        for name in buckets.BUCKETS
    ]
    return buckets.union_buckets(parts)


def q_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_counts(_entries(spark, sf_dir))


def q_bucket_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = jobs.run_entries(_lines(spark, sf_dir), adapters.daily_runs(spark, sf_dir))
    return buckets.bucket_limit(entries, TIGHT_LIMITS).select("run_id", "bucket", "job", "service_name", "ts_ns", "line")


def q_bucket_limit_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries, found from sketches of the times."""
    entries = jobs.run_entries(_lines(spark, sf_dir), adapters.daily_runs(spark, sf_dir))
    kept = buckets.newest_by_sketch(entries, TIGHT_LIMITS, ranked_rows=10)
    return kept.select("run_id", "bucket", "job", "service_name", "ts_ns", "line")


def q_dropped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What limits keep and drop of each run and bucket."""
    entries = jobs.run_entries(_lines(spark, sf_dir), adapters.daily_runs(spark, sf_dir))
    return buckets.limit_counts(entries, TIGHT_LIMITS)


def q_lines_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of runs whose windows have their own starts, overlaps and gaps."""
    runs = adapters.uneven_runs(spark, sf_dir)
    met = templates.lines_of_runs(_lines(spark, sf_dir), runs)
    return met.groupBy("run_id", "job").agg(
        F.count("*").alias("lines"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )


def q_collect_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after collecting the runs in three calls, one of them repeated."""
    tables = Tables(spark, fresh_folder(spark, "incremental"))
    lines, runs = _lines(spark, sf_dir), adapters.daily_runs(spark, sf_dir)
    for part in ("id <= 10", "id > 20", "id > 10 and id <= 20", "id > 20"):
        jobs.collect(tables, lines, runs.filter(part))
    return tables.read("log_template")


def q_time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = adapters.event_calls(spark, sf_dir)
    return reports.time_range_filter(calls, "created_at", _ts(FROM), _ts(TO)).select(
        "id", "created_at", "model"
    )


def q_suppress_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    verdicts = history.current_verdicts(tables.read("verdict_event"))
    return triage.suppress_benign(tables.read("log_template"), verdicts)


# --- masking and identity -------------------------------------------------------------------


def q_normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_lines(_lines(spark, sf_dir)).select("job", "ts_ns", "template_text")


def q_redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of sensitive shapes after masking, and how often lines had them before."""
    return quality.redaction_summary(normalize_lines(_lines(spark, sf_dir)))


def q_redaction_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that would show a sensitive shape if it were taken as a template as it is."""
    unmasked = _lines(spark, sf_dir).withColumn("template_text", F.col("line"))
    return quality.redaction_audit(unmasked).select("job", "ts_ns", "template_text", "leaked")


def q_placeholder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.placeholder_counts(normalize_lines(_lines(spark, sf_dir)))


def q_compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.compression_ratio(templates.templated(_lines(spark, sf_dir)))


def q_service_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = add_service(_lines(spark, sf_dir).filter("job != 'system'"))
    return lines.groupBy("service_name").agg(F.count("*").alias("lines"))


def q_service_from_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = add_service(_lines(spark, sf_dir).filter("job = 'system'"))
    return lines.groupBy("service_name").agg(F.count("*").alias("lines"))


def q_logger_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = add_logger(_lines(spark, sf_dir))
    return lines.groupBy("job", "logger").agg(F.count("*").alias("lines"))


def q_template_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = templates.templated(_lines(spark, sf_dir))
    digest = template_hash(F.col("service_name"), F.col("logger"), F.col("template_text"))
    return lines.select("ts_ns", "service_name", "logger", digest.alias("template_hash"))


def q_aggregate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.aggregate_templates(templates.templated(_lines(spark, sf_dir)))


def q_aggregate_bucket_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over bucket entries, where a line in two buckets counts twice."""
    return templates.aggregate_templates(templates.templated(_entries(spark, sf_dir)))


def q_aggregate_templates_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.aggregate_templates_dedup(templates.templated(_entries(spark, sf_dir)))


def q_top_log_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = q_aggregate_templates(spark, sf_dir)
    return counted.orderBy(F.col("count").desc(), "template_hash").limit(20)


def q_exemplar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.exemplar_lines(templates.templated(_entries(spark, sf_dir)))


def q_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.daily_runs(spark, sf_dir)
    rows = jobs.run_occurrences(jobs.run_entries(_lines(spark, sf_dir), runs), runs)
    return rows.withColumn("exemplar_lines", F.array_join("exemplar_lines", "\n"))


# --- history --------------------------------------------------------------------------------


def q_template_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.template_history(recorded(spark, sf_dir).read("template_occurrence"))


def q_merge_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold the later half of the runs into the history of the earlier half."""
    rows = recorded(spark, sf_dir).read("template_occurrence")
    old = history.template_history(rows.filter("run_id <= 15"))
    new = history.template_history(rows.filter("run_id > 15"))
    return history.merge_templates(old, new)


def q_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.daily_runs(spark, sf_dir).withColumn(
        "window_start", templates.lookback_window(F.col("window_end"), 36)
    )
    return history.non_overlapping_windows(runs)


def q_current_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_verdicts(recorded(spark, sf_dir).read("verdict_event"))


def q_validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = recorded(spark, sf_dir).read("log_template")
    return history.validate_verdicts(adapters.verdict_requests(known))


# --- triage ---------------------------------------------------------------------------------


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    return triage.pending_templates(
        tables.read("template_occurrence"),
        tables.read("log_template"),
        history.current_verdicts(tables.read("verdict_event")),
    )


def q_pending_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir).drop("exemplar_lines")


def q_select_for_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = triage.select_for_prompt(_pending(spark, sf_dir), PROMPT_LIMIT)
    return chosen.select("run_id", "rank", "template_hash", "new_this_window", "window_count")


def q_assign_template_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.template_refs(triage.select_for_prompt(_pending(spark, sf_dir), PROMPT_LIMIT))


def q_run_overflow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.run_overflow_counts(_pending(spark, sf_dir), PROMPT_LIMIT)


def q_window_total_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.window_total_events(recorded(spark, sf_dir).read("prompt_selection"))


def q_payload_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = triage.payload_entries(recorded(spark, sf_dir).read("prompt_selection"))
    return entries.withColumn("exemplar_lines", F.array_join("exemplar_lines", "\n"))


def q_prompt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.prompt_payload(recorded(spark, sf_dir).read("prompt_selection"), True)


# --- findings -------------------------------------------------------------------------------


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.decode_reports(recorded(spark, sf_dir).read("model_report"))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.explode_findings(findings.parse_reports(_decoded(spark, sf_dir)))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = triage.template_refs(recorded(spark, sf_dir).read("prompt_selection"))
    return findings.resolve_refs(_reported(spark, sf_dir), refs)


def q_parse_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = findings.parse_reports(_decoded(spark, sf_dir))
    return parsed.select(
        "run_id", "summary", "total_events", "health", F.size("findings").cast("bigint").alias("n")
    )


def q_failed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.failed_reports(_decoded(spark, sf_dir))


def q_explode_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir)


def q_expand_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.cited_refs(_reported(spark, sf_dir))


def q_expand_order_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written by hand in many ways, one text per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cited = F.expr(
        "case o_orderkey % 4 when 0 then concat('T', o_custkey, ' - t', o_custkey + o_orderkey % 5)"
        " when 1 then concat(o_custkey % 50, '; t', o_custkey, ', ', o_custkey % 50)"
        " when 2 then concat('t', o_custkey, '–', 't', greatest(o_custkey - 3, 0), ' x', o_orderkey)"
        " else concat('t1-t', o_orderkey, 'z , ;t', o_custkey) end"
    )
    return orders.select("o_orderkey", F.posexplode(expand_refs(cited)).alias("p", "ref")).select(
        "o_orderkey", F.col("p").cast("bigint").alias("position"), "ref"
    )


def q_resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.kept_findings(_resolved(spark, sf_dir))


def q_rejected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rejected_findings(_resolved(spark, sf_dir))


def q_severity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = recorded(spark, sf_dir).read("finding").withColumn(
        "severity_rank", severity_rank(F.col("severity")).cast("bigint")
    )
    return ranked.groupBy("severity", "severity_rank").agg(F.count("*").alias("findings"))


def q_latest_prior_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.latest_prior_severity(recorded(spark, sf_dir).read("finding"))


def q_finding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.finding_status(recorded(spark, sf_dir).read("finding").drop("status"))
    return rows.select("id", "run_id", "template_hash", "severity", "status")


def q_status_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of every run against all stored ones, later runs included."""
    stored = recorded(spark, sf_dir).read("finding").drop("status")
    rows = findings.status_against(stored, stored)
    return rows.select("id", "run_id", "template_hash", "severity", "status")


def q_quote_evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose issue quotes the template they are about."""
    tables = recorded(spark, sf_dir)
    texts = tables.read("log_template").select("template_hash", "template_text")
    quoting = tables.read("finding").join(texts, "template_hash").withColumn(
        "issue", F.concat("issue", F.lit(": "), "template_text")
    )
    return findings.quote_evidence_check(quoting, tables.read("template_occurrence"))


# --- lifecycle and cost ---------------------------------------------------------------------


def q_newest_pending_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest_pending_run(adapters.mixed_runs(spark, sf_dir))


def q_abandon_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.abandon_superseded(adapters.mixed_runs(spark, sf_dir)).select("id", "status")


def q_run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    gate = cost.budget_gate(tables.read("run"), tables.read("api_call"), BUDGET)
    sent = tables.read("prompt_selection").groupBy("run_id").agg(F.count("*").alias("sent"))
    return lifecycle.run_outcome(gate, sent, _decoded(spark, sf_dir))


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = findings.rejected_findings(_resolved(spark, sf_dir))
    return lifecycle.run_summary(findings.parse_reports(_decoded(spark, sf_dir)), rejected)


def q_estimate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = adapters.order_calls(spark, sf_dir)
    return calls.select("id", "model", *cost.TOKEN_COLUMNS, "estimated_cost_usd")


def q_month_to_date_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = adapters.event_calls(spark, sf_dir)
    return cost.month_to_date_spend(calls, _ts("2024-01-20 12:00:00"))


def q_monthly_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.monthly_spend(adapters.order_calls(spark, sf_dir))


def q_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.daily_runs(spark, sf_dir)
    return cost.budget_gate(runs, adapters.event_calls(spark, sf_dir), BUDGET)


# --- reports --------------------------------------------------------------------------------


def q_findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    runs = reports.time_range_filter(tables.read("run"), "started_at", _ts(FROM), _ts(TO))
    return reports.findings_by_severity(tables.read("finding"), runs)


def q_daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.daily_cost(adapters.order_calls(spark, sf_dir))


def q_daily_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.daily_tokens(adapters.order_calls(spark, sf_dir))


def _range_of_history(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    rows = recorded(spark, sf_dir).read("log_template")
    return reports.time_range_filter(rows, column, _ts(FROM), _ts("2024-02-01 00:00:00"))


def q_top_recurring_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_recurring_templates(_range_of_history(spark, sf_dir, "last_seen"))


def q_new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.new_templates(_range_of_history(spark, sf_dir, "first_seen"))


def q_run_health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_health_history(recorded(spark, sf_dir).read("run"))


def q_severity_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    return reports.severity_sections(tables.read("run"), tables.read("finding"))


def q_condensed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.condensed_sections(recorded(spark, sf_dir).read("finding"))


def q_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    return reports.report_sections(tables.read("run"), tables.read("finding"))


def q_report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = recorded(spark, sf_dir)
    calls = tables.read("api_call")
    gate = cost.budget_gate(tables.read("run"), calls)
    return reports.report_header(
        tables.read("run"), gate, cost.run_cost(calls), cost.DEFAULT_MONTHLY_BUDGET
    )


# --- checks ---------------------------------------------------------------------------------


def unchecked_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The order tables read as triage tables, with everything in them that breaks a rule."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    digest = F.sha2(F.expr("cast(l_suppkey + if(l_partkey % 97 = 0, 1000000, 0) as string)"), 256)
    run = adapters.daily_runs(spark, sf_dir).select(
        "id",
        "window_start",
        F.when(F.col("id") % 9 == 0, F.expr("window_start - interval 1 hour"))
        .otherwise(F.col("window_end"))
        .alias("window_end"),
        F.expr("if(id % 4 = 0, 'done', 'completed')").alias("status"),
        F.expr("case id % 5 when 0 then null when 1 then 'HIGH' else 'healthy' end").alias(
            "health_verdict"
        ),
        F.expr("if(id % 8 = 0, -1L, id)").alias("total_events"),
    )
    log_template = read("supplier").select(
        F.sha2(F.col("s_suppkey").cast("string"), 256).alias("template_hash"),
        F.expr("if(s_suppkey % 13 = 0, -1L, s_suppkey)").alias("total_count"),
        _ts("2024-01-02").alias("first_seen"),
        F.expr("if(s_suppkey % 17 = 0, timestamp'2024-01-01', timestamp'2024-01-03')").alias(
            "last_seen"
        ),
    )
    verdict = read("customer").select(
        F.sha2(F.expr("cast(c_custkey % 700 as string)"), 256).alias("template_hash"),
        F.expr("case c_custkey % 40 when 0 then 'ignore' when 1 then 'watch' else 'benign' end").alias(
            "classification"
        ),
    )
    finding = read("lineitem").select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("id"),
        F.expr("l_suppkey % 32 + 1").alias("run_id"),
        digest.alias("template_hash"),
        F.expr("case l_returnflag when 'A' then 'HIGH' when 'N' then 'LOW' else 'WARN' end").alias(
            "severity"
        ),
        F.expr("if(l_partkey % 50 = 0, 'open', 'new')").alias("status"),
    )
    api_call = read("orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("o_orderkey % 33 + 1").alias("run_id"),
        F.expr("if(o_orderkey % 110 = 0, -5L, o_orderkey)").alias("input_tokens"),
        F.col("o_custkey").alias("output_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_tokens"),
        F.expr("if(o_custkey % 120 = 0, -1L, 0L)").alias("cache_read_tokens"),
        F.expr("cast(if(o_orderkey % 130 = 0, -1, 10) as int)").alias("latency_ms"),
        F.lit(0).cast("decimal(10,6)").alias("estimated_cost_usd"),
    )
    return {
        "run": run,
        "log_template": log_template,
        "verdict": verdict,
        "finding": finding,
        "api_call": api_call,
    }


def _check(check: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: check(unchecked_tables(spark, sf_dir))


# --- streams --------------------------------------------------------------------------------


def _line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.lines_from(adapters.stream_reader(spark, sf_dir))


def _finished(query) -> None:
    query.awaitTermination()


def q_stream_template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_folder(spark, "stream")
    result = streaming.stream_template_counts(_line_stream(spark, sf_dir))
    _finished(streaming.write_windows(result, f"{root}/out", f"{root}/state"))
    return streaming.read_windows(spark, f"{root}/out")


def q_stream_late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later lines come first, so that many of the earlier ones miss their windows.

    A micro-batch drops what the one before it already took for late, so a day lies between the two.
    """
    root = fresh_folder(spark, "stream")
    lines, files = _lines(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ts = F.col("ts_ns")
    part = F.when(ts >= LATE_NS, "newer").when(ts >= LATE_NS - DAY_NS, "between").otherwise("older")
    # lines are made once; the parts differ in when they are handed in
    lines.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/made")
    made = spark.read.schema(lines.schema).option("recursiveFileLookup", "true")
    for name in ("newer", "between", "older"):
        made.parquet(f"{root}/made/part={name}").repartition(files).write.parquet(f"{root}/in/{name}")
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in/*")
    arrivals = streaming.Arrivals(spark, f"{root}/arrivals")
    result = streaming.stream_template_counts(source, arrivals=arrivals)
    _finished(streaming.write_windows(result, f"{root}/out", f"{root}/state"))
    arrivals.close()
    return streaming.late_lines(spark, f"{root}/out", f"{root}/arrivals").agg(
        *[F.sum(c).alias(c) for c in ("entries", "counted", "late")]
    )


def q_stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookback window of a day from every hour on.

    A pane is open as long as one of the windows that hold it, an hour beyond the last one's end.
    """
    root = fresh_folder(spark, "stream")
    panes = streaming.stream_template_counts(_line_stream(spark, sf_dir), "1 hour", "24 hours")
    _finished(streaming.write_windows(panes, f"{root}/out", f"{root}/state"))
    windows = streaming.sliding_counts(streaming.read_windows(spark, f"{root}/out"), 1, 24)
    return windows.drop("service_name", "logger", "template_text")


def q_stream_occurrence_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_folder(spark, "stream")
    lines = _line_stream(spark, sf_dir)
    _finished(streaming.stream_occurrence_sink(lines, f"{root}/out", f"{root}/state"))
    return streaming.read_batches(spark, f"{root}/out")


def q_stream_new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_folder(spark, "stream")
    lines = _line_stream(spark, sf_dir)
    _finished(streaming.stream_new_templates(lines, f"{root}/out", f"{root}/state"))
    return spark.read.parquet(f"{root}/out").drop("batch_id")


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    found = {
        name[2:]: value for name, value in globals().items() if name.startswith("q_")
    }
    for name in buckets.BUCKETS:
        found[f"bucket_{name}"] = _bucket_query(name)
    for check in ("check_domains", "check_ranges", "check_primary_keys", "check_foreign_keys"):
        found[check] = _check(getattr(quality, check))
    return {name: _configured(query) for name, query in found.items()}
