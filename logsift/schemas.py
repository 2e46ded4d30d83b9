"""Table schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _LONG, _TIME = T.StringType(), T.LongType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STREAM = _table(stream=T.MapType(_TEXT, _TEXT), values=T.ArrayType(T.ArrayType(_TEXT)))
STREAM_RESPONSE = _table(data=_table(result=T.ArrayType(STREAM)))
LOG_LINE = _table(job=_TEXT, labels=T.MapType(_TEXT, _TEXT), ts_ns=_LONG, line=_TEXT)
RUN = _table(
    id=_LONG,
    started_at=_TIME,
    window_start=_TIME,
    window_end=_TIME,
    health_verdict=_TEXT,
    summary=_TEXT,
    status=_TEXT,
    total_events=_LONG,
)
OCCURRENCE = _table(
    template_hash=_TEXT,
    run_id=_LONG,
    service_name=_TEXT,
    logger=_TEXT,
    template_text=_TEXT,
    count=_LONG,
    first_seen=_TIME,
    last_seen=_TIME,
    window_start=_TIME,
    window_end=_TIME,
    exemplar_lines=T.ArrayType(_TEXT),
)
LOG_TEMPLATE = _table(
    template_hash=_TEXT,
    service_name=_TEXT,
    logger=_TEXT,
    template_text=_TEXT,
    first_seen=_TIME,
    last_seen=_TIME,
    total_count=_LONG,
)
BUCKET_COUNT = _table(run_id=_LONG, bucket=_TEXT, kept=_LONG, dropped=_LONG)
BUCKET_LOSS = _table(
    run_id=_LONG, bucket=_TEXT, state=_TEXT, files=_LONG, broken_files=_LONG, lost_rows=_LONG
)
VERDICT_EVENT = _table(
    template_hash=_TEXT, classification=_TEXT, note=_TEXT, set_by=_TEXT, set_at=_TIME
)
PROMPT_SELECTION = _table(
    run_id=_LONG,
    template_hash=_TEXT,
    window_count=_LONG,
    window_start=_TIME,
    window_end=_TIME,
    exemplar_lines=T.ArrayType(_TEXT),
    classification=_TEXT,
    note=_TEXT,
    service_name=_TEXT,
    logger=_TEXT,
    template_text=_TEXT,
    first_seen=_TIME,
    last_seen=_TIME,
    total_count=_LONG,
    new_this_window=T.BooleanType(),
    rank=_LONG,
)
MODEL_RESPONSE_ROW = _table(run_id=_LONG, response_json=_TEXT)
RESOLVED_FINDING = _table(
    run_id=_LONG,
    finding_no=_LONG,
    template_ref=_TEXT,
    severity=_TEXT,
    service=_TEXT,
    issue=_TEXT,
    count=_LONG,
    first_seen=_TEXT,
    last_seen=_TEXT,
    recommendation=_TEXT,
    template_hash=_TEXT,
    issue_text=_TEXT,
)
FINDING = _table(
    id=_LONG,
    run_id=_LONG,
    template_hash=_TEXT,
    severity=_TEXT,
    issue=_TEXT,
    recommendation=_TEXT,
    status=_TEXT,
)
API_CALL = _table(
    id=_LONG,
    run_id=_LONG,
    model=_TEXT,
    input_tokens=_LONG,
    output_tokens=_LONG,
    cache_write_tokens=_LONG,
    cache_read_tokens=_LONG,
    latency_ms=T.IntegerType(),
    estimated_cost_usd=T.DecimalType(10, 6),
    created_at=_TIME,
)
REPORT = _table(
    summary=_TEXT,
    total_events=_LONG,
    health=_TEXT,
    findings=T.ArrayType(
        _table(
            template_ref=_TEXT,
            severity=_TEXT,
            service=_TEXT,
            issue=_TEXT,
            count=_LONG,
            first_seen=_TEXT,
            last_seen=_TEXT,
            recommendation=_TEXT,
        )
    ),
)
MODEL_RESPONSE = _table(
    content=T.ArrayType(_table(type=_TEXT, name=_TEXT, input=REPORT)),
)

# --- fixed values: domains ------------------------------------------------------------------
RUN_STATUSES = ["pending", "running", "completed", "failed", "budget_exhausted", "abandoned"]
HEALTH_VERDICTS = ["healthy", "degraded", "critical"]
CLASSIFICATIONS = ["benign", "known-issue", "watch"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
FINDING_STATUSES = ["new", "recurring", "escalating", "resolved"]
REPORT_TOOL = "triage_report"
