from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsift import schemas
from logsift.functions.refs import expand_refs
from logsift.operators import buckets, cost, findings, history, lifecycle, quality, templates, triage
from logsift.session import fresh_folder
from logsift.sources import streams
from logsift.sources.tables import InvalidBatch, Tables

NOON = datetime(2026, 9, 24, 12)
DAY = timedelta(days=1)
PENDING = (
    "run_id bigint, template_hash string, service_name string, logger string, template_text string,"
    " window_count bigint, total_count bigint, first_seen timestamp, last_seen timestamp,"
    " window_start timestamp, window_end timestamp, exemplar_lines array<string>,"
    " classification string, note string"
)


def pending(spark, rows):
    """rows of (hash, window_count, lifetime, first_seen)"""
    data = [
        (1, h, "svc", "app", "t <NUM>", w, n, seen, seen, NOON, NOON + DAY, ["t 1"], None, None)
        for h, w, n, seen in rows
    ]
    df = spark.createDataFrame(data, PENDING)
    return df.withColumn("new_this_window", F.col("first_seen") >= F.col("window_start"))


def test_new_templates_come_first_then_window_volume(spark):
    old, new = NOON - 10 * DAY, NOON + timedelta(hours=1)
    rows = [
        ("old_loud_lifetime", 5, 1_000_000, old),
        ("old_loud_window", 500, 600, old),
        ("new_rare", 1, 1, new),
        ("new_busier", 3, 3, new),
    ]
    few = triage.select_for_prompt(pending(spark, rows), 3).orderBy("rank").collect()
    assert [r["template_hash"] for r in few] == ["new_busier", "new_rare", "old_loud_window"]
    assert triage.select_for_prompt(pending(spark, rows), 0).count() == 0
    assert triage.select_for_prompt(pending(spark, rows), -1).count() == 0
    counts = triage.run_overflow_counts(pending(spark, rows), 3).first()
    assert (counts["eligible"], counts["sent"], counts["over_cap"]) == (4, 3, 1)


def test_ties_are_broken_by_hash(spark):
    rows = [("b", 1, 1, NOON - DAY), ("a", 1, 1, NOON - DAY)]
    refs = triage.template_refs(triage.select_for_prompt(pending(spark, rows), 10))
    assert {r["template_ref"]: r["template_hash"] for r in refs.collect()} == {"t1": "a", "t2": "b"}


def test_payload_states_window_counts_and_no_hash(spark):
    import json

    selected = triage.select_for_prompt(pending(spark, [("a" * 64, 7, 9999, NOON + DAY / 12)]))
    row = triage.prompt_payload(selected).first()
    assert row["window_start"] == "2026-09-24T12:00:00+00:00"
    assert row["window_end"] == "2026-09-25T12:00:00+00:00"
    (entry,) = json.loads(row["payload"])
    assert (entry["count"], entry["lifetime_count"], entry["new_this_window"]) == (7, 9999, True)
    assert entry["template_ref"] == "t1" and entry["verdict"] is None
    assert entry["exemplar_lines"] == ["t 1"]
    assert "a" * 64 not in row["payload"]
    redacted = triage.prompt_payload(selected, redact_exemplars=True).first()
    assert json.loads(redacted["payload"])[0]["exemplar_lines"] == ["t <NUM>"]


# References written for this test.
REFS = {
    "t12": ["t12"],
    "\tT12\n": ["t12"],
    "007": ["t007"],
    "t8;t6;t7": ["t8", "t6", "t7"],
    "t4-t6 t1": ["t4", "t5", "t6", "t1"],
    "t11-t9": ["t9", "t10", "t11"],
    "10 – 12": ["t10", "t11", "t12"],
    "T3 -T4": ["t3", "t4"],
    "t5,t5;t4-t6": ["t5", "t4", "t6"],
    "t003-5": ["t3", "t4", "t5"],
    ";;": [],
    "ABCDEF": ["abcdef"],
    "t2-last": ["t2-last"],
    "t2-t3-t4": ["t2-t3-t4"],
    "t+20-t+21": ["t20", "t21"],
    "1-2000": [f"t{n}" for n in range(1, 1026)],
    "18446744073709551616-3": ["18446744073709551616-3"],
}


def test_expand_refs(spark):
    rows = spark.createDataFrame([(k,) for k in REFS], "cited string")
    found = rows.select("cited", expand_refs(F.col("cited")).alias("refs")).collect()
    assert {r["cited"]: r["refs"] for r in found} == REFS


FINDINGS = (
    "run_id bigint, finding_no bigint, template_ref string, severity string, service string,"
    " issue string, count bigint, first_seen string, last_seen string, recommendation string"
)


def resolve(spark, cited, sent=6):
    rows = [(1, i, ref, "HIGH", "s", "issue", 1, "", "", None) for i, ref in enumerate(cited)]
    refs = spark.createDataFrame(
        [(1, f"t{n}", str(n) * 64) for n in range(1, sent + 1)],
        "run_id bigint, template_ref string, template_hash string",
    )
    resolved = findings.resolve_refs(spark.createDataFrame(rows, FINDINGS), refs)
    kept = findings.kept_findings(resolved).orderBy("id").collect()
    return (
        [(r["template_hash"][0], r["issue"]) for r in kept],
        [r["template_ref"] for r in findings.rejected_findings(resolved).orderBy("finding_no").collect()],
    )


def test_findings_attach_to_the_first_sent_ref(spark):
    cover = " (Grouped finding: also covers {}.)".format
    kept, rejected = resolve(
        spark,
        ["6", "t5;t1", "t3-t4 T6", "nothing t2", "t0-t900", "t7", "f00d", ";", "t40-t41"],
    )
    assert kept == [
        ("6", "issue"),
        ("5", "issue" + cover("t1")),
        ("3", "issue" + cover("t4, t6")),
        ("2", "issue"),
        ("1", "issue" + cover("t2, t3, t4, t5, t6")),
    ]
    assert rejected == ["t7", "f00d", ";", "t40-t41"]


def test_status_follows_the_latest_earlier_run(spark):
    columns = "id bigint, run_id bigint, template_hash string, severity string"
    rows = [
        (1, 1, "a", "LOW"),
        (2, 2, "a", "HIGH"),
        (3, 3, "a", "HIGH"),
        (4, 4, "a", "MEDIUM"),
        (5, 4, "b", "INFO"),
        (6, 4, "b", "CRITICAL"),
        (7, 5, "b", "CRITICAL"),
    ]
    all_runs = findings.finding_status(spark.createDataFrame(rows, columns))
    assert {r["id"]: r["status"] for r in all_runs.collect()} == {
        1: "new",
        2: "escalating",
        3: "recurring",
        4: "recurring",
        5: "new",  # findings of one run never see each other
        6: "new",
        7: "recurring",
    }
    stored = spark.createDataFrame(rows, columns)
    new = stored.filter("run_id = 4")
    again = findings.status_against(new, stored)
    assert {r["id"]: r["status"] for r in again.collect()} == {
        4: "recurring",
        5: "recurring",  # run 5 is stored already: another run, and the latest
        6: "recurring",
    }


def test_reports_without_the_call_or_a_field_fail(spark):
    finding = (
        '{"template_ref":"t1","severity":"HIGH","service":"s","issue":"i","count":1,'
        '"first_seen":"a","last_seen":"b"}'
    )
    report = '{"summary":"s","total_events":2,"health":"degraded","findings":[%s]}'
    call = '{"content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"triage_report","input":%s}]}'
    rows = [
        (1, call % (report % finding)),
        (2, '{"content":[{"type":"text","text":"no"}]}'),
        (3, call % '{"summary":"s","total_events":2,"health":"degraded"}'),
        (4, call % (report % '{"template_ref":"t1"}')),
        (5, (call % (report % "")).replace("triage_report", "other")),
        (6, call % (report % "")),
        (7, "not json"),
    ]
    decoded = findings.decode_reports(
        spark.createDataFrame(rows, "run_id bigint, response_json string")
    )
    assert sorted(r["run_id"] for r in findings.parse_reports(decoded).collect()) == [1, 6]
    assert sorted(r["run_id"] for r in findings.failed_reports(decoded).collect()) == [2, 3, 4, 5, 7]


def test_cost_of_known_and_unknown_models(spark):
    columns = (
        "model string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint,"
        " cache_read_tokens bigint"
    )
    rows = [
        ("claude-haiku-4-5", 1_000_000, 1_000_000, 0, 0),
        ("claude-haiku-4-5", 0, 0, 0, 1_000_000),
        ("some-future-model", 1000, 1000, 0, 0),
    ]
    costs = cost.estimate_cost(spark.createDataFrame(rows, columns)).collect()
    assert sorted(float(r["estimated_cost_usd"]) for r in costs) == [0.0, 0.1, 6.0]


def test_spend_before_matches_a_plain_sum(spark):
    """Runs and calls at the same instants, across hours and months."""
    start = datetime(2024, 1, 30)
    calls = [(i, start + timedelta(seconds=17 * i, microseconds=i % 3), i % 7) for i in range(20000)]
    calls += [(10**6 + i, start + timedelta(seconds=5), 1) for i in range(50)]
    runs = [(r, start + timedelta(hours=7 * r, seconds=r % 2)) for r in range(14)]
    runs += [(100 + r, start + timedelta(seconds=5, microseconds=r)) for r in range(3)]
    spent = cost.spend_before(
        spark.createDataFrame(runs, "id bigint, started_at timestamp"),
        spark.createDataFrame(calls, "id bigint, created_at timestamp, c bigint").withColumn(
            "estimated_cost_usd", F.col("c").cast("decimal(10,6)")
        ),
    ).collect()
    for r in spent:
        at = r["started_at"]
        month = at.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        assert r["spend"] == sum(c for _, t, c in calls if month <= t < at), r
    assert len(spent) == len(runs)


def test_run_lifecycle(spark):
    rows = [(i, NOON, NOON, NOON + DAY, None, None, s, None) for i, s in enumerate(
        ["completed", "running", "running", "failed", "running"], 1)]
    runs = spark.createDataFrame(rows, schemas.RUN)
    assert lifecycle.newest_pending_run(runs).first()["run_id"] == 5
    after = lifecycle.abandon_superseded(runs).orderBy("id").collect()
    assert [r["status"] for r in after] == ["completed", "abandoned", "abandoned", "failed", "running"]
    idle = runs.filter("status <> 'running'")
    assert lifecycle.newest_pending_run(idle).count() == 0
    assert lifecycle.abandon_superseded(idle).count() == 2
    gate = spark.createDataFrame(
        [(1, True), (2, False), (3, False), (4, False)], "run_id bigint, exhausted boolean"
    )
    sent = spark.createDataFrame([(1, 5), (3, 5), (4, 5)], "run_id bigint, sent bigint")
    decoded = spark.createDataFrame([(3, "x"), (4, None)], "run_id bigint, report string")
    outcome = lifecycle.run_outcome(gate, sent, decoded).orderBy("run_id").collect()
    assert [r["status"] for r in outcome] == ["budget_exhausted", "completed", "completed", "failed"]


def test_verdicts(spark):
    events = spark.createDataFrame(
        [
            ("a" * 64, "watch", "first", "x", NOON),
            ("a" * 64, "benign", None, "y", NOON + DAY),
            ("A" * 64, "known-issue", None, "y", NOON),
            ("a" * 63, "benign", None, "y", NOON),
            ("g" * 64, "benign", None, "y", NOON),
            ("b" * 64, "ignore", None, "y", NOON),
        ],
        schemas.VERDICT_EVENT,
    )
    last = history.current_verdicts(events).filter(F.col("template_hash") == "a" * 64).first()
    assert (last["classification"], last["note"], last["set_by"]) == ("benign", None, "y")
    wrong = history.validate_verdicts(events).collect()
    assert sorted((r["template_hash"][0], r["reason"]) for r in wrong) == [
        ("a", "template_hash"),
        ("b", "classification"),
        ("g", "template_hash"),
    ]


def test_bucket_limit_keeps_the_newest_of_a_hot_bucket(spark):
    lines = spark.range(0, 30000, numPartitions=6).select(
        F.lit(1).cast("bigint").alias("run_id"),
        F.when(F.col("id") % 3 > 0, "errors").otherwise("warnings").alias("bucket"),
        F.lit("docker").alias("job"),
        F.lit("s").alias("service_name"),
        (F.col("id") * 7919 % 30011).alias("ts_ns"),
        F.col("id").cast("string").alias("line"),
    )
    kept = buckets.bucket_limit(lines, {"errors": 40, "warnings": 3}).collect()
    for name, limit in (("errors", 40), ("warnings", 3)):
        all_rows = [r["ts_ns"] for r in lines.filter(F.col("bucket") == name).collect()]
        got = sorted((r["ts_ns"] for r in kept if r["bucket"] == name), reverse=True)
        assert got == sorted(all_rows, reverse=True)[:limit]
    plan = buckets.bucket_limit(lines)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bucket_words_know_ascii_boundaries(spark):
    rows = [
        ("docker", "it was FATAL.", True),
        ("docker", "fatality", False),
        ("docker", "nonfatal", False),
        ("docker", "éfatal", True),
        ("docker", "oom-killed", True),
        ("docker", "xoom-killed", False),
        ("docker", "core dump", True),
        ("system", "fatal", False),
    ]
    df = spark.createDataFrame(rows, "job string, line string, hit boolean")
    assert df.withColumn("is", buckets.is_critical_fatal()).filter("is <> hit").count() == 0


def test_overlapping_windows_hold_a_line_twice(spark):
    hour = templates.HOUR_NS
    lines = spark.createDataFrame([(h * hour,) for h in range(-40, 80)], "ts_ns bigint")
    # run r ends at hour 24 * r and looks back 36 hours
    runs = templates.assign_runs(lines, 24 * hour, 24, 36)
    got = {(r["ts_ns"] // hour, r["run_id"]) for r in runs.collect()}
    want = {(h, r) for h in range(-40, 80) for r in range(1, 9) if 24 * r - 36 <= h < 24 * r}
    assert got == want
    plain = templates.assign_runs(lines, 24 * hour)
    got = {(r["ts_ns"] // hour, r["run_id"]) for r in plain.collect()}
    assert got == {(h, h // 24 + 1) for h in range(0, 80)}


def test_malformed_entries(spark):
    rows = [
        ({"job": "docker"}, ["10", "a"]),
        ({"job": "docker"}, ["+11", "b", "meta"]),
        ({"job": "docker"}, ["1.5", "c"]),
        ({"job": "docker"}, [" 12", "d"]),
        ({"job": "docker"}, ["13"]),
        ({"job": "docker"}, []),
        ({"job": "docker"}, ["99999999999999999999", "e"]),
        ({"job": "docker"}, ["-5", "f"]),
        ({}, ["-2000000000", "g"]),
    ]
    df = spark.createDataFrame(rows, "labels map<string,string>, entry array<string>")
    kept = streams.drop_malformed_entries(df).orderBy("ts_ns").collect()
    assert [(r["job"], r["ts_ns"], r["line"]) for r in kept] == [
        ("", -2000000000, "g"),
        ("docker", 10, "a"),
        ("docker", 11, "b"),
    ]


def test_findings_are_written_all_or_nothing(spark):
    tables = Tables(spark, fresh_folder(spark, "test"))
    runs = spark.createDataFrame(
        [(1, NOON, NOON, NOON + DAY, None, None, "running", None)], schemas.RUN
    )
    known = spark.createDataFrame(
        [("a" * 64, "svc", "app", "t", NOON, NOON, 1)], schemas.LOG_TEMPLATE
    )

    def batch(*hashes):
        return spark.createDataFrame(
            [(i, 1, h, "HIGH", "i", None, "new") for i, h in enumerate(hashes)], schemas.FINDING
        )

    with pytest.raises(InvalidBatch):
        tables.append_findings(batch("a" * 64, "f" * 64), runs, known)
    assert tables.read("finding").count() == 0
    tables.append_findings(batch("a" * 64), runs, known)
    tables.append_findings(batch("a" * 64), runs, known)
    assert tables.read("finding").count() == 1


def test_a_verdict_may_come_before_its_template(spark):
    tables = {
        "verdict": spark.createDataFrame([("c" * 64, "watch")], "template_hash string, classification string"),
        "log_template": spark.createDataFrame([], schemas.LOG_TEMPLATE),
    }
    assert quality.check_foreign_keys({**tables, "run": spark.createDataFrame([], schemas.RUN),
        "finding": spark.createDataFrame([], schemas.FINDING)}).count() == 0
