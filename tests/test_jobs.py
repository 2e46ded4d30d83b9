"""The two jobs run by run: own windows, repeated calls, statuses, outcomes, failed writes."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logsift import schemas
from logsift.operators import buckets, cost, reports, templates
from logsift.plans import jobs
from logsift.session import fresh_folder
from logsift.sources import streams
from logsift.sources.tables import Tables

MIDNIGHT = datetime(2031, 5, 6)
HOUR = timedelta(hours=1)
RUNS = "id bigint, started_at timestamp, window_start timestamp, window_end timestamp"


def ns(moment):
    return int((moment - datetime(1970, 1, 1)).total_seconds()) * 1_000_000_000


def run_rows(spark, *windows):
    """(id, start hour, end hour)"""
    rows = [(i, MIDNIGHT + b * HOUR, MIDNIGHT + a * HOUR, MIDNIGHT + b * HOUR) for i, a, b in windows]
    return spark.createDataFrame(rows, RUNS)


def log(spark, *entries):
    """(hour, text)"""
    rows = [
        ("docker", {"compose_service": "svc"}, ns(MIDNIGHT + h * HOUR) + i, json.dumps({"level": "error", "event": t}))
        for i, (h, t) in enumerate(entries)
    ]
    return spark.createDataFrame(rows, schemas.LOG_LINE)


def fresh(spark):
    return Tables(spark, fresh_folder(spark, "jobs"))


def table(tables, name, *columns):
    return sorted(tuple(r) for r in tables.read(name).select(*columns).collect())


def reply(severity):
    """Reports the first template of every payload with one severity."""

    def ask(payload):
        rows = []
        for r in payload.collect():
            first = json.loads(r["payload"])[0]
            finding = {
                "template_ref": first["template_ref"], "severity": severity, "service": "svc", "issue": "it fails",
                "count": first["count"], "first_seen": "a", "last_seen": "b", "recommendation": None,
            }
            report = {"summary": f"run {r['run_id']}", "total_events": 1, "health": "degraded", "findings": [finding]}
            body = {"content": [{"type": "tool_use", "name": "triage_report", "input": report}]}
            rows.append((r["run_id"], json.dumps(body)))
        return payload.sparkSession.createDataFrame(rows, "run_id bigint, response_json string")

    return ask


def test_lines_meet_the_windows_of_the_run_table(spark):
    runs = run_rows(spark, (4, 0.25, 5.5), (9, 4, 9), (7, 20, 21))
    lines = spark.createDataFrame([(ns(MIDNIGHT) + m * 60 * 10**9,) for m in range(0, 1500, 5)], "ts_ns bigint")
    got = {(r["run_id"], (r["ts_ns"] - ns(MIDNIGHT)) // (60 * 10**9)) for r in templates.lines_of_runs(lines, runs).collect()}
    spans = {4: (15, 330), 9: (240, 540), 7: (1200, 1260)}
    assert got == {(r, m) for r, (a, b) in spans.items() for m in range(0, 1500, 5) if a <= m < b}


def test_an_hour_with_most_of_the_lines_is_divided(spark):
    runs = run_rows(spark, (4, 0.25, 5.5), (9, 2.5, 9), (7, 20, 21))
    start = ns(MIDNIGHT)
    crowded = F.lit(start + 3 * 3600 * 10**9) + F.col("id") % 1000
    elsewhere = F.lit(start) + F.col("id") * 2 * 10**9
    lines = spark.range(0, 40_000, numPartitions=4).select(
        F.when(F.col("id") % 20 == 0, elsewhere).otherwise(crowded).alias("ts_ns"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"),
    )
    few = templates.lines_of_runs(lines, runs)
    many = templates.lines_of_runs(lines, runs, broadcast_rows=0)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()

    def rows(df):
        return sorted((r["run_id"], r["ts_ns"], r["line"]) for r in df.collect())

    assert rows(few) == rows(many) and many.columns == few.columns
    # no cell is large, and there are few of them
    divided = templates.full_hours(lines, 64)
    assert list(divided) == [(start // 10**9 // 3600) + 3] and 60 <= sum(divided.values()) <= 64
    timed, listed = templates._in_cells(*templates._hours(lines, runs), divided)
    cells = sorted(r["count"] for r in timed.groupBy("_hour", "_cell").count().collect())
    assert cells[-1] <= 2 * 40_000 / 64
    assert listed.filter("run_id = 9").count() == 6 + divided[list(divided)[0]]
    # the tasks of the join, each with the keys Spark deals it
    tasks = timed.repartition(8, "_hour", "_cell").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in tasks)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    empty = templates.lines_of_runs(lines.filter("false"), runs, broadcast_rows=0)
    assert empty.count() == 0


def test_a_single_run_counts_its_own_window(spark):
    lines = log(spark, (1, "disk 1 lost"), (2, "disk 2 lost"), (3, "fan 3 lost"), (26, "disk 4 lost"), (40, "fan 9 lost"))
    tables = fresh(spark)
    jobs.collect(tables, lines, run_rows(spark, (1, 0, 24.5)))
    jobs.collect(tables, lines, run_rows(spark, (2, 2, 27)))  # late, and overlapping
    jobs.collect(tables, lines, run_rows(spark, (3, 27, 30)))  # nothing in it
    assert table(tables, "template_occurrence", "run_id", "count") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert sorted(r[0] for r in table(tables, "log_template", "total_count")) == [2, 4]
    assert [r[0] for r in table(tables, "run", "id")] == [1, 2, 3]


def test_one_call_at_a_time_equals_one_call_and_repeats_change_nothing(spark):
    lines = log(spark, *[(h / 3, f"{('disk', 'fan', 'port')[h % 3]} {h} lost") for h in range(150)])
    windows = [(1, 0, 20), (2, 18, 30), (3, 33, 50)]
    whole, single = fresh(spark), fresh(spark)
    jobs.collect(whole, lines, run_rows(spark, *windows))
    for window in [*windows, windows[1], windows[0]]:
        jobs.collect(single, lines, run_rows(spark, window))
    columns = ["run_id", "template_hash", "count", "first_seen", "last_seen", "exemplar_lines"]
    assert table(whole, "template_occurrence", *columns) == table(single, "template_occurrence", *columns)
    history = ["template_hash", "total_count", "first_seen", "last_seen"]
    assert table(whole, "log_template", *history) == table(single, "log_template", *history)
    assert len(table(single, "run", "id")) == 3


def test_every_entry_counts_unless_limits_are_given(spark):
    """More entries of one bucket and run than any customary limit."""
    lines = spark.range(7000).select(
        F.lit("docker").alias("job"),
        F.create_map(F.lit("compose_service"), F.lit("svc")).alias("labels"),
        (F.lit(ns(MIDNIGHT)) + F.col("id") * 10**9).alias("ts_ns"),
        F.concat(F.lit('{"level":"error","event":"disk '), F.col("id"), F.lit(' lost"}')).alias("line"),
    )
    runs = run_rows(spark, (1, 0, 24))
    tables = fresh(spark)
    jobs.collect(tables, lines, runs)
    assert table(tables, "template_occurrence", "count") == [(7000,)]
    assert table(tables, "bucket_count", "run_id") == []
    jobs.collect(tables, lines, runs, dict(buckets.BUCKET_LIMITS))
    assert table(tables, "template_occurrence", "count") == [(2000,)]
    assert table(tables, "bucket_count", "bucket", "kept", "dropped") == [("errors", 2000, 5000)]
    assert table(tables, "log_template", "total_count") == [(2000,)]


def test_limits_of_any_height_keep_the_newest(spark, monkeypatch):
    """The sketched way against a plain ranking, with buckets that fit, ties, narrow rounds and poor sketches."""
    rows = spark.range(30_000, numPartitions=7).select(
        (F.col("id") % 2).alias("run_id"),
        F.expr("case when id % 10 < 6 then 'errors' when id % 10 < 9 then 'warnings' else 'system_issues' end").alias("bucket"),
        F.lit("docker").alias("job"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("service_name"),
        # warnings fall on a few instants, so that a limit cuts through a tie
        F.expr("case when id % 10 between 6 and 8 then id % 4 else (id * 7919) % 30011 end").alias("ts_ns"),
        F.concat(F.lit("line "), F.col("id")).alias("line"),
    )
    limits = {"errors": 4000, "warnings": 1234, "system_issues": 100_000}
    window = Window.partitionBy("run_id", "bucket").orderBy(F.desc("ts_ns"), "job", "service_name", "line")
    cap = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("bucket")]
    want = rows.withColumn("r", F.row_number().over(window)).filter(F.col("r") <= cap).drop("r")

    def same(got):
        return got.count() == want.count() and got.exceptAll(want).isEmpty()

    assert same(buckets.bucket_limit(rows, limits))
    assert same(buckets.newest_by_sketch(rows, limits, ranked_rows=5))
    monkeypatch.setattr(buckets, "SKETCH_SIZE", 8)  # misses, which counts find out
    monkeypatch.setattr(buckets, "SKETCH_MARGIN", 0)
    assert same(buckets.newest_by_sketch(rows, limits, ranked_rows=5))
    assert buckets.newest_by_sketch(rows, {"errors": 0}).count() == 0
    assert buckets.newest_by_sketch(rows.limit(0), limits).count() == 0


def test_only_the_bracket_is_ranked(spark, monkeypatch):
    rows = spark.range(200_000, numPartitions=8).select(
        F.lit(1).cast("bigint").alias("run_id"), F.lit("errors").alias("bucket"), F.lit("docker").alias("job"),
        F.lit("s").alias("service_name"), F.col("id").alias("ts_ns"), F.lit("x").alias("line"),
    )
    inside = []
    plain = buckets._cuts
    monkeypatch.setattr(buckets, "_cuts", lambda *a: inside.append(plain(*a)) or inside[-1])
    assert buckets.newest_by_sketch(rows, {"errors": 150_000}).agg(F.min("ts_ns")).first()[0] == 50_000
    assert inside[0].first()["_inside"] < 200_000 * 0.03


def test_the_cycle_run_by_run(spark):
    texts = [(1, "disk 1 lost"), (25, "disk 2 lost"), (49, "disk 3 lost"), (73, "disk 4 lost")]
    lines = log(spark, *texts)
    tables = fresh(spark)
    seen = []
    for day, severity in enumerate(["LOW", "LOW", "HIGH", "MEDIUM"]):
        jobs.collect(tables, lines, run_rows(spark, (day + 1, 24 * day, 24 * day + 24)))
        before = {r["id"]: r.asDict() for r in tables.read("run").filter(F.col("id") <= day).collect()}
        assert jobs.analyse(tables, reply(severity)) == day + 1
        after = {r["id"]: r.asDict() for r in tables.read("run").filter(F.col("id") <= day).collect()}
        assert after == before  # outcomes of earlier runs stay
        seen.append(tables.read("finding").filter(F.col("run_id") == day + 1).first()["status"])
    assert seen == ["new", "recurring", "escalating", "recurring"]
    assert {r[1] for r in table(tables, "run", "id", "status")} == {"completed"}
    assert table(tables, "run", "id", "summary")[2] == (3, "run 3")
    assert jobs.analyse(tables, reply("LOW")) is None


def test_older_runs_are_given_up_and_their_state_is_stored(spark):
    lines = log(spark, (1, "disk 1 lost"), (25, "disk 2 lost"), (49, "fan 3 lost"))
    tables = fresh(spark)
    jobs.collect(tables, lines, run_rows(spark, (1, 0, 24), (2, 24, 48), (3, 48, 72)))
    assert jobs.analyse(tables, reply("LOW")) == 3
    assert table(tables, "run", "id", "status") == [(1, "abandoned"), (2, "abandoned"), (3, "completed")]
    assert {r[0] for r in table(tables, "finding", "run_id")} == {3}


def test_names_of_an_old_run_keep_their_templates(spark):
    lines = log(spark, (1, "disk 1 lost"), (2, "disk 2 lost"), (3, "fan 3 lost"), (30, "fan 4 lost"))
    tables = fresh(spark)
    jobs.collect(tables, lines, run_rows(spark, (1, 0, 24)))
    columns = ["rank", "template_hash"]
    first = sorted(tuple(r) for r in jobs.select(tables).select(*columns).collect())
    verdict = (first[0][1], "benign", None, "ops", MIDNIGHT)
    tables.append_verdicts(spark.createDataFrame([verdict], schemas.VERDICT_EVENT))
    tables.append_verdicts(spark.createDataFrame([verdict], schemas.VERDICT_EVENT))
    assert tables.read("verdict_event").count() == 1
    jobs.collect(tables, lines, run_rows(spark, (2, 24, 48)))
    again = jobs.select(tables).filter("run_id = 1")
    assert sorted(tuple(r) for r in again.select(*columns).collect()) == first
    assert jobs.select(tables).filter("run_id = 2").count() == 1


def test_a_run_over_budget_or_without_templates_is_not_asked(spark):
    def never(payload):
        raise AssertionError("asked")

    tables = fresh(spark)
    jobs.collect(tables, log(spark, (1, "disk 1 lost")), run_rows(spark, (1, 0, 24)))
    call = (1, 1, "m", 0, 0, 0, 0, 5, None, MIDNIGHT)
    spent = spark.createDataFrame([call], schemas.API_CALL).withColumn(
        "estimated_cost_usd", F.lit(30).cast("decimal(10,6)")
    )
    tables.append_api_calls(spent)
    tables.append_api_calls(spent)
    assert tables.read("api_call").count() == 1
    assert jobs.analyse(tables, never) == 1
    assert table(tables, "run", "status") == [("budget_exhausted",)]
    empty = fresh(spark)
    jobs.collect(empty, log(spark, (1, "disk 1 lost")), run_rows(spark, (5, 30, 40)))
    assert jobs.analyse(empty, never) == 5
    assert table(empty, "run", "status") == [("completed",)]
    gate = cost.budget_gate(empty.read("run"), empty.read("api_call"))
    costs = spark.createDataFrame([], "run_id bigint, run_cost_usd double")
    assert reports.report_header(empty.read("run"), gate, costs, 20.0).count() == 0  # sent nothing


def test_a_write_that_fails_half_way_is_never_seen(spark):
    tables = fresh(spark)
    lines = log(spark, (1, "disk 1 lost"), (2, "fan 2 lost"))
    jobs.collect(tables, lines, run_rows(spark, (1, 0, 24)))
    before = table(tables, "template_occurrence", "template_hash", "count")
    old = tables.read("template_occurrence")
    broken = old.withColumn("count", F.when(F.col("template_text").contains("fan"), F.raise_error(F.lit("lost"))).otherwise(F.lit(9).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        tables.append_occurrences(broken)
    # data without an entry in the list of versions, as a writer leaves them that dies before it
    tables._stage("template_occurrence", old.withColumn("count", F.lit(7).cast("bigint")))
    assert table(tables, "template_occurrence", "template_hash", "count") == before
    jobs.collect(tables, lines, run_rows(spark, (1, 0, 24)))
    assert table(tables, "template_occurrence", "template_hash", "count") == before


def test_two_writers_of_different_runs_do_not_meet(spark):
    tables = fresh(spark)
    jobs.collect(tables, log(spark, (1, "disk 1 lost"), (25, "fan 1 lost")), run_rows(spark, (1, 0, 24), (2, 24, 48)))
    rows = tables.read("template_occurrence")
    one = tables._stage("template_occurrence", rows.filter("run_id = 1").withColumn("count", F.lit(5).cast("bigint")))
    two = tables._stage("template_occurrence", rows.filter("run_id = 2").withColumn("count", F.lit(6).cast("bigint")))
    for run, version in ((2, two), (1, one)):
        tables._publish("template_occurrence", version, spark.createDataFrame([(run,)], "run bigint"))
    assert table(tables, "template_occurrence", "run_id", "count") == [(1, 5), (2, 6)]


def test_spend_of_a_month_ends_at_the_moment_asked(spark):
    days = [(1, datetime(2031, 5, 5)), (2, datetime(2031, 5, 25)), (4, datetime(2031, 4, 30))]
    calls = spark.createDataFrame(days, "c int, created_at timestamp").withColumn(
        "estimated_cost_usd", F.col("c").cast("decimal(10,6)")
    )
    for moment, spend in (("2031-05-20", 1.0), ("2031-05-25", 1.0), ("2031-05-26", 3.0), ("2031-05-01", 0.0)):
        assert cost.month_to_date_spend(calls, F.lit(moment).cast("timestamp")).first()[0] == spend


def test_broken_responses_are_counted_and_unreadable_buckets_are_empty(spark):
    folder = fresh_folder(spark, "responses")
    good = '{"data":{"result":[{"stream":{"job":"docker"},"values":[["5","a"],["6","b"]]}]}}'
    rows = [good, good[:-9], good]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(folder)
    assert streams.read_log_streams(spark, folder, 0, 100).count() == 4
    counted = streams.failed_responses(spark, folder).first()
    assert (counted["responses"], counted["failed"]) == (3, 1)
    root = fresh_folder(spark, "buckets")
    log(spark, (1, "disk 1 lost")).write.parquet(f"{root}/errors")
    os.makedirs(f"{root}/warnings")
    with open(f"{root}/warnings/part-0.parquet", "wb") as file:
        file.write(b"PAR1 cut off")
    paths = {name: f"{root}/{name}" for name in buckets.BUCKETS}
    assert [r["bucket"] for r in streams.bucket_fallback(spark, paths).collect()] == ["errors"]
    states = {r["bucket"]: r["state"] for r in streams.bucket_states(spark, paths).collect()}
    assert states == {
        "critical_fatal": "missing", "errors": "read", "warnings": "unreadable", "system_issues": "missing",
    }


def test_a_broken_page_costs_one_file(spark):
    """Of three files one has a page that can't be decoded: the other two count, and the loss is recorded."""
    root = fresh_folder(spark, "buckets")
    lines = log(spark, *[(h / 10, f"disk {h} lost") for h in range(90)])
    lines.repartition(3).write.parquet(f"{root}/errors")
    names = sorted(n for n in os.listdir(f"{root}/errors") if n.endswith(".parquet"))
    whole = spark.read.parquet(f"{root}/errors/{names[1]}").count()
    with open(f"{root}/errors/{names[1]}", "r+b") as file:
        file.seek(30)  # within the first page; the footer stays as it is
        file.write(b"\xff" * 60)
    os.remove(f"{root}/errors/.{names[1]}.crc")
    paths = {name: f"{root}/{name}" for name in buckets.BUCKETS}
    rows = {r["bucket"]: tuple(r)[1:] for r in streams.bucket_losses(spark, paths).collect()}
    assert rows["errors"] == ("partly", 3, 1, whole) and rows["warnings"] == ("missing", 0, 0, 0)
    assert streams.bucket_fallback(spark, paths).count() == 90 - whole
    tables = fresh(spark)
    jobs.collect_buckets(tables, paths, run_rows(spark, (1, 0, 24), (2, 24, 48)))
    assert table(tables, "template_occurrence", "run_id", "count") == [(1, 90 - whole)]
    assert table(tables, "bucket_loss", "run_id", "bucket", "state", "lost_rows") == sorted(
        (run, bucket, *(("partly", whole) if bucket == "errors" else ("missing", 0))) for run in (1, 2) for bucket in buckets.BUCKETS
    )
    other = fresh(spark)
    jobs.collect(other, lines.limit(0), run_rows(spark, (1, 0, 24)))
    assert table(other, "bucket_loss", "run_id") == []


def test_evidence_takes_linear_time_and_needs_a_quote(spark):
    sample = "worker 7 panic: index out of range in stage two"
    issues = [
        "it says 'panic: index out of range' twice",
        "a panic: of another kind",
        "panic: short",
        "segfault " + "x" * 20_000 + " index out of range in ",
        "no such word, index out of range in stage two",
    ]
    rows = [(i, 1, "h", "HIGH", text, None, "new") for i, text in enumerate(issues)]
    known = spark.createDataFrame([(1, "h", ["unrelated", sample])], "run_id bigint, template_hash string, exemplar_lines array<string>")
    from logsift.operators.findings import quote_evidence_check

    found = quote_evidence_check(spark.createDataFrame(rows, schemas.FINDING), known)
    assert {r["id"]: r["has_evidence"] for r in found.collect()} == {0: True, 1: False, 2: False, 3: True}


def test_winnowing_finds_every_quote(spark):
    """Random texts over two letters, where pieces repeat and tie, against a plain search."""
    import random

    from logsift.operators.findings import QUOTE_LENGTH, minimisers, quote_evidence_check

    random.seed(4)
    rows, samples = [], []
    for i in range(150):
        quote = "".join(random.choice("ab") for _ in range(random.choice([19, 20, 21, 40])))
        issue = "panic: " + "".join(random.choice("ab") for _ in range(random.randrange(30))) + quote
        sample = "".join(random.choice("abc") for _ in range(random.randrange(40))) + quote[: random.choice([19, 20, 99])] + " panic:"
        rows.append((i, 1, f"h{i}", "HIGH", issue, None, "new"))
        samples.append((1, f"h{i}", [sample, "panic: other"]))
    known = spark.createDataFrame(samples, "run_id bigint, template_hash string, exemplar_lines array<string>")
    found = quote_evidence_check(spark.createDataFrame(rows, schemas.FINDING), known)
    got = {r["id"]: r["has_evidence"] for r in found.collect()}
    for (i, *_, issue, _, _), (_, _, lines) in zip(rows, samples):
        quotes = {issue[j : j + QUOTE_LENGTH] for j in range(len(issue) - QUOTE_LENGTH + 1)}
        assert got[i] == any(q in line for q in quotes for line in lines)
    assert 20 < sum(got.values()) < 130
    long = spark.createDataFrame([("".join(random.choice("abcdefgh ") for _ in range(20_000)),), ("short",)], "t string")
    counts = [r[0] for r in long.select(F.size(minimisers("t"))).collect()]
    assert 0 < counts[0] < 20_000 / 5 and counts[1] in (None, -1)
