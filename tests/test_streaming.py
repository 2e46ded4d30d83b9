"""Streams against the batch jobs on the same lines, late lines, replays and first sightings."""

import json
import os

from pyspark.sql import functions as F

from logsift.operators.buckets import tag_buckets
from logsift.operators.templates import aggregate_templates, templated
from logsift.plans import registry
from logsift.schemas import LOG_LINE
from logsift.session import fresh_folder
from logsift.streaming import jobs

HOUR = 3_600_000_000_000
START = 1_704_067_200_000_000_000


def line(hour, text, n=0):
    body = json.dumps({"level": "error", "logger": "app", "event": text})
    return ("docker", {"compose_service": "s"}, START + hour * HOUR + n, body)


def add(spark, folder, rows):
    spark.createDataFrame(rows, LOG_LINE).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(LOG_LINE).option("maxFilesPerTrigger", 1).parquet(folder)


def counts(df):
    return {r["template_hash"]: (r["count"], r["first_ns"], r["last_ns"]) for r in df.collect()}


def test_sink_equals_batch_and_survives_a_replay(spark):
    root = fresh_folder(spark, "test")
    add(spark, f"{root}/in", [line(h, f"request {h} failed", h) for h in range(20)])
    add(spark, f"{root}/in", [line(h, f"request {h} slow") for h in range(9)])
    add(spark, f"{root}/in", [line(h, f"request {h} failed", 7) for h in range(5)])
    lines = spark.read.schema(LOG_LINE).parquet(f"{root}/in")
    batch = counts(aggregate_templates(templated(tag_buckets(lines))))

    def run(state):
        jobs.stream_occurrence_sink(
            source(spark, f"{root}/in"), f"{root}/out", f"{root}/{state}"
        ).awaitTermination()
        return counts(jobs.read_batches(spark, f"{root}/out"))

    assert run("state") == batch
    assert len(os.listdir(f"{root}/out")) > 2
    # without its checkpoint the stream starts over; the same batches replace themselves
    assert run("lost_state") == batch
    jobs.compact_batches(spark, f"{root}/out", f"{root}/compact")
    assert counts(jobs.read_batches(spark, f"{root}/compact")) == batch


def test_windows_equal_the_batch_and_late_lines_are_dropped(spark):
    root = fresh_folder(spark, "test")

    def run():
        result = jobs.stream_template_counts(source(spark, f"{root}/in"), watermark="2 hours")
        query = jobs.write_windows(result, f"{root}/out", f"{root}/state")
        query.awaitTermination()
        rows = jobs.read_windows(spark, f"{root}/out").collect()
        dropped = sum(
            int(s["numRowsDroppedByWatermark"])
            for p in query.recentProgress
            for s in p["stateOperators"]
        )
        return sorted((r["window_start"].day, r["count"]) for r in rows), dropped

    add(spark, f"{root}/in", [line(h, f"request {h} failed") for h in (1, 2, 3, 23)])
    assert run() == ([(1, 4)], 0)  # the day is still open, and there as it stands
    add(spark, f"{root}/in", [line(25, "request 1 failed"), line(4, "request 2 failed")])
    assert run() == ([(1, 5), (2, 1)], 0)
    add(spark, f"{root}/in", [line(27, "request 3 failed")])
    assert run() == ([(1, 5), (2, 2)], 0)
    add(spark, f"{root}/in", [line(5, "request 9 failed"), line(28, "request 3 failed")])
    assert run() == ([(1, 5), (2, 3)], 1)
    jobs.compact_windows(spark, f"{root}/out", f"{root}/compact")
    assert counts(jobs.read_windows(spark, f"{root}/compact")) == counts(jobs.read_windows(spark, f"{root}/out"))


def test_late_lines_are_counted_for_every_batch(spark):
    root = fresh_folder(spark, "test")

    def run():
        arrivals = jobs.Arrivals(spark, f"{root}/arrivals")
        lines = source(spark, f"{root}/in")
        result = jobs.stream_template_counts(lines, watermark="2 hours", arrivals=arrivals)
        jobs.write_windows(result, f"{root}/out", f"{root}/state").awaitTermination()
        arrivals.close()
        rows = jobs.late_lines(spark, f"{root}/out", f"{root}/arrivals").filter("entries > 0").orderBy("batch_id")
        return [(r["entries"], r["counted"], r["late"]) for r in rows.collect()]

    add(spark, f"{root}/in", [line(h, f"request {h} failed") for h in (1, 2, 3, 30)])
    assert run() == [(4, 4, 0)]
    # many late lines of one template are one row to the state; the lines are counted
    add(spark, f"{root}/in", [line(4, "request 9 failed", n) for n in range(50)] + [line(31, "request 1 failed")])
    assert run() == [(4, 4, 0), (51, 1, 50)]
    add(spark, f"{root}/in", [line(5, "request 9 failed"), line(29, "request 2 failed"), line(32, "fan 1 slow")])
    assert run() == [(4, 4, 0), (51, 1, 50), (3, 2, 1)]


def test_sliding_windows_add_up_their_panes(spark):
    root = fresh_folder(spark, "test")
    add(spark, f"{root}/in", [line(h, f"request {h} failed", h) for h in range(0, 60)])
    result = jobs.stream_template_counts(source(spark, f"{root}/in"), "12 hours")
    jobs.write_windows(result, f"{root}/out", f"{root}/state").awaitTermination()
    panes = jobs.read_windows(spark, f"{root}/out")
    assert panes.count() == 5
    rows = jobs.sliding_counts(panes, 12, 24).orderBy("window_start").collect()
    assert [r["count"] for r in rows] == [12, 24, 24, 24, 24, 12]
    assert rows[1]["first_ns"] == START and rows[1]["last_ns"] == START + 23 * HOUR + 23
    assert all((r["window_end"] - r["window_start"]).total_seconds() == 86400 for r in rows)


def sliding_query(spark, monkeypatch, *batches):
    """{window: count} of the query over micro-batches of lines, windows as hours from START."""
    root = fresh_folder(spark, "test")
    for rows in batches:
        add(spark, f"{root}/in", rows)
    monkeypatch.setattr(registry, "_line_stream", lambda session, _: source(session, f"{root}/in"))
    found = registry.q_stream_sliding_counts(spark, root).select(
        (F.unix_micros("window_start") - START // 1000) / (HOUR // 1000), "count", F.expr("window_end - window_start")
    )
    rows = found.collect()
    assert all(length.total_seconds() == 86400 for _, _, length in rows)
    assert len({start for start, _, _ in rows}) == len(rows)
    return {start: n for start, n, _ in rows}


def test_the_sliding_query_looks_at_a_window_from_every_hour_on(spark, monkeypatch):
    half, held = HOUR // 2, {start: 1 for start in range(-13, 14)}
    found = sliding_query(spark, monkeypatch, [line(10, "request 1 failed", half), line(13, "request 2 failed", half)])
    assert found == held | {start: 2 for start in range(-10, 11)}


def test_the_sliding_query_counts_a_line_while_a_window_that_holds_it_is_open(spark, monkeypatch):
    late = [line(8, "request 3 failed"), line(5, "request 4 failed")]
    found = sliding_query(spark, monkeypatch, [line(30, "request 1 failed")], [line(30, "request 2 failed", 1)], late)
    # the last window with the line of hour 8 ends at 32; that with the line of hour 5 ended at 29
    assert found == {start: 2 * (start > 6) + (start < 9) for start in range(-15, 31)}


def test_a_template_is_new_only_once(spark):
    root = fresh_folder(spark, "test")

    def run():
        jobs.stream_new_templates(
            source(spark, f"{root}/in"), f"{root}/out", f"{root}/state"
        ).awaitTermination()
        found = spark.read.parquet(f"{root}/out").orderBy("batch_id", "template_text")
        return [(r["batch_id"], json.loads(r["template_text"])["event"]) for r in found.collect()]

    add(spark, f"{root}/in", [line(1, "disk 1 failed"), line(2, "disk 2 failed")])
    assert run() == [(0, "disk <NUM> failed")]
    add(spark, f"{root}/in", [line(3, "disk 3 failed"), line(3, "fan 1 failed")])
    assert run() == [(0, "disk <NUM> failed"), (1, "fan <NUM> failed")]
    add(spark, f"{root}/in", [line(4, "fan 2 failed")])
    assert len(run()) == 2


def test_first_sightings_keep_the_state_of_one_period(spark):
    root = fresh_folder(spark, "test")
    sizes, day = [], 24
    words = [f"{a}{b}" for a in ("disk", "fan", "port", "pump", "belt") for b in "abcdefgh"]
    for period in range(8):
        # five kinds of every period are new, the others were met long ago or in the period before
        kinds = words[5 * period : 5 * period + 5] + words[: 5 * min(period, 1)] + words[5 * max(period - 1, 0) : 5 * period]
        add(spark, f"{root}/in", [line(period * day + i % day, f"{k} failed") for i, k in enumerate(kinds)])
        add(spark, f"{root}/in", [line(period * day + 23, f"{k} failed", 5) for k in kinds])
        query = jobs.stream_new_templates(
            source(spark, f"{root}/in"), f"{root}/out", f"{root}/state", clock=jobs.ns_to_timestamp("ts_ns")
        )
        query.awaitTermination()
        sizes += [int(s["numRowsTotal"]) for p in query.recentProgress for s in p["stateOperators"]]
    found = jobs.first_seen(spark, f"{root}/out")
    assert sorted(json.loads(r["template_text"])["event"] for r in found.collect()) == sorted(f"{w} failed" for w in words)
    assert max(sizes) <= 2 * 15 < len(words)

    # from one table the stream goes on as from many
    jobs.compact_first_seen(spark, f"{root}/out", f"{root}/compact")
    add(spark, f"{root}/next", [line(300, f"{words[3]} failed"), line(300, "valve stuck")])
    jobs.stream_new_templates(source(spark, f"{root}/next"), f"{root}/compact", f"{root}/other").awaitTermination()
    after = jobs.first_seen(spark, f"{root}/compact")
    assert after.count() == len(words) + 1
    assert [json.loads(r["template_text"])["event"] for r in after.filter("batch_id >= 0").collect()] == ["valve stuck"]


def test_first_sightings_survive_a_replay(spark):
    root = fresh_folder(spark, "test")
    add(spark, f"{root}/in", [line(1, "disk 1 failed"), line(2, "fan 2 failed")])

    def run(state):
        jobs.stream_new_templates(source(spark, f"{root}/in"), f"{root}/out", f"{root}/{state}").awaitTermination()
        return sorted((r["batch_id"], r["template_hash"], r["first_ns"]) for r in jobs.first_seen(spark, f"{root}/out").collect())

    assert jobs.first_seen(spark, f"{root}/out").isEmpty()
    once = run("state")
    assert len(once) == 2 and run("lost_state") == once


def test_hot_template_in_one_run(spark):
    """A third of the lines share one template; samples and counts match a plain computation."""
    from logsift.operators.templates import occurrences

    lines = spark.range(0, 90_000, numPartitions=8).select(
        F.lit(1).cast("bigint").alias("run_id"),
        (F.col("id") % 2).cast("int").alias("bucket_ord"),
        F.lit("docker").alias("job"),
        F.create_map(F.lit("compose_service"), F.lit("s")).alias("labels"),
        (F.col("id") * 7919 % 90_001).alias("ts_ns"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot "), (F.col("id") % 30_000).cast("string")))
        .otherwise(F.concat(F.lit("cold "), F.substring(F.translate(F.md5((F.col("id") % 500).cast("string")), "0123456789abcdef", "ghijklmnopqrstuv"), 1, 8)))
        .alias("line"),
    )
    found = {r["template_text"]: r for r in occurrences(templated(lines)).collect()}
    hot = found["hot <NUM>"]
    assert hot["count"] == 30_000
    rows = [(r["bucket_ord"], -r["ts_ns"], r["line"]) for r in lines.filter("line like 'hot %'").collect()]
    expected = []
    for _, _, text in sorted(rows):
        if text not in expected:
            expected.append(text)
    assert hot["exemplar_lines"] == expected[:3]
    assert sum(r["count"] for r in found.values()) == 90_000


def test_what_is_shuffled_for_samples_does_not_grow_with_the_lines(spark):
    from logsift.operators.templates import occurrences

    def shuffled(lines_of_template):
        lines = spark.range(0, 4 * lines_of_template, numPartitions=4).select(
            F.lit(1).cast("bigint").alias("run_id"),
            F.lit(0).alias("bucket_ord"),
            F.lit("s").alias("service_name"),
            F.lit("").alias("logger"),
            F.concat(F.lit("kind "), (F.col("id") % 4).cast("string")).alias("template_text"),
            F.col("id").alias("ts_ns"),
            # every line is said at two times, which lie in different slices for most
            F.concat(F.lit("line "), (F.col("id") % (2 * lines_of_template)).cast("string")).alias("line"),
        )
        found = occurrences(lines)
        rows = found.collect()
        last = 4 * lines_of_template
        for r in rows:
            kind = int(r["template_text"].split()[1])
            newest = [last - 4 + kind - 4 * i for i in range(3)]
            assert r["exemplar_lines"] == [f"line {t % (2 * lines_of_template)}" for t in newest]
            assert r["count"] == lines_of_template
        return _exchanged_rows(found)

    few, many = shuffled(2_000), shuffled(20_000)
    # the lines are dealt once; after that the slices of four templates come together
    assert few == [8_000, 4 * 8] and many == [80_000, 4 * 8]


def _exchanged_rows(df):
    """Rows that each shuffle of an executed query has written, the input's first."""
    found = []

    def walk(node):
        if node.nodeName() in ("AdaptiveSparkPlan",):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())

    walk(df._jdf.queryExecution().executedPlan())
    return found
