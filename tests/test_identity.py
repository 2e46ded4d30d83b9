import hashlib
import json

from pyspark.sql import functions as F

from logsift.functions.identity import add_identity, template_hash
from logsift.operators import templates

LINES = "job string, labels map<string,string>, ts_ns bigint, line string"


def identity(spark, job, labels, line):
    row = add_identity(spark.createDataFrame([(job, labels, 1, line)], LINES)).first()
    return row["service_name"], row["logger"]


def test_pinned_hash(spark):
    digest = template_hash(F.lit("plex"), F.lit("app"), F.lit("worker <NUM> exited"))
    value = spark.range(1).select(digest).first()[0]
    assert value == "105e9468b09a52ff4e690c5fdc650a28eada6e2e4ee941b4868cd3b4bb9f7911"
    assert value == hashlib.sha256(b"plex\0app\0worker <NUM> exited").hexdigest()


def test_hash_keeps_fields_apart(spark):
    a = template_hash(F.lit("a"), F.lit("b|c"), F.lit("t"))
    b = template_hash(F.lit("a|b"), F.lit("c"), F.lit("t"))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert row["a"] != row["b"]


def test_service_names(spark):
    both = {"compose_service": "web", "container_name": "web-1"}
    assert identity(spark, "docker", both, "x")[0] == "web"
    assert identity(spark, "docker", {"container_name": "web-1"}, "x")[0] == "web-1"
    assert identity(spark, "docker", {}, "x")[0] == "unknown"
    line = "Sep  9 22:10:00 myhost kea-dhcp6[1234]: lease renewed"
    assert identity(spark, "system", both, line) == ("kea-dhcp6", "syslog")
    assert identity(spark, "system", both, "not a syslog line") == ("system", "syslog")


def test_logger_only_from_one_whole_json_object(spark):
    cases = {
        '{"logger":"a","target":"b"}': "a",
        '{"target":"b","module":"c"}': "b",
        '{"logger_name":"n"}': "n",
        '{"module":"m"}': "m",
        '{"logger":5,"module":"m"}': "m",
        '{"logger":null,"target":"t"}': "t",
        '{"logger":""}': "",
        '  {"logger":"a"}  ': "a",
        '{"logger":"first","logger":"last"}': "last",
        '{"a":{"logger":"inner"}}': "",
        '["logger"]': "",
        '"logger"': "",
        '{"logger":"a"': "",
        "{'logger':'a'}": "",
        '{"logger":"a"} tail': "",
        '{"logger":"a"} {"logger":"b"}': "",
        '{"logger":"a"},{"logger":"b"}': "",
        '{"logger":"a"}] [1': "",
        '{"logger":"a"}} {"x":{"y":1}': "",
        '{"logger":"a","list":[1,2]}': "a",
        '{"logger":"a"},': "",
        "plain text": "",
        "{}": "",
    }
    rows = [("docker", {}, i, line) for i, line in enumerate(cases)]
    found = add_identity(spark.createDataFrame(rows, LINES)).orderBy("ts_ns").collect()
    assert {r["line"]: r["logger"] for r in found} == cases


def bucketed(spark, rows):
    """rows of (bucket_ord, job, service, ts_ns, line)"""
    data = [(o, j, {"compose_service": s}, t, x) for o, j, s, t, x in rows]
    return templates.templated(spark.createDataFrame(data, "bucket_ord int, " + LINES))


def spoken(who, text):
    return json.dumps({"target": who, "said": text})


def test_a_template_belongs_to_one_service_and_logger(spark):
    """The same words from two services and three loggers are six templates."""
    rows = [
        (2, "docker", service, 5, spoken(logger, f"cache miss {n}"))
        for service in ("north", "south")
        for logger in ("x", "y", "z")
        for n in (4, 5)
    ]
    found = templates.aggregate_templates(bucketed(spark, rows)).collect()
    assert len({r["template_hash"] for r in found}) == 6
    assert {(r["service_name"], r["logger"]) for r in found} == {(a, b) for a in ("north", "south") for b in "xyz"}
    assert {r["count"] for r in found} == {2}


def test_counts_and_times_of_lines_that_differ_in_numbers(spark):
    times = [900, 100, 500, 300, 700]
    rows = [(1, "docker", "east", t, spoken("q", f"queue at {t} of 1000")) for t in times]
    rows.append((1, "docker", "east", 50, spoken("q", "queue empty")))
    found = {r["template_text"]: r for r in templates.aggregate_templates(bucketed(spark, rows)).collect()}
    assert len(found) == 2
    (busy,) = [r for text, r in found.items() if "<NUM>" in text]
    assert (busy["count"], busy["first_ns"], busy["last_ns"]) == (5, 100, 900)


def test_samples_follow_bucket_then_time_then_text(spark):
    late = [(3, "docker", "west", 10 * n, spoken("q", f"step {n}")) for n in range(1, 6)]
    early = [(0, "docker", "west", 7, spoken("q", f"step {n}")) for n in (9, 8)]
    again = [(0, "docker", "west", 7, spoken("q", "step 9"))]
    lines = bucketed(spark, late + early + again)

    def samples(limit):
        found = templates.exemplar_lines(lines, limit).orderBy("position").collect()
        return [json.loads(r["line"])["said"] for r in found]

    assert samples(4) == ["step 8", "step 9", "step 5", "step 4"]
    assert samples(-1) == ["step 8"]
    assert len(samples(99)) == 7
    assert templates.aggregate_templates(lines).first()["count"] == 8
    assert templates.aggregate_templates_dedup(lines).first()["count"] == 7
