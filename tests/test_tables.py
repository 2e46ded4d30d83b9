"""Snapshots, their clean-up, appended parts and the history by ranges of hashes."""

import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsift import schemas
from logsift.operators import history
from logsift.plans import jobs
from logsift.session import fresh_folder
from logsift.sources import snapshots
from logsift.sources import tables as module
from logsift.sources.snapshots import Log, Part
from logsift.sources.tables import HISTORY, RANGE, Tables

FEW = 3  # parts of a size, so that a few writes are enough


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(module, "FEW", FEW)


NOON = datetime(2031, 5, 6, 12)


def fresh(spark):
    return Tables(spark, fresh_folder(spark, "tables"))


def calls(spark, ids, cost=1):
    rows = [(i, 1, "m", 0, 0, 0, 0, 5, None, NOON + timedelta(seconds=i)) for i in ids]
    df = spark.createDataFrame(rows, schemas.API_CALL).coalesce(1)
    return df.withColumn("estimated_cost_usd", F.lit(cost).cast("decimal(10,6)"))


def ids(tables, at=None):
    return sorted(r["id"] for r in tables.read("api_call", at).select("id").collect())


def files(tables, name):
    found = []
    for folder, _, names in os.walk(f"{tables.root}/{name}"):
        found += [f"{folder}/{n}" for n in names if not n.endswith(".crc") and n != "_SUCCESS"]
    return found


def templates(spark, words, n=1):
    rows = []
    for w in words:
        digest = hashlib.sha256(w.encode()).hexdigest()
        rows.append((digest, "svc", "app", w, NOON + timedelta(hours=n), NOON + timedelta(hours=n + 1), n))
    return spark.createDataFrame(rows, schemas.LOG_TEMPLATE).coalesce(1)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*schemas.LOG_TEMPLATE.fieldNames()).collect())


# --- snapshots ---------------------------------------------------------------------------------------


def test_a_snapshot_is_taken_once_and_the_loser_tries_again(spark):
    folder = fresh_folder(spark, "log")
    one, two = Log(spark, folder, f"{folder}/data", None), Log(spark, folder, f"{folder}/data", None)
    met = []

    def slow(parts):
        if not met:  # another writer publishes while this one prepares
            met.append(two.publish(lambda p: [*p, Part("other")]).number)
        return [*parts, Part("own")]

    assert one.publish(slow).number == 2 and met == [1]
    assert [p.version for p in one.snapshot().parts] == ["other", "own"]
    assert [p.version for p in one.snapshot(1).parts] == ["other"]
    assert one.numbers() == [1, 2]
    assert not [n for n, _ in one.folder.list() if n.startswith("_")]  # no draft is left


def test_many_writes_leave_a_bounded_number_of_files(spark):
    tables = fresh(spark)
    run = spark.createDataFrame([(1, NOON, NOON, NOON, None, None, "running", None)], schemas.RUN)
    for n in range(14):
        tables.put_runs(run.withColumn("total_events", F.lit(n).cast("bigint")))
        tables.append_api_calls(calls(spark, range(10 * n, 10 * n + 10)))
        if n % 7 == 6:
            jobs.tidy(tables, grace=0)
    assert tables.read("run").first()["total_events"] == 13 and ids(tables) == list(range(140))
    assert len(files(tables, "run")) <= 3
    parts = tables.parts("api_call")
    assert len(parts) < 2 * FEW and sum(p.rows for p in parts) == 140
    assert len(files(tables, "api_call")) <= len(parts) + 2


def test_readers_of_older_snapshots_are_not_disturbed(spark):
    tables = fresh(spark)
    for n in range(3):
        tables.append_api_calls(calls(spark, range(5 * n, 5 * n + 5)))
    reader, number = tables.read("api_call"), tables.log("api_call").numbers()[-1]
    for n in range(3, 7):
        tables.append_api_calls(calls(spark, range(5 * n, 5 * n + 5)))
    assert jobs.tidy(tables, grace=3600) == 0
    assert reader.count() == 15 and ids(tables, number) == list(range(15)) and len(ids(tables)) == 35
    assert jobs.tidy(tables, grace=0) > 0
    assert len(ids(tables)) == 35 and tables.log("api_call").numbers() == [tables.log("api_call").snapshot().number]


def test_a_clean_up_that_fails_half_way_loses_nothing(spark, monkeypatch):
    tables = fresh(spark)
    for n in range(7):
        tables.append_api_calls(calls(spark, [n]))
    tables._write("api_call", calls(spark, [99]))  # left by a writer that died
    whole, done = snapshots.Folder.delete, []

    def failing(self, *names):
        if len(done) == 9:
            raise OSError("the store is away")
        done.append(names)
        whole(self, *names)

    monkeypatch.setattr(snapshots.Folder, "delete", failing)
    with pytest.raises(OSError):
        jobs.tidy(tables, grace=0)
    assert ids(tables) == list(range(7))
    monkeypatch.setattr(snapshots.Folder, "delete", whole)
    assert jobs.tidy(tables, grace=0) > 0
    assert ids(tables) == list(range(7))
    named = {p.version for p in tables.parts("api_call")}
    assert {n.removeprefix("version=") for n, _ in tables.log("api_call").data.list()} == named


def test_replaced_runs_of_a_version_go(spark):
    tables = fresh(spark)
    rows = [(i, NOON, NOON, NOON, None, None, "running", None) for i in range(6)]
    tables.put_runs(spark.createDataFrame(rows, schemas.RUN))
    tables.put_runs(spark.createDataFrame(rows[:2], schemas.RUN).withColumn("status", F.lit("completed")))
    before = len(files(tables, "run"))
    assert jobs.tidy(tables, grace=0) == 2 and len(files(tables, "run")) < before
    found = {r["id"]: r["status"] for r in tables.read("run").collect()}
    assert found == {i: "completed" if i < 2 else "running" for i in range(6)}


# --- appended tables -----------------------------------------------------------------------------------


def test_a_retried_append_comes_once_and_reads_no_other_part(spark, monkeypatch):
    monkeypatch.setattr(module, "FEW", 8)
    tables = fresh(spark)
    for n in range(5):
        tables.append_api_calls(calls(spark, range(10 * n, 10 * n + 10)))
    read = []
    plain = Tables._rows
    monkeypatch.setattr(Tables, "_rows", lambda self, name, parts, key: read.append(list(parts)) or plain(self, name, parts, key))
    tables.append_api_calls(calls(spark, range(50, 60)))
    assert read == []  # new ids meet nothing
    tables.append_api_calls(calls(spark, range(20, 30), cost=9))  # written again
    assert [[(p.low, p.high) for p in parts] for parts in read] == [[("20", "29")]]
    read.clear()
    tables.append_api_calls(calls(spark, [35, 70, 70]))  # one known, one new and repeated
    assert [[p.low for p in parts] for parts in read] == [["30", "40", "50"]]
    monkeypatch.undo()
    assert ids(tables) == [*range(60), 70]
    assert {float(r[0]) for r in tables.read("api_call").select("estimated_cost_usd").collect()} == {1.0}
    tables.append_api_calls(calls(spark, []))
    assert len(ids(tables)) == 61


def test_bounds_are_compared_as_numbers(spark):
    tables = fresh(spark)
    tables.append_api_calls(calls(spark, range(9, 120)))
    tables.append_api_calls(calls(spark, [100, 1000, 8]))
    assert ids(tables) == [8, *range(9, 120), 1000]


# --- history -------------------------------------------------------------------------------------------


def test_history_by_ranges_equals_one_rollup(spark):
    tables = fresh(spark)
    words = [f"template {i}" for i in range(60)]
    pieces = []
    for n in range(2 * FEW + 3):
        piece = templates(spark, words[n : n + 25], n + 1)
        pieces.append(piece)
        tables.add_history(piece)
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece)
    want = rows_of(history.merged(whole))
    assert rows_of(tables.read(HISTORY)) == want
    by_range = {}
    for part in tables.parts(HISTORY):
        by_range[part.key] = by_range.get(part.key, 0) + 1
    assert max(by_range.values()) < 2 * FEW
    step = pieces[0]
    for piece in pieces[1:]:
        step = history.merge_templates(step, piece)
    assert rows_of(step) == want


def test_a_run_writes_only_the_ranges_it_touches(spark):
    tables = fresh(spark)
    tables.add_history(templates(spark, [f"template {i}" for i in range(400)]))
    before = {p.version: p for p in tables.parts(HISTORY)}
    new = templates(spark, ["template 7", "another"], 5)
    tables.add_history(new)
    added = [p for p in tables.parts(HISTORY) if p.version not in before]
    assert {p.key for p in added} == {r["template_hash"][0] for r in new.collect()}
    assert sum(p.rows for p in added) == 2
    assert {p.version for p in tables.parts(HISTORY)} >= set(before)  # nothing old was written again
    found = {r["template_text"]: r["total_count"] for r in tables.read(HISTORY).collect()}
    assert found["template 7"] == 6 and found["another"] == 5 and len(found) == 401


def test_rebuilt_ranges_replace_what_they_had(spark):
    tables = fresh(spark)
    words = [f"template {i}" for i in range(100)]
    for n in (1, 2, 3):
        tables.add_history(templates(spark, words, n))
    again = templates(spark, words, 50)
    some = again.filter(F.substring("template_hash", 1, 1).isin(["0", "a"]))
    tables.rebuild_history(some, ["0", "a"])
    for r in tables.read(HISTORY).collect():
        assert r["total_count"] == (50 if r["template_hash"][0] in "0a" else 6)
    tables.rebuild_history(again)
    assert rows_of(tables.read(HISTORY)) == rows_of(again)
    assert RANGE not in tables.read(HISTORY).columns


def test_two_compactions_at_a_time_count_once(spark):
    tables = fresh(spark)
    for n in range(2):
        tables.append_api_calls(calls(spark, [n]))
    old = list(tables.parts("api_call"))
    for _ in range(2):  # both have read the same parts
        version = tables._write("api_call", tables._rows("api_call", old, None))
        tables._exchange("api_call", old, [tables._measured("api_call", version, "id")])
    assert ids(tables) == [0, 1]
