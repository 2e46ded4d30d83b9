"""The persisted tables as folders of parquet files.

Every write goes into a version folder of its own. It counts once a snapshot of the table names it; what
a failed write leaves behind is never read, and a reader keeps what it has begun to read. Rows of a
run replace the run's earlier rows, appended rows come once however often they are written, and the
history of templates is a log of what runs have added. So any write may be repeated.

Appended tables and the history are kept in parts of growing size: when a size has `FEW` parts they become
one of the next, so a row is rewritten a few times at most and the number of parts stays small.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift import schemas
from logsift.operators import history
from logsift.operators.quality import all_checks
from logsift.sources.snapshots import DAY_SECONDS, Log, Part

SCHEMAS = {
    "run": schemas.RUN,
    "log_template": schemas.LOG_TEMPLATE,
    "template_occurrence": schemas.OCCURRENCE,
    "verdict_event": schemas.VERDICT_EVENT,
    "finding": schemas.FINDING,
    "api_call": schemas.API_CALL,
    "bucket_count": schemas.BUCKET_COUNT,
    "bucket_loss": schemas.BUCKET_LOSS,
    "prompt_selection": schemas.PROMPT_SELECTION,
    "model_report": schemas.MODEL_RESPONSE_ROW,
    "resolved_finding": schemas.RESOLVED_FINDING,
}
# The column that names the run, of tables whose rows are replaced run by run.
BY_RUN = {
    "run": "id",
    "template_occurrence": "run_id",
    "finding": "run_id",
    "bucket_count": "run_id",
    "bucket_loss": "run_id",
    "prompt_selection": "run_id",
    "model_report": "run_id",
    "resolved_finding": "run_id",
}
# The columns that tell rows apart, of tables that only grow. The first one grows with them, so the
# parts that may hold a key are few.
APPENDED = {
    "api_call": ["id"],
    "verdict_event": ["set_at", "template_hash", "classification", "set_by"],
}
HISTORY = "log_template"
# The history is kept by the first digit of the hash.
RANGE = "hash_range"
# So many parts of one size become one of the next, which is so many times larger.
FEW = 8


class InvalidBatch(ValueError):
    """A batch that breaks a rule of its table; nothing of it has been published."""


def hash_range(digest: Column) -> Column:
    return F.substring(digest, 1, 1)


def _size(part: Part) -> int:
    return int(math.log(max(part.rows, 1), FEW))


def _due(parts: Iterable[Part]) -> list[Part]:
    """The parts of the smallest size that has too many, with all smaller ones."""
    parts = sorted(parts, key=lambda p: p.rows)
    for size in sorted({_size(p) for p in parts}):
        if sum(_size(p) == size for p in parts) >= FEW:
            return [p for p in parts if _size(p) <= size]
    return []


class Tables:
    """Reads and writes the tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _data(self, name: str) -> str:
        return f"{self.root}/{name}/data"

    def log(self, name: str) -> Log:
        key = RANGE if name == HISTORY else BY_RUN.get(name)
        return Log(self.spark, f"{self.root}/{name}/snapshots", self._data(name), key)

    def parts(self, name: str, at: int | None = None) -> tuple[Part, ...]:
        return self.log(name).snapshot(at).parts

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def vacuum(self, grace: float = DAY_SECONDS) -> int:
        """Deletes what has been superseded for longer than grace, in all tables."""
        return sum(self.log(name).vacuum(grace) for name in SCHEMAS)

    # --- reading -----------------------------------------------------------------------------------

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _rows(self, name: str, parts: Iterable[Part], key: str | None) -> DataFrame:
        """The rows of some parts; folders of other versions are not even listed."""
        parts, schema = list(parts), SCHEMAS[name]
        if not parts:
            return self._empty(schema)
        fields = [f for f in schema.fields if f.name != key]
        extra = [T.StructField("version", T.StringType())]
        if key is not None:
            extra.append(T.StructField(key, schema[key].dataType if key in schema.names else T.StringType()))
        versions = sorted({p.version for p in parts})
        rows = (
            self.spark.read.schema(T.StructType([*fields, *extra]))
            .option("basePath", self._data(name))
            .parquet(*[f"{self._data(name)}/version={v}" for v in versions])
        )
        if key is not None:
            # a version may hold rows of other runs or ranges that have been replaced since
            named = self.spark.createDataFrame([(p.version, p.key) for p in parts], "version string, named string")
            named = named.select("version", F.col("named").cast(extra[1].dataType).alias(key))
            rows = rows.join(named, ["version", key], "left_semi")
        return rows.select(*schema.fieldNames())

    def recorded_runs(self, name: str) -> DataFrame:
        """(run_id) of the runs that have been written to a table, also those without rows."""
        runs = [(int(p.key),) for p in self.parts(name)]
        return self.spark.createDataFrame(runs, "run_id bigint")

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """What has been published, or what snapshot at named; no rows if nothing has."""
        parts = self.parts(name, at)
        if name in BY_RUN:
            return self._rows(name, parts, BY_RUN[name])
        if name != HISTORY:
            return self._rows(name, parts, None)
        rows = self._rows(name, parts, RANGE)
        single = len({p.key for p in parts}) == len(parts)
        return rows if single else history.merged(rows)

    def _staged(self, name: str, version: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self._data(name)}/version={version}")

    # --- tables kept run by run ----------------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, key: str | None = None) -> str:
        """Writes rows into a version that is not published yet."""
        version = uuid.uuid4().hex
        path = f"{self._data(name)}/version={version}"
        if key is None:
            rows.select(*SCHEMAS[name].fieldNames()).write.parquet(path)
        else:
            # One task per run would be the bottleneck of a large run, one file per run and task the
            # bottleneck of the reader; Spark splits or merges the partitions by their size.
            rows.hint("rebalance", key).write.partitionBy(key).parquet(path)
        return version

    def _stage(self, name: str, rows: DataFrame) -> str:
        return self._write(name, rows.select(*SCHEMAS[name].fieldNames()), BY_RUN[name])

    def _publish(self, name: str, version: str, runs: DataFrame) -> None:
        """The version counts for these runs (run), in place of all they had."""
        keys = {str(r["run"]) for r in runs.select("run").distinct().collect()}  # one row a run
        new = [Part(version, key) for key in sorted(keys, key=int)]
        self.log(name).publish(lambda parts: [*(p for p in parts if p.key not in keys), *new])

    def replace_runs(self, name: str, rows: DataFrame, runs: DataFrame) -> DataFrame:
        """Rows of the given runs (run_id), in place of all they had; returns the whole table."""
        version = self._stage(name, rows)
        self._publish(name, version, runs.select(F.col("run_id").alias("run")))
        return self.read(name)

    def start_runs(self, runs: DataFrame) -> None:
        """New runs, in status running; runs that are recorded already stay as they are."""
        known = self.read("run").select("id")
        rows = runs.join(known, "id", "left_anti").select(
            "id",
            "started_at",
            "window_start",
            "window_end",
            F.lit(None).cast("string").alias("health_verdict"),
            F.lit(None).cast("string").alias("summary"),
            F.lit("running").alias("status"),
            F.lit(None).cast("bigint").alias("total_events"),
        )
        self.put_runs(rows)

    def put_runs(self, runs: DataFrame) -> None:
        """Rows of the run table, each in place of the one its run had."""
        version = self._stage("run", runs)
        self._publish("run", version, self._staged("run", version).select(F.col("id").alias("run")))

    def append_occurrences(self, rows: DataFrame, runs: DataFrame | None = None) -> None:
        """Runs' occurrences, all or nothing; writing the same run again replaces it."""
        version = self._stage("template_occurrence", rows)
        written = self._staged("template_occurrence", version).select("run_id")
        covered = written if runs is None else runs.select("run_id")
        self._publish("template_occurrence", version, covered.select(F.col("run_id").alias("run")))

    def append_findings(
        self, rows: DataFrame, runs: DataFrame, history: DataFrame, covered: DataFrame | None = None
    ) -> None:
        """Runs' findings, all or nothing; writing the same run again replaces it.

        What is checked against the rules is what has been written and will be published. covered
        (run_id) names the runs, if some of them have no finding.
        """
        version = self._stage("finding", rows)
        batch = self._staged("finding", version)
        tables = {"finding": batch, "run": runs, "log_template": history}
        broken = all_checks(tables).filter(F.col("table") == "finding").limit(5).collect()
        if broken:
            raise InvalidBatch("; ".join(f"{r['rule']}: {r['key']}" for r in broken))
        whose = batch.select("run_id") if covered is None else covered.select("run_id")
        self._publish("finding", version, whose.select(F.col("run_id").alias("run")))

    # --- tables that only grow -----------------------------------------------------------------------

    def _measured(self, name: str, version: str, key: str) -> Part | None:
        """A version as a part, with the bounds of its keys; none if it has no rows."""
        text = F.col(key).cast("string")
        found = self._staged(name, version).agg(
            F.count("*").alias("rows"), F.min_by(text, key).alias("low"), F.max_by(text, key).alias("high")
        )
        row = found.first()
        return Part(version, None, row["rows"], row["low"], row["high"]) if row["rows"] else None

    def _meeting(self, name: str, batch: Part, key: str) -> list[Part]:
        """The published parts whose keys may be among those of a batch.

        Bounds are kept as text and compared as what they are.
        """
        parts = self.parts(name)
        kind = SCHEMAS[name][key].dataType
        bounds = [(i, p.low, p.high) for i, p in enumerate(parts) if p.low is not None]
        unknown = [p for p in parts if p.low is None]  # only null keys; these are looked at always
        if not bounds:
            return unknown
        rows = self.spark.createDataFrame(bounds, "i int, low string, high string")
        low, high = (F.lit(v).cast(kind) for v in (batch.low, batch.high))
        apart = (F.col("low").cast(kind) > high) | (F.col("high").cast(kind) < low)
        near = rows.filter(~F.coalesce(apart, F.lit(False))).select("i").collect()  # one row a part
        return unknown + [parts[r["i"]] for r in near]

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows that are not there yet, by the columns that tell them apart.

        The batch is written once. It meets the parts whose bounds overlap its own, which a batch of new
        rows has none of; only if it holds known rows the rest is written again.
        """
        keys = APPENDED[name]
        version = self._write(name, rows.dropDuplicates(keys))
        part = self._measured(name, version, keys[0])
        if part is None:
            return
        near = self._meeting(name, part, keys[0])
        if near:
            batch, known = self._staged(name, version), self._rows(name, near, None)
            same = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
            condition = same[0]
            for each in same[1:]:
                condition = condition & each
            new = batch.alias("b").join(known.select(*keys).alias("k"), condition, "left_anti")
            version = self._write(name, new)
            part = self._measured(name, version, keys[0])
            if part is None:
                return
        self.log(name).publish(lambda parts: [*parts, part])
        self._grown(name, keys[0])

    def _grown(self, name: str, key: str) -> None:
        due = _due(self.parts(name))
        if due:
            # small files become few
            version = self._write(name, self._rows(name, due, None).hint("rebalance"))
            self._exchange(name, due, [self._measured(name, version, key)])

    def _exchange(self, name: str, old: Iterable[Part], new: list[Part]) -> None:
        """New parts for old ones; nothing if another writer has exchanged one of those already."""
        gone = set(old)
        self.log(name).publish(
            lambda parts: [*(p for p in parts if p not in gone), *new] if gone <= set(parts) else parts
        )

    def append_api_calls(self, rows: DataFrame) -> None:
        self.append("api_call", rows)

    def append_verdicts(self, rows: DataFrame) -> None:
        self.append("verdict_event", rows)

    # --- the history ---------------------------------------------------------------------------------

    def _ranges(self, rows: DataFrame) -> list[Part]:
        """Writes rows of the history; the parts they make, one for each range that has rows."""
        ranged = rows.select(*SCHEMAS[HISTORY].fieldNames(), hash_range(F.col("template_hash")).alias(RANGE))
        version = self._write(HISTORY, ranged, RANGE)
        counts = self._staged(HISTORY, version).groupBy(hash_range(F.col("template_hash")).alias("key"))
        return [Part(version, r["key"], r["n"]) for r in counts.agg(F.count("*").alias("n")).collect()]

    def add_history(self, rows: DataFrame) -> None:
        """What new runs add to the history; older parts stay as they are until there are many of a size."""
        new = self._ranges(rows)
        self.log(HISTORY).publish(lambda parts: [*parts, *new])
        by_range: dict[str | None, list[Part]] = {}
        for part in self.parts(HISTORY):
            by_range.setdefault(part.key, []).append(part)
        due = [p for parts in by_range.values() for p in _due(parts)]
        if due:
            self._exchange(HISTORY, due, self._ranges(history.merged(self._rows(HISTORY, due, RANGE))))

    def rebuild_history(self, rows: DataFrame, ranges: Iterable[str] | None = None) -> None:
        """These rows in place of all the history has in some ranges of hashes, or at all."""
        new = self._ranges(rows)
        over = None if ranges is None else set(ranges)
        self.log(HISTORY).publish(
            lambda parts: [*(p for p in parts if over is not None and p.key not in over), *new]
        )
