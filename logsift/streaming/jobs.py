"""Structured Streaming jobs over a stream of log lines.

Each takes lines with ``job, labels, ts_ns, line`` and works for an endless source as well as for
one that ends. Late lines are dropped once the watermark has passed their window; how many is
known where the arrivals are written down.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from logsift.operators.buckets import tag_buckets
from logsift.operators.templates import IDENTITY, ns_to_timestamp, templated, with_hash
from logsift.session import spread
from logsift.sources.snapshots import Folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State grows with the number of templates in open windows, so it must not live on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Arrivals(StreamingQueryListener):
    """Writes down how many entries each micro-batch of a stream brought.

    Counts of dropped rows in the progress of a query are those after the first sums of each task,
    not lines. So entries are counted before they are summed, and what the windows do not hold of them
    came too late. One small file for each micro-batch, under its number: a replayed one writes the
    same again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.name = f"arrived_{uuid.uuid4().hex}"
        self.ended = threading.Event()
        spark.streams.addListener(self)

    def counted(self, entries: DataFrame) -> DataFrame:
        return entries.observe(self.name, F.count(F.lit(1)).alias("entries"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(self.name)
        if found is not None:
            row = {
                "batch_id": progress.batchId,
                "entries": found["entries"] or 0,
                "dropped_rows": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators),
                "watermark": progress.eventTime.get("watermark"),
            }
            self.folder.create(json.dumps(row) + "\n", f"{progress.batchId:012d}.json")
            self.query = progress.id

    def onQueryTerminated(self, event) -> None:
        if getattr(self, "query", event.id) == event.id:
            self.ended.set()

    def close(self, seconds: float = 60) -> None:
        """Waits for what the query has told before it ended, and stops listening."""
        self.ended.wait(seconds)
        self.spark.streams.removeListener(self)


ARRIVAL = "batch_id bigint, entries bigint, dropped_rows bigint, watermark string"


def late_lines(spark: SparkSession, path: str, arrivals: str) -> DataFrame:
    """(batch_id, entries, counted, late): of every micro-batch, how many of its entries no window holds.

    path: the windows as write_windows leaves them. A window is given out with all it holds so far,
    so what a batch has added to it is the difference to the time before.
    """
    keys = ["window_start", "window_end", "template_hash", *IDENTITY]
    before = F.lag("count", 1, 0).over(Window.partitionBy(*keys).orderBy("batch_id"))
    grown = spark.read.parquet(path).withColumn("added", F.col("count") - before)
    counted = grown.groupBy("batch_id").agg(F.sum("added").alias("counted"))
    told = spark.read.schema(ARRIVAL).json(arrivals)
    met = told.join(counted, "batch_id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return met.select("batch_id", "entries", "counted", (F.col("entries") - F.col("counted")).alias("late"))


def templated_stream(lines: DataFrame, watermark: str, arrivals: Arrivals | None = None) -> DataFrame:
    """Bucket entries with identity, template and event time."""
    entries = tag_buckets(lines)
    if arrivals is not None:
        entries = arrivals.counted(entries)
    timed = templated(entries).withColumn("ts", ns_to_timestamp("ts_ns"))
    return timed.withWatermark("ts", watermark)


def _window_counts(stream: DataFrame, window) -> DataFrame:
    counts = stream.groupBy(window.alias("w"), *IDENTITY).agg(
        F.count("*").alias("count"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )
    return with_hash(counts).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "template_hash",
        *IDENTITY,
        "count",
        "first_ns",
        "last_ns",
    )


def stream_template_counts(
    lines: DataFrame, every: str = "1 day", watermark: str = "1 hour", arrivals: Arrivals | None = None
) -> DataFrame:
    """Templates per window of fixed length; a window is given out anew whenever it has grown.

    With arrivals the entries of every micro-batch are counted, so that late ones can be told (late_lines).
    """
    return _window_counts(templated_stream(lines, watermark, arrivals), F.window("ts", every))


def sliding_counts(panes: DataFrame, every_hours: int, lookback_hours: int) -> DataFrame:
    """Overlapping lookback windows, one for each period, from the counts of single periods.

    A line is counted once, in its pane; only the few rows of a pane are repeated for the windows
    that hold it, where all panes of a template are, so that what is repeated is not shuffled.
    """
    if lookback_hours % every_hours:
        raise ValueError("the lookback has to be a multiple of the period")
    back = F.sequence(F.lit(0), F.lit(lookback_hours // every_hours - 1))
    hours = F.make_interval(hours=F.col("_back") * every_hours)
    met = spread(panes, "template_hash")
    moved = met.withColumn("_back", F.explode(back)).withColumn("window_start", F.col("window_start") - hours)
    keys = ["window_start", "template_hash", *IDENTITY]
    counts = moved.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")
    )
    end = F.col("window_start") + F.make_interval(hours=F.lit(lookback_hours))
    return counts.withColumn("window_end", end)


def _file_query(spark: SparkSession, result: DataFrame, checkpoint: str):
    keep_state_on_disk(spark)
    return (
        result.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def _write_batch(path: str):
    """Writes a micro-batch into a partition of its own; a replayed batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    return write


def write_windows(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every window as it stands after each micro-batch; read_windows reads the last state.

    So the windows that are still open when the input ends are there as well.
    """
    query = _file_query(result.sparkSession, result, checkpoint).outputMode("update")
    return query.foreachBatch(_write_batch(path)).start()


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every window."""
    values = F.struct("count", "first_ns", "last_ns")
    keys = ["window_start", "window_end", "template_hash", *IDENTITY]
    latest = spark.read.parquet(path).groupBy(*keys).agg(F.max_by(values, "batch_id").alias("v"))
    return latest.select(*keys, "v.*")


def compact_windows(spark: SparkSession, path: str, into: str) -> None:
    """The last states as one table, to start a new folder from when micro-batches have piled up."""
    latest = read_windows(spark, path).withColumn("batch_id", F.lit(-1).cast("bigint"))
    latest.write.partitionBy("batch_id").parquet(into)


def stream_occurrence_sink(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Template counts of every micro-batch, each batch in a partition of its own.

    A batch that is replayed after a failure overwrites its partition and does not count twice.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*IDENTITY).agg(
            F.count("*").alias("count"),
            F.min("ts_ns").alias("first_ns"),
            F.max("ts_ns").alias("last_ns"),
        )
        _write_batch(path)(with_hash(counts), batch_id)

    stream = templated(tag_buckets(lines))
    return (
        _file_query(lines.sparkSession, stream, checkpoint).foreachBatch(write_batch).start()
    )


def compact_batches(spark: SparkSession, path: str, into: str) -> None:
    """The totals so far as one table, to start a new folder from when micro-batches have piled up."""
    totals = read_batches(spark, path).withColumn("batch_id", F.lit(-1).cast("bigint"))
    totals.write.partitionBy("batch_id").parquet(into)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all micro-batches written so far."""
    return spark.read.parquet(path).groupBy("template_hash", *IDENTITY).agg(
        F.sum("count").alias("count"),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
    )


FIRST_SEEN = "service_name string, logger string, template_text string, first_ns bigint, template_hash string, batch_id bigint"


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """All templates a stream of new ones has given out, with the micro-batch of each."""
    if not Folder(spark, path).list():
        return spark.createDataFrame([], FIRST_SEEN)
    return spark.read.schema(FIRST_SEEN).parquet(path)


def stream_new_templates(
    lines: DataFrame, path: str, checkpoint: str, period: str = "1 day", clock: Column | None = None
) -> StreamingQuery:
    """Give out a template in the first micro-batch it is seen in, and never again.

    The state says which templates the current period has met, one small row for each, and is given up
    when the period is over. Templates that a period meets for the first time are looked up in what earlier
    micro-batches have given out; a batch without any reads nothing of it. A replayed batch has the time
    of its first attempt and doesn't look at its own table, so it gives out the same again.

    The clock tells the period; it is the time of arrival, so no line is ever late. With a clock of another
    kind lines of a period that is over are not seen.
    """
    met = templated(tag_buckets(lines)).withColumn("met", F.current_timestamp())
    timed = met.withColumn("clock", F.col("met") if clock is None else clock).withWatermark("clock", "0 seconds")
    seen = timed.groupBy(F.window("clock", period).alias("period"), *IDENTITY).agg(
        F.min("ts_ns").alias("first_ns"), F.min("met").alias("first_met"), F.max("met").alias("last_met")
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter("first_met = last_met").groupBy(*IDENTITY).agg(F.min("first_ns").alias("first_ns"))
        fresh = with_hash(fresh).persist()
        try:
            if not fresh.isEmpty():
                known = first_seen(spark, path).filter(F.col("batch_id") < batch_id).select("template_hash")
                _write_batch(path)(fresh.join(known, "template_hash", "left_anti"), batch_id)
        finally:
            fresh.unpersist()

    # state is given up with the next lines; no micro-batch without lines is run for it
    conf, option = lines.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(option)
    conf.set(option, "false")
    try:
        query = _file_query(lines.sparkSession, seen, checkpoint).outputMode("update")
        return query.foreachBatch(write_batch).start()
    finally:
        conf.set(option, before)


def compact_first_seen(spark: SparkSession, path: str, into: str) -> None:
    """What was given out so far as one table, to start a new folder from when micro-batches have piled up."""
    rows = first_seen(spark, path).withColumn("batch_id", F.lit(-1).cast("bigint"))
    rows.write.partitionBy("batch_id").parquet(into)
