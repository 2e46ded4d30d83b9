"""Log streams as files: label map plus [time, line] entries."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.schemas import LOG_LINE, STREAM_RESPONSE

BROKEN = "_broken"

JOB_LABEL = "job"


def drop_malformed_entries(entries: DataFrame) -> DataFrame:
    """Log lines from (labels, entry); an entry without both a time and a line is left out.

    The time is a whole number of nanoseconds. A time before 1970 only counts on a full second,
    as its remainder has no place in the time format the entries come from. Elements after the
    line are ignored.
    """
    text = F.try_element_at("entry", F.lit(1))
    ts_ns = F.when(F.rlike(text, F.lit("^[+-]?[0-9]+$")), text.try_cast("bigint"))
    return (
        entries.select(
            F.coalesce(F.try_element_at("labels", F.lit(JOB_LABEL)), F.lit("")).alias("job"),
            "labels",
            ts_ns.alias("ts_ns"),
            F.try_element_at("entry", F.lit(2)).alias("line"),
        )
        .filter(F.col("ts_ns").isNotNull() & F.col("line").isNotNull())
        .filter("ts_ns >= 0 or ts_ns % 1000000000 = 0")
    )


def stream_entries(responses: DataFrame) -> DataFrame:
    """(labels, entry) rows from query responses."""
    streams = responses.select(F.explode("data.result").alias("s"))
    return streams.select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("entry"))


def read_log_streams(spark: SparkSession, path: str, start_ns: int, end_ns: int) -> DataFrame:
    """Log lines with start <= time < end from a folder of JSON responses, one per line.

    A response that is cut off or no JSON has no lines; failed_responses counts those.
    """
    lines = drop_malformed_entries(stream_entries(_responses(spark, path).filter(F.isnull(BROKEN))))
    return lines.filter((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))


def _responses(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*STREAM_RESPONSE.fields, T.StructField(BROKEN, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", BROKEN).json(path)


def failed_responses(spark: SparkSession, path: str) -> DataFrame:
    """How many responses a folder holds, and how many of them could not be read."""
    # both columns have to be asked for, or Spark doesn't parse the response at all
    rows = _responses(spark, path).select("data", BROKEN)
    return rows.agg(
        F.count(F.coalesce(BROKEN, F.to_json(F.struct("data")))).alias("responses"),
        F.count(BROKEN).alias("failed"),
    )


DAY_NS = 86_400_000_000_000


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Log lines as parquet by job and day, so that a time range reads only its days.

    Rebalanced first: few files per day however many tasks read the input, and several for a
    day that holds most of the lines.
    """
    dated = lines.withColumn("day", F.expr(f"(ts_ns - pmod(ts_ns, {DAY_NS}L)) div {DAY_NS}L"))
    dated.hint("rebalance", "job", "day").write.mode("overwrite").partitionBy("job", "day").parquet(
        path
    )


def read_log_lines(spark: SparkSession, path: str, start_ns: int, end_ns: int) -> DataFrame:
    """Log lines with start <= time < end; the day partitions outside of it are not listed."""
    first, last = start_ns // DAY_NS, (end_ns - 1) // DAY_NS
    return (
        spark.read.parquet(path)
        .filter(F.col("day").between(first, last))
        .filter((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))
        .select("job", "labels", "ts_ns", "line")
    )


def _tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder with the name of their file; what can't be read of a file is left out."""
    rows = spark.read.schema(LOG_LINE).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    return rows.parquet(path).select("*", F.col("_metadata.file_path").alias("file"))


# A file without rows is smaller than this; only such files are looked at for their marks.
EMPTY_BYTES = 1 << 16
PARQUET_MARK = b"PAR1"  # fixed: at both ends of a file


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder: path, length, content; what is not asked for is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, stated, read) of every file of a folder: rows by its footer, and rows that could be decoded.

    stated is null where there is no footer to read. Every page of every column is decoded, since a
    broken page shows only then. Files without rows give none to count; they have their marks.
    """
    rows = _tolerant(spark, path)
    stated = rows.groupBy("file").agg(F.count("*").alias("stated"))
    content = F.xxhash64("job", "ts_ns", "line", F.map_entries("labels"))
    # compared with a number, or Spark would know the count without the columns
    read = rows.groupBy("file").agg(F.count_if(content != 0).alias("read"))
    mark, data = F.lit(PARQUET_MARK), F.col("content")
    size = len(PARQUET_MARK)
    marked = (F.col("length") > 2 * size) & (F.substring(data, 1, size) == mark) & (F.substring(data, -size, size) == mark)
    empty = _files(spark, path).filter(F.col("length") <= EMPTY_BYTES).filter(marked).select("file", F.lit(0).alias("none"))
    found = _files(spark, path).select("file").join(stated, "file", "left").join(read, "file", "left").join(empty, "file", "left")
    return found.select(
        "file", F.coalesce("stated", "none").cast("bigint").alias("stated"), F.coalesce("read", F.lit(0)).alias("read")
    )


def folder_loss(spark: SparkSession, path: str) -> tuple[str, int, int, int]:
    """(state, files, broken files, rows lost): missing, read, partly or unreadable.

    Rows lost are those that the footers of broken files speak of; a file without a footer tells none.
    """
    try:
        found = file_states(spark, path).agg(
            F.count("*").alias("files"),
            F.count_if(F.isnull("stated") | (F.col("read") < F.col("stated"))).alias("broken"),
            F.sum(F.when(F.col("read") < F.col("stated"), F.col("stated"))).alias("lost"),
        ).first()
    except AnalysisException as error:
        return ("missing" if error.getCondition() == "PATH_NOT_FOUND" else "unreadable"), 0, 0, 0
    except (PySparkException, Py4JJavaError):
        return "unreadable", 0, 0, 0
    files, broken = found["files"], found["broken"]
    state = "read" if not broken else "unreadable" if broken == files else "partly"
    return state, files, broken, found["lost"] or 0


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files of a folder that can be read from the first row to the last."""
    states = file_states(spark, path)
    good = states.filter(F.col("read") == F.col("stated")).select("file")
    return _tolerant(spark, path).join(good, "file", "left_semi").drop("file")


def folder_state(spark: SparkSession, path: str) -> str:
    """read, partly, missing or unreadable."""
    return folder_loss(spark, path)[0]


def read_or_empty(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """A folder of log lines, without the files that can't be read; no rows if it is missing.

    A bucket that cannot be read contributes nothing and the run goes on.
    """
    state = folder_state(spark, path) if state is None else state
    if state == "read":
        return spark.read.schema(LOG_LINE).option("recursiveFileLookup", "true").parquet(path)
    return whole_files(spark, path) if state == "partly" else spark.createDataFrame([], LOG_LINE)


def bucket_losses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(bucket, state, files, broken_files, lost_rows): what could be read of each bucket."""
    found = [(name, *folder_loss(spark, path)) for name, path in paths.items()]
    return spark.createDataFrame(
        found, "bucket string, state string, files bigint, broken_files bigint, lost_rows bigint"
    )


def bucket_states(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(bucket, state): which buckets were read, partly read, missing or unreadable."""
    return bucket_losses(spark, paths).select("bucket", "state")


def bucket_fallback(spark: SparkSession, paths: dict[str, str], losses: DataFrame | None = None) -> DataFrame:
    """All buckets' lines with their bucket name; missing and unreadable buckets and files are empty."""
    losses = bucket_losses(spark, paths) if losses is None else losses
    states = {r["bucket"]: r["state"] for r in losses.collect()}  # a row a bucket
    result = None
    for name, path in paths.items():
        part = read_or_empty(spark, path, states[name]).withColumn("bucket", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result
