"""From log lines to templates: masking, hashing, counting, sample lines, window assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.identity import add_identity, template_hash
from logsift.functions.masking import normalize_lines, placeholder_kinds

# --- fixed values ---------------------------------------------------------------------------
DEFAULT_LOOKBACK_HOURS = 24
DEFAULT_EXEMPLARS = 3

IDENTITY = ["service_name", "logger", "template_text"]
HOUR_NS = 3_600_000_000_000
# larger than any time in nanoseconds
ORDER_STEP = "10000000000000000000"

# Hours of run windows that are sent to every task: some 40 bytes each, 4 MB at most.
BROADCAST_ROWS = 100_000
# Cells for each shuffle partition where the lines of the hours are divided.
CELLS_OF_PARTITION = 8


def ns_to_timestamp(column: str) -> Column:
    """Nanoseconds to Spark's microseconds; comparisons stay in nanoseconds where they can."""
    return F.expr(f"timestamp_micros({column} div 1000)")


def lookback_window(end: Column, hours: int = DEFAULT_LOOKBACK_HOURS) -> Column:
    """Start of the window that ends at ``end``."""
    return end - F.make_interval(hours=F.lit(hours))


def _floor_div(column: str, unit: int) -> Column:
    """Integer floor; nanoseconds are too large for the doubles that "/" would give."""
    return F.expr(f"({column} - pmod({column}, {unit}L)) div {unit}L")


def _hours(lines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with their hour, and (hour, run, bounds) of every hour of the runs' windows."""
    spans = runs.select(
        F.col("id").alias("run_id"),
        (F.unix_micros("window_start") * 1000).alias("_start"),
        (F.unix_micros("window_end") * 1000).alias("_end"),
    ).filter("_start < _end")
    hours = F.sequence(_floor_div("_start", HOUR_NS), _floor_div("(_end - 1)", HOUR_NS))
    listed = spans.withColumn("_hour", F.explode(hours))
    return lines.withColumn("_hour", _floor_div("ts_ns", HOUR_NS)), listed


def full_hours(lines: DataFrame, cells: int) -> dict[int, int]:
    """The hours with more lines than a cell should hold, and how many cells each is divided into.

    A cell should hold the lines of all over ``cells``. So fewer hours than cells are full, and they
    have fewer than twice as many cells together, however many lines and hours there are.
    """
    counts = lines.groupBy(_floor_div("ts_ns", HOUR_NS).alias("hour")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(1, -(-total // cells))
    return {r["hour"]: -(-r["n"] // size) for r in counts.filter(F.col("n") > size).collect()}


def _in_cells(timed: DataFrame, listed: DataFrame, divided: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell of their hour: a line is in one of them, a run in all."""
    cells = F.lit(1).cast("bigint")
    if divided:
        pairs = [F.lit(x).cast("bigint") for pair in divided.items() for x in pair]
        cells = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_hour")), cells)
    of_line = F.pmod(F.xxhash64("ts_ns", "line"), cells)
    every = F.sequence(F.lit(0).cast("bigint"), cells - 1)
    return timed.withColumn("_cell", of_line), listed.withColumn("_cell", F.explode(every))


def near_runs(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The lines between the first start and the last end of the runs' windows.

    A plain filter on the time, which Spark takes below shuffles and searches to where lines are read.
    """
    start, end = ((F.unix_micros(c) * 1000).alias(c) for c in ("window_start", "window_end"))
    bounds = runs.select(start, end).filter("window_start < window_end")
    first, last = bounds.agg(F.min("window_start"), F.max("window_end")).first()
    if first is None:
        return lines.filter(F.lit(False))
    return lines.filter((F.col("ts_ns") >= first) & (F.col("ts_ns") < last))


def lines_of_runs(lines: DataFrame, runs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per (line, run whose window holds it), start included and end excluded.

    Every run counts with its own window from the run table, whenever it started; windows may
    overlap or leave gaps. A run is listed under each hour of its window and met by the lines of
    that hour, so the join is one on equal keys; the bounds are checked to the nanosecond after it.
    As many listed hours as ``broadcast_rows`` are sent to the lines, which then stay where they are.
    With more of them both sides are shuffled; hours are divided into cells by their measured numbers
    of lines, so that one hour with most of the lines is spread like many.
    """
    timed, listed = _hours(near_runs(lines, runs), runs)
    if listed.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = timed.join(F.broadcast(listed), "_hour")
    else:
        partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        timed, listed = _in_cells(timed, listed, full_hours(lines, CELLS_OF_PARTITION * partitions))
        met = timed.join(listed.hint("shuffle_hash"), ["_hour", "_cell"]).drop("_cell")
    return met.filter("ts_ns >= _start and ts_ns < _end").drop("_hour", "_start", "_end")


def assign_runs(
    lines: DataFrame,
    first_end_ns: int,
    period_hours: int = DEFAULT_LOOKBACK_HOURS,
    lookback_hours: int = DEFAULT_LOOKBACK_HOURS,
) -> DataFrame:
    """One row per (line, run whose window holds it).

    Run r ends at ``first_end + (r-1) * period`` and looks back ``lookback_hours``. The runs of
    a line follow from its time by arithmetic, so no join against the run table is needed; with a
    lookback longer than the period a line belongs to several runs.
    """
    period, lookback = period_hours * HOUR_NS, lookback_hours * HOUR_NS

    def whole_periods(since_ns: int) -> Column:
        # integer floor; nanoseconds are too large for the doubles that "/" would give
        since = f"(ts_ns - {since_ns}L)"
        return F.expr(f"({since} - pmod({since}, {period}L)) div {period}L")

    last = whole_periods(first_end_ns - lookback) + 1
    if period == lookback:
        return lines.withColumn("run_id", last).filter("run_id >= 1")
    first = F.greatest(F.lit(1).cast("bigint"), whole_periods(first_end_ns) + 2)
    return (
        lines.withColumn("_runs", F.when(first <= last, F.sequence(first, last)))
        .withColumn("run_id", F.explode("_runs"))
        .drop("_runs")
    )


def templated(lines: DataFrame) -> DataFrame:
    """Lines with service, logger and template."""
    return normalize_lines(add_identity(lines))


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("template_hash", template_hash(*[F.col(c) for c in IDENTITY]))


def aggregate_templates(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count and first/last time per template.

    Grouped by the readable parts, so that equal lines already collapse inside each task and the
    hash is computed once per template instead of once per line. A line that sits in two
    buckets counts twice.
    """
    grouped = lines.groupBy(*by, *IDENTITY).agg(
        F.count("*").alias("count"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )
    return with_hash(grouped)


def aggregate_templates_dedup(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same with every physical line counted once, whatever buckets it is in.

    A template is a function of job, labels and line, so counting distinct lines first loses
    nothing and spreads a hot template over its lines.
    """
    keys = [*by, *IDENTITY, "job", "ts_ns", "line"]
    return aggregate_templates(lines.groupBy(*keys).agg(F.count("*").alias("_copies")), by)


def _line_groups(lines: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row per distinct raw line of a template, with its place in the encounter order.

    The place is one number, bucket first and then newest, because a number is aggregated in a
    hash table while a struct would make Spark sort the lines.
    """
    bucket = F.col("bucket_ord").cast("decimal(10,0)") * F.lit(ORDER_STEP).cast("decimal(20,0)")
    return lines.groupBy(*by, *IDENTITY, "line").agg(
        F.count("*").alias("copies"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
        F.min(bucket - F.col("ts_ns").cast("decimal(19,0)")).alias("met"),
    )


def exemplar_lines(
    lines: DataFrame, limit: int = DEFAULT_EXEMPLARS, by: tuple[str, ...] = ()
) -> DataFrame:
    """The first ``limit`` distinct raw lines of each template; one even if the limit is zero.

    First met means by bucket order, then newest. Distinct lines are grouped first, spread over
    the cluster by line, and ranking them keeps at most ``limit`` per template and task before
    the rows of a template come together.
    """
    keep = max(limit, 1)
    first_met = Window.partitionBy(*by, "template_hash").orderBy("met", "line")
    return (
        with_hash(_line_groups(lines, by))
        .withColumn("position", F.row_number().over(first_met))
        .filter(F.col("position") <= keep)
        .select(*by, "template_hash", F.col("position").cast("bigint"), "line")
    )


def in_slices(lines: DataFrame) -> DataFrame:
    """Lines dealt evenly over the shuffle partitions; the slice is the partition a line is in.

    Lines are dealt by time and text, so neither a template nor a line that is repeated at many times
    ends up in one slice. What is grouped by the slice as well needs no further shuffle.
    """
    slices = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("slice", F.pmod(F.xxhash64("ts_ns", "line"), F.lit(slices)).cast("int"))
    return dealt.repartitionById(slices, F.col("slice"))


def occurrences(lines: DataFrame, exemplars: int = DEFAULT_EXEMPLARS) -> DataFrame:
    """What a run records: one row per template with count, times and sample lines.

    Lines come in slices (in_slices); if they don't they are dealt here. Each task counts its slice of
    every template and gives up its first few distinct lines, so what is shuffled to put the slices of
    a template together is a few lines from each, however many lines a template has. A line can
    be among the first of several slices; its first place counts, which is its place among all. The input
    is read once, nothing is joined, and no task sees all lines of a hot template.
    """
    if "slice" not in lines.columns:
        lines = in_slices(lines)
    keep = max(exemplars, 1)
    template = ["run_id", *IDENTITY]
    in_slice = Window.partitionBy(*template, "slice").orderBy("met", "line")
    first_few = F.when(F.col("place") <= keep, F.struct("met", "line"))
    slices = (
        _line_groups(lines, ("run_id", "slice"))
        .withColumn("place", F.row_number().over(in_slice))
        .groupBy(*template, "slice")
        .agg(
            F.sum("copies").alias("copies"),
            F.min("first_ns").alias("first_ns"),
            F.max("last_ns").alias("last_ns"),
            F.collect_list(first_few).alias("samples"),
        )
    )
    whole = slices.groupBy(*template).agg(
        F.sum("copies").alias("count"),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
        F.sort_array(F.flatten(F.collect_list("samples"))).alias("samples"),
    )
    in_order = F.array_distinct(F.transform("samples", lambda sample: sample["line"]))
    return with_hash(whole.withColumn("exemplar_lines", F.slice(in_order, 1, keep)).drop("samples"))


def placeholder_counts(templates: DataFrame) -> DataFrame:
    """How often each kind of placeholder occurs."""
    kinds = templates.select(F.explode(placeholder_kinds(F.col("template_text"))).alias("placeholder"))
    return kinds.groupBy("placeholder").agg(F.count("*").alias("occurrences"))


def compression_ratio(lines: DataFrame) -> DataFrame:
    """Lines per distinct template, per job.

    Counting happens per template first, so no task has to hold all templates of a job.
    """
    per_template = lines.groupBy("job", *IDENTITY).agg(F.count("*").alias("n"))
    return per_template.groupBy("job").agg(
        F.sum("n").alias("lines"),
        F.count("*").alias("templates"),
        (F.sum("n") / F.count("*")).alias("lines_per_template"),
    )
