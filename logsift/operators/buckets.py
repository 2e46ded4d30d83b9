"""Severity buckets: which lines of which job are worth looking at, and how many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import fresh_folder

# --- fixed values: (bucket, newest entries kept) in order ------------------------------------
BUCKET_LIMITS = [
    ("critical_fatal", 5000),
    ("errors", 2000),
    ("warnings", 1000),
    ("system_issues", 5000),
]
DOCKER_JOB = "docker"
SYSTEM_JOB = "system"
ERROR_LEVELS = ["error", "err", "ERROR"]
WARNING_LEVELS = ["warn", "warning", "WARN", "WARNING"]
CRITICAL_WORDS = [
    r"\bfatal\b",
    r"\bpanic\b",
    r"\bsegfault\b",
    r"out of memory",
    r"\boom[-_ ]?kill",
    r"core dump",
    r"\bSIGKILL\b",
    r"\bSIGSEGV\b",
    r"\bSIGABRT\b",
]
SYSTEM_WORDS = [r"\berror\b", r"\bfailed\b", r"\bcritical\b", r"\bpanic\b", r"\boom[-_ ]?kill"]

# A part of every word in lower case, to rule out most lines by plain text search. None holds an
# s, the one letter here with an upper-case partner (the long s) that lower-casing leaves as it is.
CRITICAL_PARTS = [
    "fatal", "panic", "egfault", "out of memory", "oom", "core dump", "igkill", "egv", "igabrt",
]
SYSTEM_PARTS = ["error", "failed", "critical", "panic", "oom"]

RANK_SLICES = 256
# Sketches of this size miss a rank by less than a quarter of a percent; the bracket is read from a grid of
# quantiles, so many steps to either side.
SKETCH_SIZE = 2048
SKETCH_GRID = 256
SKETCH_MARGIN = 1
# A bucket's entries that one task ranks.
RANKED_ROWS = 1_000_000

BUCKETS = [name for name, _ in BUCKET_LIMITS]


def _any_word(words: list[str], parts: list[str]) -> Column:
    """Case-blind search for any of the words; the boundaries here know only ASCII letters."""
    shapes = []
    for word in words:
        shape = word
        if shape.startswith(r"\b"):
            shape = "(?<![0-9A-Za-z_])" + shape[2:]
        if shape.endswith(r"\b"):
            shape = shape[:-2] + "(?![0-9A-Za-z_])"
        shapes.append(shape)
    lowered = F.lower("line")
    hinted = F.contains(lowered, F.lit(parts[0]))
    for part in parts[1:]:
        hinted = hinted | F.contains(lowered, F.lit(part))
    return hinted & F.rlike("line", F.lit("(?iu)" + "|".join(shapes)))


def _level() -> Column:
    # Most lines carry no level at all; only those that mention the key are parsed.
    return F.when(F.contains("line", F.lit('level')), F.get_json_object("line", "$.level"))


def is_critical_fatal() -> Column:
    return (F.col("job") == DOCKER_JOB) & _any_word(CRITICAL_WORDS, CRITICAL_PARTS)


def is_error() -> Column:
    return (F.col("job") == DOCKER_JOB) & _level().isin(ERROR_LEVELS)


def is_warning() -> Column:
    return (F.col("job") == DOCKER_JOB) & _level().isin(WARNING_LEVELS)


def is_system_issue() -> Column:
    return (F.col("job") == SYSTEM_JOB) & _any_word(SYSTEM_WORDS, SYSTEM_PARTS)


PREDICATES = {
    "critical_fatal": is_critical_fatal,
    "errors": is_error,
    "warnings": is_warning,
    "system_issues": is_system_issue,
}


def bucket(lines: DataFrame, name: str) -> DataFrame:
    return lines.filter(PREDICATES[name]())


def tag_buckets(lines: DataFrame) -> DataFrame:
    """One row per (line, matching bucket), from a single scan of the lines."""
    tagged = lines.withColumn("_level", F.when(F.col("job") == DOCKER_JOB, _level()))
    docker = F.col("job") == DOCKER_JOB
    tests = {
        "critical_fatal": docker & _any_word(CRITICAL_WORDS, CRITICAL_PARTS),
        "errors": F.col("_level").isin(ERROR_LEVELS),
        "warnings": F.col("_level").isin(WARNING_LEVELS),
        "system_issues": (F.col("job") == SYSTEM_JOB) & _any_word(SYSTEM_WORDS, SYSTEM_PARTS),
    }
    entries = [
        F.when(tests[name], F.struct(F.lit(name).alias("bucket"), F.lit(i).alias("bucket_ord")))
        for i, name in enumerate(BUCKETS)
    ]
    return (
        tagged.select(
            *[F.col(c) for c in lines.columns],
            F.inline(F.array_compact(F.array(*entries))),
        )
    )


def bucket_limit(
    tagged: DataFrame, limits: dict[str, int] | None = None, per: tuple[str, ...] = ("run_id",)
) -> DataFrame:
    """The newest entries of each bucket, up to its limit.

    One bucket may hold a third of all lines, so it is ranked twice: first in slices by input
    partition, where every task drops what cannot be among the newest of its own rows before
    anything is shuffled, then once more over what the slices kept. Limits that are too high for that are
    found from a sketch of the times instead (newest_by_sketch).
    """
    limits = dict(BUCKET_LIMITS) if limits is None else limits
    largest = int(tagged.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if max(limits.values()) > largest:
        return newest_by_sketch(tagged, limits, per)
    group = [*per, "bucket"]
    cap = _caps(limits)
    # The constant bound is what the pruning before the shuffle works from.
    within = (F.col("_rank") <= max(limits.values())) & (F.col("_rank") <= cap[F.col("bucket")])

    def newest(rows: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*_newest_first())
        return rows.withColumn("_rank", F.row_number().over(window)).filter(within).drop("_rank")

    sliced = tagged.withColumn("_slice", F.spark_partition_id() % RANK_SLICES)
    return newest(newest(sliced, *group, "_slice").drop("_slice"), *group)


def _newest_first() -> list[Column]:
    return [F.col("ts_ns").desc(), F.col("job"), F.col("service_name"), F.col("line")]


def _caps(limits: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])


def newest_by_sketch(
    tagged: DataFrame,
    limits: dict[str, int],
    per: tuple[str, ...] = ("run_id",),
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """The same for limits of any height, without ranking what a limit keeps.

    A sketch of each bucket's times brackets the time of its last kept entry. Counts prove that it lies
    within, entries beyond the bracket are kept or dropped as they are, and only those inside it are
    looked at again: by another sketch while they are more than ranked_rows in some bucket, then one by one.
    A bracket that counts disprove is widened to the whole bucket. The entries are read several times,
    so they are written first.
    """
    spark, group = tagged.sparkSession, [*per, "bucket"]
    path = fresh_folder(spark, "entries")
    tagged.filter(F.col("bucket").isin(list(limits))).write.parquet(path)
    left = spark.read.schema(tagged.schema).parquet(path)
    rooms = left.groupBy(*group).agg(F.count("*").alias("_n"))
    rooms = rooms.withColumn("_room", _caps(limits)[F.col("bucket")].cast("bigint")).filter("_room > 0")
    kept, before = [], None
    while True:
        cuts = _cuts(left, rooms, group)
        widest = cuts.agg(F.max("_inside").alias("most")).first()["most"]
        met = left.join(cuts, group)
        sure = F.isnull("_low") | (F.col("ts_ns") > F.col("_high"))
        kept.append(met.filter(sure).select(*tagged.columns))
        open_ = met.filter(~sure & (F.col("ts_ns") >= F.col("_low")))
        left, rooms = open_.select(*tagged.columns), cuts.filter("_low is not null").select(
            *group, F.col("_inside").alias("_n"), (F.col("_room") - F.col("_above")).alias("_room")
        )
        if widest is None or widest <= ranked_rows or widest == before:
            break  # few enough, or all of one time
        before = widest
    window = Window.partitionBy(*group).orderBy(*_newest_first())
    last = left.join(rooms, group).withColumn("_rank", F.row_number().over(window))
    kept.append(last.filter(F.col("_rank") <= F.col("_room")).select(*tagged.columns))
    return union_buckets(kept)


def _cuts(rows: DataFrame, rooms: DataFrame, group: list[str]) -> DataFrame:
    """(group, _room, _low, _high, _above, _inside) as a table, a row for each bucket that has room.

    The bounds are null where all entries fit. Entries after _high are counted in _above.
    """
    spark = rows.sparkSession
    ranks = F.array(*[F.lit(i / SKETCH_GRID) for i in range(SKETCH_GRID + 1)])
    sketched = rows.groupBy(*group).agg(
        F.kll_sketch_agg_bigint("ts_ns", F.lit(SKETCH_SIZE)).alias("_sketch"),
        F.min("ts_ns").alias("_first"),
        F.max("ts_ns").alias("_final"),
    )
    share = (F.lit(1.0) - F.col("_room") / F.col("_n")) * SKETCH_GRID
    quantiles = F.kll_sketch_get_quantile_bigint("_sketch", ranks)
    low = F.get("_q", (F.floor(share) - SKETCH_MARGIN).cast("int"))
    high = F.get("_q", (F.ceil(share) + SKETCH_MARGIN).cast("int"))
    bounds = sketched.join(rooms, group).withColumn("_q", quantiles)
    bounds = bounds.select(
        *group,
        "_room",
        "_first",
        "_final",
        F.when(F.col("_n") > F.col("_room"), F.coalesce(low, "_first")).alias("_low"),
        F.when(F.col("_n") > F.col("_room"), F.coalesce(high, "_final")).alias("_high"),
    )
    path = fresh_folder(spark, "bounds")
    bounds.write.parquet(path)
    bounds = spark.read.schema(bounds.schema).parquet(path)
    counted = rows.join(bounds, group).groupBy(*group, "_room", "_first", "_final", "_low", "_high").agg(
        F.count_if(F.col("ts_ns") > F.col("_high")).alias("_above"),
        F.count_if(F.col("ts_ns").between(F.col("_low"), F.col("_high"))).alias("_inside"),
        F.count("*").alias("_all"),
    )
    proven = (F.col("_above") < F.col("_room")) & (F.col("_room") <= F.col("_above") + F.col("_inside"))
    wide = F.col("_low").isNotNull() & ~proven
    cuts = counted.select(
        *group,
        "_room",
        F.when(wide, F.col("_first")).otherwise(F.col("_low")).alias("_low"),
        F.when(wide, F.col("_final")).otherwise(F.col("_high")).alias("_high"),
        F.when(wide, 0).otherwise(F.col("_above")).alias("_above"),
        F.when(wide, F.col("_all")).otherwise(F.col("_inside")).alias("_inside"),
    )
    path = fresh_folder(spark, "cuts")
    cuts.write.parquet(path)
    return spark.read.schema(cuts.schema).parquet(path)


def limit_counts(
    tagged: DataFrame, limits: dict[str, int] | None = None, per: tuple[str, ...] = ("run_id",)
) -> DataFrame:
    """How many entries of each bucket its limit keeps and drops."""
    limits = dict(BUCKET_LIMITS) if limits is None else limits
    cap = _caps(limits)[F.col("bucket")]
    counted = tagged.groupBy(*per, "bucket").agg(F.count("*").alias("entries"))
    kept = F.least("entries", F.coalesce(cap, F.lit(0)).cast("bigint"))
    return counted.select(*per, "bucket", kept.alias("kept"), (F.col("entries") - kept).alias("dropped"))


def union_buckets(parts: list[DataFrame]) -> DataFrame:
    """All entries of all buckets; a line found by two of them stays twice."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def bucket_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("bucket").agg(F.count("*").alias("entries"))
