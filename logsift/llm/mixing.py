"""Mixing of sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken rate times, the source's target over its size: the whole
part of the rate for certain, and once more with its fraction as probability. Documents are
rounded in pairs: the two exchange words until one of them is settled, in a direction that keeps
every probability right on average, and the words they take together don't change. What is not
settled goes on to the next pair. Pairs are formed in buckets of bounded size; what is left of
each bucket goes one level up a tree of buckets, to one residual document for each source, which is
taken or not, whichever is nearer. So the words taken differ from the target by half a document at
most, however large the source; as the large documents of a bucket come first, it tends to be
a small one. Built-in expressions only; random numbers are hashes of the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import row_keys, written

# Fixed by the contract.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
# Documents in a bucket of the tree, on average.
BUCKET = 48
SEED = 99
# Probabilities this close to 0 or 1 count as settled: the rounding of doubles.
EPSILON = 1e-9


def sizes(docs: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """(k1, k2, doc, source, size, copy) of every row; copy numbers rows that are equal in all."""
    k1, k2 = row_keys(id_column, source_column, text_column)
    size = F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        F.col(id_column).alias("doc"),
        F.col(source_column).alias("source"),
        size.alias("size"),
    )
    same = slim.groupBy(*slim.columns).count()
    return same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("count")


def targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) for every source.

    Sources in code point order, null last, get the weights in turn. Each target is the smaller of
    most times the source's size and a level times its weight; the level makes the targets add up to
    share of all sizes. That is what sharing the excess by weight until none is above comes to.
    """
    if share > most:
        raise ValueError("sources can't fill the share")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row for each source
    order = Window.orderBy(F.isnull("source"), "source")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1
    )
    weighed = by_source.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * F.lit(most)
    fullest = Window.orderBy(cap / F.col("weight"), F.isnull("source"), "source")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    onward = fullest.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    # the first source that the level does not fill sets it
    levels = weighed.withColumn("cap", cap).withColumn("level", level)
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    found = levels.withColumn("chosen", F.first(open_, ignorenulls=True).over(
        fullest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    target = F.least(F.col("cap"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap")))
    return found.select("source", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)) / float(1 << 53)


def _pair(state: Column, unit: Column) -> Column:
    """One step: the unit left so far and the next one exchange words until one is settled."""
    held = state["held"]
    up = F.least((1 - held["p"]) * held["size"], unit["p"] * unit["size"])  # words held can gain
    down = F.least(held["p"] * held["size"], (1 - unit["p"]) * unit["size"])  # words it can give
    u = _uniform(held["id"], unit["id"])
    gained = F.when(u * (up + down) < down, up).otherwise(-down)
    p = held["p"] + gained / held["size"]
    q = unit["p"] - gained / unit["size"]

    def with_p(one: Column, value: Column) -> Column:
        kept = [one[c].alias(c) for c in ("order", "id", "size")]
        return F.struct(*kept, value.alias("p"))

    moved = F.array(with_p(held, p), with_p(unit, q))
    sure = F.filter(moved, lambda x: (x["p"] < EPSILON) | (x["p"] > 1 - EPSILON))
    rest = F.filter(moved, lambda x: (x["p"] >= EPSILON) & (x["p"] <= 1 - EPSILON))
    decided = F.transform(
        sure, lambda x: F.struct(x["id"].alias("id"), F.when(x["p"] > 0.5, 1).otherwise(0).alias("extra"))
    )
    both = F.struct(
        F.get(rest, F.lit(0)).alias("held"), F.concat(state["done"], decided).alias("done")
    )
    first = F.struct(unit.alias("held"), state["done"].alias("done"))
    return F.when(held.isNull(), first).otherwise(both)


def rounded(units: DataFrame) -> DataFrame:
    """(id, extra) for units (source, id, size, p): extra is 0 or 1, 1 with probability p.

    The last unit of each source is rounded to the nearer.

    id is a struct that begins with a hash; size is above 0 and p strictly between 0 and 1.
    """
    rows = written(units.select("source", F.struct((-F.col("size")).alias("order"), "id", "size", "p").alias("unit")), "mix-units")
    total = rows.count()
    depth = max(1, math.ceil(math.log(max(total, 2), BUCKET)))
    out: list[DataFrame] = []
    unit_kind = rows.schema["unit"].dataType.simpleString()
    id_kind = rows.schema["unit"].dataType["id"].dataType.simpleString()
    for level in range(1, depth + 1):
        buckets = max(1, math.ceil(total / BUCKET**level))
        bucket = F.pmod(F.xxhash64(F.lit(level if level < depth else 0), F.col("unit.id")), F.lit(buckets))
        start = F.struct(
            F.lit(None).cast(unit_kind).alias("held"),
            F.array().cast(f"array<struct<id:{id_kind},extra:int>>").alias("done"),
        )
        groups = rows.groupBy("source", bucket.alias("bucket")).agg(
            F.sort_array(F.collect_list("unit")).alias("units")
        )
        state = written(
            groups.select("source", F.aggregate("units", start, _pair).alias("s")), "mix-level"
        )
        out.append(state.select(F.explode("s.done").alias("d")).select("d.id", "d.extra"))
        rows = state.filter("s.held is not null").select("source", F.col("s.held").alias("unit"))
    last = F.when(F.col("unit.p") > 0.5, 1).otherwise(0)
    out.append(rows.select(F.col("unit.id").alias("id"), last.alias("extra")))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """(k1, k2, copy, doc, size, source_size, target, times) for every row of docs.

    size counts words; a null text has none. times is how often the row is taken: the whole part of
    target over source_size, or one more. A source's taken words differ from its target by at
    most half the size of one of its documents. Documents without words are taken once at rates of 1
    and more, else not; a source without words has target 0. A null source is a source. Rows equal
    in id, source and text are numbered by copy. Reruns agree: chance is a hash of the row.
    """
    sized = written(sizes(docs, id_column, source_column, text_column), "mix-sizes")
    goal = written(targets(sized, weights, share, most), "mix-targets")
    # one row a source; the large side keeps its place
    met = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select(
        sized["*"], goal["source_size"], goal["target"]
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EPSILON)
    p = F.greatest(rate - whole, F.lit(0.0))
    identity = F.struct("k1", "k2", "copy", "doc", "size", "source_size", "target")
    planned = written(
        met.select("source", identity.alias("id"), "size", whole.cast("int").alias("whole"), p.alias("p")),
        "mix-planned",
    )
    open_ = (F.col("p") >= EPSILON) & (F.col("size") > 0)
    base = F.when(F.col("size") > 0, F.col("whole")).otherwise(F.least("whole", F.lit(1)))
    sure = planned.filter(~open_).select("id", base.alias("times"))
    units = planned.filter(open_).select(
        "source", F.struct("id", "whole").alias("id"), F.col("size").cast("double").alias("size"), "p"
    )
    drawn = rounded(units).select(
        F.col("id.id").alias("id"), (F.col("id.whole") + F.col("extra")).alias("times")
    )
    return sure.union(drawn).select("id.*", "times")


def mixed(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options
) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its columns."""
    plan = mix(docs, id_column=id_column, source_column=source_column, text_column=text_column, **options)
    taken = plan.groupBy("k1", "k2").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    k1, k2 = row_keys(id_column, source_column, text_column)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    met = keyed.join(taken.filter("times > 0"), ["k1", "k2"])
    # rows equal in id, source and text share what they are taken together, the first ones one more
    single = met.filter("rows = 1")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    several = met.filter("rows > 1").withColumn("place", place)
    each = F.floor(F.col("times") / F.col("rows")) + F.when(
        F.col("place") <= F.col("times") % F.col("rows"), 1
    ).otherwise(0)
    both = single.select("row", F.col("times").cast("int").alias("n")).union(
        several.select("row", each.cast("int").alias("n"))
    )
    return (
        both.filter("n > 0")
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .select("row.*")
    )
