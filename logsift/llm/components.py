"""Connected components of a graph given by its links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds the smallest neighbour of u to every pair; a hub's pairs are split by the skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both).withColumn("least", F.least("least", "u"))
    return near.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    near = _with_least(links.filter("u > v"))
    moved = near.filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(near.select("u", F.col("least").alias("v")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has a link; the label is the component's smallest node.

    links: (u, v) of one comparable type, in any direction, repeats and self links allowed.
    Every round is a table of its own in the shared folder. The rounds end when the links no
    longer change, which is when each component is a star around its smallest node.
    """
    proper = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(proper.filter("u > v").distinct(), "components")

    def state(rows: DataFrame) -> tuple:
        mix = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(rows.agg(F.count("*"), F.sum(mix)).first())

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = written(_small_star(_large_star(now)).distinct(), "components")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
