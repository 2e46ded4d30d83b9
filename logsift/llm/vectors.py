"""Block matrix join of query vectors against all vectors: the frame both searches share.

Vectors are packed into blocks of bounded size where they are read. Every block belongs to a
stripe, queries are packed into query blocks, and a tile is one query block against the blocks
of one stripe. A task reads a tile's query block first and then streams the stripe's blocks past it,
so it holds one of each, and what it passes on is at most k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import small_batches

BLOCK_ROWS = 2048
QUERY_ROWS = 512
PACKED = "seq bigint, dim int, ids binary, data binary"


def usable(vector: str) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("double")),
    )
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def slim(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    return rows.filter(F.col("vec_id").isNotNull() & usable("vector"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False)


def _packed(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to size vectors of one length; components as doubles."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    context = TaskContext.get()
    seq = (context.partitionId() if context else 0) << 32

    def block(dim: int) -> pa.RecordBatch:
        nonlocal seq
        seq += 1
        ids = np.concatenate([x for x, _ in held[dim]])
        data = np.concatenate([x for _, x in held[dim]])
        held[dim] = []
        return pa.RecordBatch.from_pydict(
            {
                "seq": pa.array([seq], pa.int64()),
                "dim": pa.array([dim], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "data": pa.array([data.tobytes()], pa.binary()),
            }
        )

    for batch in rows:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("vector")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            data = _matrix(lists.take(pa.array(at))).reshape(-1, dim)
            for start in range(0, at.size, size):
                part = slice(start, start + size)
                held.setdefault(dim, []).append((ids[at[part]], data[part]))
                if sum(x.size for x, _ in held[dim]) >= size:
                    yield block(dim)
    for dim in held:
        if held[dim]:
            yield block(dim)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return ids, np.frombuffer(row["data"], dtype=np.float64).reshape(ids.size, row["dim"])


class Tile:
    """The search of one query block through one stripe; subclassed by each search."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.data, self.k = ids, data, k

    def scan(self, ids: np.ndarray, data: np.ndarray) -> None:
        raise NotImplementedError

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and scores, at most k for a query."""
        raise NotImplementedError


def tiles(
    vectors: DataFrame, every: int, k: int, tile: Callable[..., Tile], score: str
) -> DataFrame:
    """(query_id, vec_id, score): the best of every tile, for queries whose id every divides.

    vectors: (vec_id, vector) as slim() makes them. Of several vectors with one query id the
    smallest is the query. Repeated rows may be found once for each stripe.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    stripes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = (
        vectors.filter(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, BLOCK_ROWS)

    def pack_queries(rows: pa.Table) -> pa.Table:
        qb = rows.column("qb")[0].as_py()
        found = pa.Table.from_batches(list(_packed(iter(rows.combine_chunks().to_batches()), 1 << 30)))
        return found.add_column(0, "qb", pa.array([qb] * found.num_rows, pa.int32()))

    queries = (
        asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("qb")
        .applyInArrow(pack_queries, f"qb int, {PACKED}")
    )
    left = queries.withColumn(
        "stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    ).withColumn("kind", F.lit(0))
    right = (
        vectors.mapInArrow(pack, PACKED)
        .withColumn("stripe", F.pmod(F.xxhash64("seq"), F.lit(stripes)).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("kind", F.lit(1))
    )
    columns = ["qb", "stripe", "kind", "seq", "dim", "ids", "data"]
    order = columns[:4]
    both = left.select(*columns).unionByName(right.select(*columns))
    kind = pa.float64() if score == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, by_dim = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for search in by_dim.values():
                found = search.best()
                if found[0].size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[0]), pa.array(found[1]), pa.array(found[2], kind)],
                        ["query_id", "vec_id", "score"],
                    )

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns}
                if (row["qb"], row["stripe"]) != key:
                    yield from done()
                    key, by_dim = (row["qb"], row["stripe"]), {}
                ids, data = unpack(row)
                if row["kind"] == 0:
                    by_dim[row["dim"]] = tile(ids, data, k)
                elif row["dim"] in by_dim:
                    by_dim[row["dim"]].scan(ids, data)
        yield from done()

    return (
        both.repartition("qb", "stripe")
        .sortWithinPartitions(*order)
        .mapInArrow(run, f"query_id bigint, vec_id bigint, score {score}")
    )


def ranked(found: DataFrame, k: int, best_first: Column) -> DataFrame:
    """The k best of each query over all tiles, ties to the smaller vec_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
