"""What the operators share: tables, intermediate tables, batches, words and row keys."""

from __future__ import annotations

import ctypes
import gc
import re
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import fresh_folder

# White space of the word contracts: space and U+0009 to U+000D, the same that bytes.split() cuts at.
SPACE = re.compile(rb"[\x20\x09-\x0d]")
# A text is cut into pieces of about this many bytes, so that a very long one is never held as
# a list of all its words.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Python workers get batches bounded by rows and bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def give_back_memory() -> None:
    """Returns what a task has freed to the system: its worker goes on to other tasks or waits."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the folder all executors share; cuts lineage, survives lost executors."""
    path = fresh_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    _folders[table] = path
    return table


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an operator's own, in any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that `written` has returned; nothing may read them any more."""
    for table in tables:
        path = _folders.pop(table, None)
        if path is not None:
            deleted(table.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def row_keys(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the named columns, never null: the identity of a row.

    Rows equal in these columns share it, others practically never do (128 bits).
    """
    parts = [F.col(c) for c in columns]
    marks = [F.isnull(c).cast("int") for c in columns]
    return F.xxhash64(*parts, *marks), F.xxhash64(F.lit("second"), *marks, *reversed(parts))


def word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; cuts only at white space."""
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        cut = SPACE.search(data, min(at + PIECE_BYTES, len(data)))
        end = cut.end() if cut else len(data)
        yield data[at:end].split()
        at = end


def gathered(flat: np.ndarray, offset: np.ndarray, width: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The concatenation of the stored runs that rows name."""
    sizes = width[rows]
    ends = np.cumsum(sizes)
    shift = np.repeat(offset[rows] - (ends - sizes), sizes)
    return flat[np.arange(ends[-1] if ends.size else 0) + shift]


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the words in order as places among them, and the place in
    that order where each text's words begin, with the end. The empty word may be among the distinct ones,
    where white space is at the ends of a text; it is none of the words in order."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = words.dictionary_encode()
    places, found = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" not in found:
        return found, places, offsets
    full = places != found.index("")
    return found, places[full], np.concatenate([[0], np.cumsum(full)])[offsets]


# --- numbers on their way ------------------------------------------------------------------------------


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: all their lowest bytes, then all the next, compressed."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    body = pa.compress(planes, codec="zstd", asbytes=True) if values.size else b""
    return bytes([width]) + values.size.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def expanded(data: bytes, count: int = 1) -> list[np.ndarray]:
    """The arrays of so many squeezed ones in a row."""
    out, at = [], 0
    for _ in range(count):
        width, size, held = data[at], *(int.from_bytes(data[at + i : at + i + 4], "little") for i in (1, 5))
        values = np.zeros((size, 8), dtype=np.uint8)
        if size:
            body = pa.py_buffer(data).slice(at + 9, held)
            planes = np.frombuffer(pa.decompress(body, width * size, codec="zstd"), dtype=np.uint8)
            values[:, :width] = planes.reshape(width, size).T
        out.append(values.view("<u8").reshape(-1))
        at += 9 + held
    return out


def rising(keys: np.ndarray) -> np.ndarray:
    """The differences of ascending keys, which have fewer bytes than they."""
    return np.diff(keys, prepend=np.uint64(0))


def risen(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending 64-bit keys, with the end; a bucket is a range of keys."""
    bounds = [-(-(b << 64) // buckets) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, dtype=np.uint64)), [keys.size]])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads 64-bit keys evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
