"""Shared helpers: stored steps, byte views of Arrow text, hashing in NumPy.

Every operator reads whole texts. Inside a task, a batch is cut into pieces of bounded
size, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelloom.session import checkpoint_root

PIECE_BYTES = 2 << 20
U64 = np.uint64
#: Fixed odd multipliers for hashing.
BASE = U64(0x9E3779B97F4A7C15)
MIX_A = U64(0xBF58476D1CE4E5B9)
MIX_B = U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Steps:
    """Stored intermediate tables of one run, in the folder all executors share.

    ``keep`` writes a step and reads it back: lineage is cut durably, and the driver lets
    go of the shuffle files behind it. ``drop`` deletes a step that no later one reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/panelloom/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, free: bool = True) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("error").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        if free:  # shuffle files go when the driver collects their handles
            for _ in range(2):
                gc.collect()
                self.spark.sparkContext._jvm.System.gc()
                time.sleep(0.4)
        return kept

    def drop(self, name: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        hadoop.getFileSystem(conf).delete(hadoop, True)


def batch_rows(spark: SparkSession, rows: int = 250) -> None:
    """Rows of an Arrow batch: long texts must not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``; at its end the memory it freed goes back to the system. A Python
    worker outlives its task, and what it holds on to counts against the tasks of other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return whole


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets; null counts as empty."""
    filled = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[
        filled.offset : filled.offset + len(filled) + 1
    ]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(
    batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges whose text has at most ``limit`` bytes (or a single row), with the bytes
    of that range and its offsets from 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = as_bytes(batch.column(batch.schema.get_field_index(name)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (
                batch.slice(first, last - first),
                data[offsets[first] : offsets[last]],
                offsets[first : last + 1] - offsets[first],
            )
            first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
        return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), U64)
    out[1:] = BASE
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from every position (``len(data) - n + 1`` of them)."""
    if len(data) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        have: dict[int, np.ndarray] = {1: data.astype(U64) + U64(1)}
        size, total, width = 1, None, 0
        rest = n
        while rest:
            if rest & 1:
                block = have[size]
                if total is None:
                    total, width = block, size
                else:
                    count = len(data) - (width + size) + 1
                    total = total[:count] * BASE ** U64(size) + block[width : width + count]
                    width += size
            rest >>= 1
            if rest:
                block = have[size]
                have = {
                    2 * size: block[: len(block) - size] * BASE ** U64(size) + block[size:]
                }
                size *= 2
        return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of ``width`` entries."""
    if len(x) < width:
        return x[:0]
    size, best = 1, x
    while 2 * size <= width:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    return np.minimum(best[: len(x) - width + 1], best[width - size : width - size + len(x) - width + 1])
