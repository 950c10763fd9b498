"""Sending many small hashed entries through a shuffle in packed form.

A task sorts its entries by destination and writes one row per destination, each field as one
binary column. Bytes are stored plane by plane, so the zero bytes of ids and counters vanish
under Spark's own compression, and a row's overhead is paid once per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH_ENTRIES = 1 << 20


def plane(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplane(raw: bytes, dtype: np.dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


class Packer:
    """Collects entries of one layout and hands them out as blocks by destination."""

    def __init__(self, kind: int, fields: dict[str, type], width: int) -> None:
        self.kind, self.fields, self.width = kind, fields, width
        self.parts: list[np.ndarray] = []
        self.values: dict[str, list[np.ndarray]] = {name: [] for name in fields}
        self.size = 0

    def add(self, part: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append(part.astype(np.int32))
        for (name, dtype), value in zip(self.fields.items(), values, strict=True):
            self.values[name].append(value.astype(dtype))
        self.size += len(part)

    def full(self) -> bool:
        return self.size >= FLUSH_ENTRIES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        part = np.concatenate(self.parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        bounds = np.flatnonzero(np.diff(part)) + 1
        starts = np.concatenate([[0], bounds])
        ends = np.concatenate([bounds, [len(part)]])
        blocks = []
        for name in self.fields:
            value = np.concatenate(self.values[name])[order]
            blocks.append(
                pa.array([plane(value[a:b]) for a, b in zip(starts, ends)], pa.binary())
            )
            self.values[name] = []
        blank = pa.nulls(len(starts), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts]),
                pa.array(np.full(len(starts), self.kind, np.int32)),
                *blocks,
                *[blank] * (self.width - len(blocks)),
            ],
            layout(self.width),
        )
        self.parts, self.size = [], 0


def layout(width: int) -> list[str]:
    return ["part", "kind", *[f"f{i}" for i in range(width)]]


def schema(width: int) -> str:
    return "part int, kind int, " + ", ".join(f"f{i} binary" for i in range(width))


def send(blocks: DataFrame, parts: int) -> DataFrame:
    """Every block to the partition that it names."""
    return blocks.repartitionById(parts, F.col("part"))


def gather(
    batches: Iterable[pa.RecordBatch], kinds: dict[int, dict[str, type]]
) -> dict[int, dict[str, np.ndarray]]:
    """All entries of a partition, by kind."""
    found: dict[int, dict[str, list[np.ndarray]]] = {
        kind: {name: [] for name in fields} for kind, fields in kinds.items()
    }
    for batch in batches:
        for i, kind in enumerate(batch.column(1).to_pylist()):
            for j, (name, dtype) in enumerate(kinds[kind].items()):
                raw = batch.column(2 + j)[i].as_py()
                found[kind][name].append(unplane(raw, dtype))
    return {
        kind: {
            name: np.concatenate(found[kind][name]) if found[kind][name] else np.zeros(0, dtype)
            for name, dtype in fields.items()
        }
        for kind, fields in kinds.items()
    }
