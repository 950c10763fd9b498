"""Document fingerprints from closed syncmers.

A window of ``K`` bytes is an anchor when the smallest of its inner ``S``-byte hashes is the
first or the last of them. Whether a window is an anchor depends on its own bytes alone, so
an edit moves no anchor that it does not touch. A fingerprint lists the anchors in text order,
each as 24 bits of its hash and the distance from the anchor before it (8 bits, saturated):
two fingerprints match where anchors agree in content and in relative position.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import (
    PIECE_BYTES,
    U64,
    batch_rows,
    column,
    gram_hashes,
    mix,
    powers,
    sliding_min,
)

K, S = 31, 11
RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def anchor_codes(texts: list[bytes]) -> list[np.ndarray]:
    """Fingerprint of each text as uint32 codes (hash in the upper 24 bits, gap below).

    A text with bytes but without any anchor has one code, made of the whole text.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    inner = gram_hashes(data, S)
    width = K - S + 1
    smallest = sliding_min(inner, width)
    edge = (smallest == inner[: len(smallest)]) | (smallest == inner[width - 1 :])
    at = np.flatnonzero(edge)
    owner = np.searchsorted(ends, at, "right")
    inside = at + K <= ends[owner]
    at, owner = at[inside], owner[inside]
    codes = np.zeros(len(at), np.uint32)
    scale = powers(K)
    for lo in range(0, len(at), 1 << 16):
        part = at[lo : lo + (1 << 16)]
        windows = data[part[:, None] + np.arange(K)].astype(U64) + U64(1)
        with np.errstate(over="ignore"):
            codes[lo : lo + len(part)] = mix((windows * scale).sum(axis=1)) >> U64(40)
    gap = np.zeros(len(at), np.int64)
    if len(at) > 1:
        gap[1:] = np.where(owner[1:] == owner[:-1], np.minimum(np.diff(at), 255), 0)
    codes = (codes << np.uint32(8)) | gap.astype(np.uint32)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = []
    for i, text in enumerate(texts):
        own = codes[bounds[i] : bounds[i + 1]]
        if not len(own) and text:
            own = np.array(
                [int.from_bytes(hashlib.sha256(text).digest()[:3], "big") << 8], np.uint32
            )
        found.append(own)
    return found


def as_text(codes: np.ndarray) -> str:
    return codes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints as multisets of codes; two empty ones are equal."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(place[: len(a)], minlength=len(values))
    right = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every text, in hexadecimal; null and empty texts have an
    empty one. Repeated rows stay, other columns are ignored."""
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            texts = [(t or "").encode() for t in column(batch, "text").to_pylist()]
            for lo, hi in _groups(texts):
                marks = [as_text(c) for c in anchor_codes(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(marks, pa.string())], ["doc_id", "fingerprint"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, fingerprint string"
    )


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > PIECE_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def _edit(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each document followed by its next one of the same slice."""
    held: list[tuple] = []  # (slice, doc_id, text, own): the last row waits for its successor
    size = 0
    for batch in batches:
        rows = zip(*[column(batch, c).to_pylist() for c in ("slice", "doc_id", "text", "own")])
        for row in rows:
            held.append(row)
            size += len(row[2])
            if size > PIECE_BYTES // 2 and len(held) > 1:
                yield _results(held)
                held, size = held[-1:], len(row[2])
    if len(held) > 1:
        yield _results(held)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    texts = [r[2] for r in rows]
    pairs = [
        i for i in range(len(rows) - 1) if rows[i][3] and rows[i][0] == rows[i + 1][0]
    ]
    edited = [_edit(texts[i], texts[i + 1]).encode() for i in pairs]
    codes = anchor_codes([t.encode() for t in texts])
    changed = anchor_codes(edited)
    columns = [
        pa.array([rows[i][1] for i in pairs], pa.int64()),
        pa.array([len(texts[i]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([as_text(codes[i]) for i in pairs], pa.string()),
        pa.array([as_text(c) for c in changed], pa.string()),
        pa.array([likeness(codes[i], c) for i, c in zip(pairs, changed)], pa.float64()),
        pa.array([likeness(codes[i], codes[i + 1]) for i in pairs], pa.float64()),
    ]
    names = [part.split()[0] for part in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names)


def _slice_of(cuts: list[int]) -> Column:
    """Number of ``cuts`` up to the id, found in two short steps."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("id")))

    def literal(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    group = upto(literal([g[0] for g in groups]))
    fine = F.element_at(F.array(*[literal(g) for g in groups]), F.greatest(group, F.lit(1)))
    return F.greatest(group - 1, F.lit(0)) * width + upto(fine)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness.

    The next document is the one with the next smaller ``doc_id``; after the smallest comes
    the largest (a single document follows itself). Rows without an id come last; repeated ids
    are ordered by text. Null and empty texts have empty fingerprints, which equal each other.

    The order is cut into slices at quantiles of the ids. Only the last row of a slice needs a
    row of another one, so that row is sent to both; texts move once.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Bounded by the number of slices: their cuts, and the largest id below each cut.
    ids = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    cuts = sorted(
        set(
            ids.agg(
                F.percentile_approx("id", [i / slices for i in range(1, slices)] or [0.5], 10000)
            ).first()[0]
            or []
        )
    )
    number = _slice_of(cuts)
    heads = (
        ids.select("id", number.alias("slice")).groupBy("slice").agg(F.max("id").alias("id"))
        .orderBy(F.desc("slice")).collect()
    )
    if not heads:
        return spark.createDataFrame([], RESULT)
    # The first row of a slice follows the last row of the slice above, or of the lowest one.
    after = [(h["slice"], h["id"], heads[i - 1]["slice"]) for i, h in enumerate(heads)]
    first = spark.createDataFrame(after, "slice int, id bigint, above int")
    placed = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn(
        "slice", number
    )
    own = placed.select("slice", "id", "doc_id", "text", F.lit(True).alias("own"))
    # Copies of the slices' first rows; of a repeated id only the first text.
    lead = (
        placed.join(F.broadcast(first), ["slice", "id"])
        .groupBy(F.col("above").alias("slice"), "id", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("slice", "id", "doc_id", "text", F.lit(False).alias("own"))
    )
    return (
        own.unionByName(lead)
        .repartition(slices, "slice")
        .sortWithinPartitions("slice", F.desc("own"), F.desc("id"), "text")
        .select("slice", "doc_id", "text", "own")
        .mapInArrow(_compare, RESULT)
    )
