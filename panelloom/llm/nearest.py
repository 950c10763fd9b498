"""Approximate nearest neighbours: inverted lists with an adaptive scan over dimensions.

Vectors are dealt into lists by their nearest center; the centers are fitted on a bounded
sample, every vector is indexed. A query visits its nearest lists. There, vectors are rotated at
random and compared in blocks of columns: after d of D dimensions the partial distance, scaled
by D / d, estimates the whole one, and a candidate is abandoned as soon as a test at that d
rejects that it can beat the query's current k-th distance. What survives is measured exactly,
in double precision, on the original vectors.

A list that holds most of the vectors (copies of one vector, say) is split into parts of
bounded size, and its queries go to every part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import Steps, batch_rows, column

SAMPLE = 100_000  # most vectors the centers are fitted on, in expectation
MOST_LISTS = 4096
PER_CENTER = 64  # sampled vectors per center
#: Share of the nearest neighbours inside the sample that the probed lists must hold.
TARGET = 0.96
TRIALS = 256
PART = 8192  # vectors of one part of a list, about
COLUMNS = 16
STRICT = 2.1  # the test abandons beyond so many standard errors of the estimate
RESOLUTION = 10_000_000


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def centers_of(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm; a center that loses all its vectors moves to a far one."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centers = distinct[rng.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        nearest, far = _assign(sample, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=lists)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        if not full.all():
            centers[~full] = sample[np.argsort(-far, kind="stable")[: int((~full).sum())]]
    return centers


def _assign(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nearest = np.empty(len(vectors), np.int64)
    far = np.empty(len(vectors))
    norms = (centers**2).sum(axis=1)
    step = max(1, (1 << 22) // max(len(centers), 1))
    for lo in range(0, len(vectors), step):
        part = vectors[lo : lo + step]
        distance = norms - 2 * part @ centers.T
        nearest[lo : lo + step] = distance.argmin(axis=1)
        far[lo : lo + step] = distance.min(axis=1) + (part**2).sum(axis=1)
    return nearest, far


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int, target: float) -> int:
    """Lists to probe so that sampled queries find ``target`` of their ``k`` nearest sampled
    vectors. In all data the nearest are nearer, so this errs to the safe side."""
    own, _ = _assign(sample, centers)
    asked = np.arange(0, len(sample), max(1, len(sample) // TRIALS))[:TRIALS]
    norms, squares = (centers**2).sum(axis=1), (sample**2).sum(axis=1)
    ranks = []
    for i in asked:
        distance = squares - 2 * sample @ sample[i]
        distance[i] = math.inf
        near = np.argpartition(distance, min(k, len(sample) - 1))[:k]
        place = np.empty(len(centers), np.int64)
        place[np.argsort(norms - 2 * centers @ sample[i], kind="stable")] = np.arange(len(centers))
        ranks.append(place[own[near]])
    found = np.sort(np.concatenate(ranks))
    return int(found[min(len(found) - 1, math.ceil(target * len(found)))]) + 1


def scan(
    query: np.ndarray, turned: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
    skip: int, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of ``vectors`` to ``query``: ids and exact distances, ties to the
    smaller id; of rows with one id the nearest counts. ``turned`` are the rotated vectors, ``own`` the rotated query."""
    size = turned.shape[1]
    kept: list[np.ndarray] = []
    limit = math.inf
    best, best_ids = np.zeros(0), ids[:0]
    lo, step = 0, 4 * k
    while lo < len(ids):
        alive = np.arange(lo, min(lo + step, len(ids)))
        alive = alive[ids[alive] != skip]
        partial = np.zeros(len(alive))
        for d in range(0, size, COLUMNS):
            block = turned[alive, d : d + COLUMNS] - own[d : d + COLUMNS]
            partial = partial + np.einsum("ij,ij->i", block, block)
            seen = min(d + COLUMNS, size)
            if math.isfinite(limit):
                slack = (1 + STRICT / math.sqrt(seen)) ** 2 if seen < size else 1 + 1e-9
                passed = partial * (size / seen) <= slack * limit
                alive, partial = alive[passed], partial[passed]
        kept.append(alive)
        if len(alive):
            best_ids, best = _nearest_ids(
                np.concatenate([best_ids, ids[alive]]), np.concatenate([best, partial]), k
            )
        if len(best) == k:
            limit = best[-1]
        lo, step = lo + step, 1024
    found = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    exact = np.sqrt(((vectors[found] - query) ** 2).sum(axis=1))
    return _nearest_ids(ids[found], exact, k)


def _nearest_ids(ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest ids, each with its nearest row; of equals the smaller ids."""
    order = np.lexsort((far, ids))
    ids, far = ids[order], far[order]
    first = np.ones(len(ids), bool)
    first[1:] = np.diff(ids) != 0
    ids, far = ids[first], far[first]
    order = np.lexsort((ids, far))[:k]
    return ids[order], far[order]


def _matrix(arrays: pa.Array, size: int) -> np.ndarray:
    return np.asarray(arrays.flatten(), dtype=float).reshape(-1, size)


BLOCK = "list int, part int, n int, ids binary, vectors binary"
VISIT = "list int, part int, query_id bigint, vector binary"
FOUND = "query_id bigint, vec_id bigint, score double"


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 10, target: float = TARGET,
    probes: int | None = None, lists: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries(vec_id, embedding)`` the ``k``
    nearest rows found in ``table(vec_id, embedding)``, other than the query's own id.

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor
    do rows without an id or vectors of another length than most. All candidates are
    returned if there are fewer than ``k``; a query visits more lists where its ``probes`` lists
    hold too few different ids. Without ``probes``, the sample tells how many reach ``target``.
    Of rows that repeat an id, the nearest counts (as a query: the smallest vector). Other columns
    are ignored. The number of lists is the square root of the rows, at most 4096.
    """
    spark = table.sparkSession
    steps = Steps(spark, "nearest")
    batch_rows(spark, 4096)

    def usable(df: DataFrame) -> DataFrame:
        value = F.col("embedding")
        good = (
            F.col("vec_id").isNotNull()
            & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
            & F.exists(value, lambda x: x != 0)
        )
        return df.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            value.cast("array<double>").alias("embedding"),
        ).filter(good)

    rows = usable(table)
    shape = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")
    ).first()
    if shape is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size, total = shape["size"], shape["count"]
    rows = rows.filter(F.size("embedding") == size)
    lists = min(lists or math.isqrt(total) + 1, MOST_LISTS, total)
    wanted = min(SAMPLE, PER_CENTER * lists)
    share = int(RESOLUTION * min(1.0, wanted / total)) + 1
    sample = (
        rows.filter(F.pmod(F.xxhash64(F.lit("centers"), "vec_id"), F.lit(RESOLUTION)) < share)
        .toArrow().sort_by("vec_id")
    )
    if not sample.num_rows:
        sample = rows.limit(lists).toArrow()
    fitted = _matrix(sample.column("embedding").combine_chunks(), size)
    centers = centers_of(fitted, lists)
    probes = probes or probes_for(fitted, centers, k, target)
    turn = rotation(size)
    shared = spark.sparkContext.broadcast((centers, turn))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            ids = np.asarray(column(batch, "vec_id"))
            vectors = _matrix(column(batch, "embedding"), size)
            if not len(ids):
                continue
            own = _assign(vectors, shared.value[0])[0]
            order = np.argsort(own, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own[order])) + 1, [len(own)]])
            spans = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(own[s[0]]) for s in spans], pa.int32()),
                    pa.array([int(ids[s[0]] & 0x7FFFFFFF) for s in spans], pa.int32()),
                    pa.array([len(s) for s in spans], pa.int32()),
                    pa.array([ids[s].tobytes() for s in spans], pa.binary()),
                    pa.array([vectors[s].tobytes() for s in spans], pa.binary()),
                ],
                [f.split()[0] for f in BLOCK.split(", ")],
            )

    blocks = steps.keep(rows.mapInArrow(index, BLOCK), "blocks")
    # At most MOST_LISTS rows: sizes of the lists, and into how many parts each is split.
    sizes = {r["list"]: r["n"] for r in blocks.groupBy("list").agg(F.sum("n").alias("n")).collect()}
    counts = np.array([sizes.get(i, 0) for i in range(len(centers))])
    # So many rows hold k + 1 different ids for certain.
    repeats = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    needed = (k + 1) * repeats
    parts = np.maximum(1, -(-counts // PART))
    layout = spark.sparkContext.broadcast((counts, parts))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = layout.value
        norms = (shared.value[0] ** 2).sum(axis=1)
        for batch in batches:
            out: list[tuple] = []
            ids = np.asarray(column(batch, "vec_id"))
            vectors = _matrix(column(batch, "embedding"), size)
            for query, vector in zip(ids, vectors):
                order = np.argsort(norms - 2 * shared.value[0] @ vector, kind="stable")
                order = order[counts[order] > 0]
                enough = int(np.searchsorted(np.cumsum(counts[order]), needed)) + 1
                for at in order[: max(probes, enough)]:
                    out += [(int(at), p, int(query), vector.tobytes()) for p in range(parts[at])]
            values = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, kinds)],
                [f.split()[0] for f in VISIT.split(", ")],
            )

    def probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(left.column("ids").to_pylist()), np.int64)
        vectors = np.frombuffer(b"".join(left.column("vectors").to_pylist())).reshape(-1, size)
        turn = shared.value[1]
        turned = vectors @ turn
        out: list[list] = [[], [], []]
        if len(ids):
            for query, raw in zip(
                right.column("query_id").to_pylist(), right.column("vector").to_pylist()
            ):
                vector = np.frombuffer(raw)
                near, far = scan(vector, turned, vector @ turn, vectors, ids, query, k)
                out[0] += [query] * len(near)
                out[1] += near.tolist()
                out[2] += far.tolist()
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    asked = (
        usable(queries).filter(F.size("embedding") == size)
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )
    split = F.create_map(*[F.lit(x) for i in np.flatnonzero(parts > 1) for x in (int(i), int(parts[i]))])
    of = F.coalesce(split[F.col("list")], F.lit(1)) if (parts > 1).any() else F.lit(1)
    placed = blocks.withColumn("part", F.pmod(F.hash("part"), of))
    hits = (
        placed.groupBy("list", "part")
        .cogroup(asked.mapInArrow(visits, VISIT).groupBy("list", "part"))
        .applyInArrow(probe, FOUND)
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
