"""K-means for several numbers of clusters and many restarts in the same passes over stored points.

A pass measures every point against the centers of all fits with one product of matrices; every
task adds up its points per center, and Spark sums these cell by cell, so the driver only sees the
totals of the centers. Starts are drawn as in k-means||: each of two passes draws ``2 k`` points by
their squared distance to what is drawn already, the candidates are weighed by the points next to
them, and k-means++ on the weighed candidates picks ``k``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.ranking import top_rows

ROUNDS, TOLERANCE = 20, 1e-4  # of MLlib
STEPS = 2
GAP_CELLS = 1 << 20  # gaps held at once


@dataclass(frozen=True)
class Fit:
    k: int
    centers: np.ndarray
    cost: float
    silhouette: float | None = None


def points_in(batch: pa.RecordBatch, centers: Sequence[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """First row, points and the squared gaps to each fit's centers, for stretches of a batch."""
    size = centers[0].shape[1]
    x = np.asarray(batch.column(batch.schema.get_field_index("vector")).flatten(), dtype=float).reshape(-1, size)
    if not np.isfinite(x).all():
        raise ValueError("vectors must be finite")
    every = np.concatenate(centers)
    cuts = np.cumsum([len(c) for c in centers])[:-1]
    norms, step = (every * every).sum(axis=1), max(1, GAP_CELLS // max(every.shape))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        gaps = (part * part).sum(axis=1)[:, None] + norms - 2.0 * (part @ every.T)
        yield lo, part, np.split(np.maximum(gaps, 0.0), cuts, axis=1)


def _totals(points: DataFrame, centers: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per fit and center: points, their summed gaps and squared lengths, and their sum."""
    size, every = centers[0].shape[1], sum(len(c) for c in centers)
    first = np.cumsum([0, *[len(c) for c in centers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((every, 3 + size))
        for batch in batches:
            for _, x, gaps in points_in(batch, centers):
                at = np.stack([g.argmin(axis=1) for g in gaps], axis=1) + first[:-1]
                marks = np.zeros((len(x), every))
                np.put_along_axis(marks, at, 1.0, axis=1)
                cells[:, 0] += marks.sum(axis=0)
                near = np.stack([g.min(axis=1) for g in gaps], axis=1)
                cells[:, 1] += np.bincount(at.ravel(), near.ravel(), every)
                cells[:, 2] += marks.T @ (x * x).sum(axis=1)
                cells[:, 3:] += marks.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(every, dtype=np.int32)), pa.array(list(cells), pa.list_(pa.float64()))],
            ["center", "cells"],
        )

    found = (
        points.mapInArrow(run, "center int, cells array<double>")
        .select("center", F.posexplode("cells").alias("pos", "value"))
        .groupBy("center", "pos").agg(F.sum("value").alias("value")).toArrow()
    )
    cells = np.zeros((every, 3 + size))
    cells[np.asarray(found.column("center")), np.asarray(found.column("pos"))] = np.asarray(found.column("value"))
    return np.split(cells, first[1:-1])


def _drawn(points: DataFrame, centers: Sequence[np.ndarray], seeds: Sequence[int], wanted: Sequence[int]) -> list[np.ndarray]:
    """Points per fit, ``wanted`` of them, drawn without replacement by their gap to the nearest center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, centers[0].shape[1]))) for _ in centers]
        for batch in batches:
            u = np.asarray(batch.column(batch.schema.get_field_index("u")))
            for lo, x, gaps in points_in(batch, centers):
                for i, g in enumerate(gaps):
                    near = g.min(axis=1)
                    near[near < 1e-12 * (x * x).sum(axis=1)] = 0.0  # a copy of a center, but for rounding
                    # The least of exponential times of these rates are such a draw.
                    own = np.random.default_rng(seeds[i]).integers(1 << 63, dtype=np.uint64)
                    mixed = (u[lo : lo + len(x)].view(np.uint64) ^ own) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    draw = ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                    time = np.full(len(x), np.inf)
                    np.divide(-np.log(draw), near, out=time, where=near > 0)
                    take = np.argsort(time, kind="stable")[: wanted[i]]
                    take = take[np.isfinite(time[take])]
                    times, rows = np.concatenate([best[i][0], time[take]]), np.concatenate([best[i][1], x[take]])
                    keep = np.argsort(times, kind="stable")[: wanted[i]]
                    best[i] = times[keep], rows[keep]
        for i, (times, rows) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(times), i, np.int32)), pa.array(times), pa.array(list(rows), pa.list_(pa.float64()))],
                ["fit", "time", "vector"],
            )

    rows = points.mapInArrow(run, "fit int, time double, vector array<double>")
    found: list[list] = [[] for _ in centers]
    for row in top_rows(rows, ["fit"], [F.col("time"), F.col("vector")], max(wanted)).collect():
        if row["rank"] <= wanted[row["fit"]]:
            found[row["fit"]].append(row["vector"])
    return [np.array(v).reshape(-1, c.shape[1]) for v, c in zip(found, centers)]


def _picked(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centers of the weighed candidates (all, if fewer): k-means++ and some rounds."""
    rng = np.random.default_rng(seed)
    candidates, weights = candidates[weights > 0], weights[weights > 0]
    chosen = candidates[rng.choice(len(candidates), p=weights / weights.sum())][None]
    while len(chosen) < min(k, len(candidates)):
        mass = weights * ((candidates[:, None] - chosen[None]) ** 2).sum(axis=2).min(axis=1)
        if mass.sum() <= 0:
            break
        chosen = np.vstack([chosen, candidates[rng.choice(len(candidates), p=mass / mass.sum())]])
    for _ in range(30):
        near = ((candidates[:, None] - chosen[None]) ** 2).sum(axis=2).argmin(axis=1)
        held = np.bincount(near, weights, len(chosen))
        moved = chosen.copy()
        for j in np.flatnonzero(held):
            moved[j] = np.average(candidates[near == j], axis=0, weights=weights[near == j])
        if (moved == chosen).all():
            break
        chosen = moved
    return chosen


def _starts(points: DataFrame, ks: Sequence[int], seeds: Sequence[int]) -> list[np.ndarray]:
    first = points.orderBy("u", "vector").limit(len(ks)).select("vector").collect()
    centers = [np.array([first[i % len(first)]["vector"]], dtype=float) for i in range(len(ks))]
    for step in range(STEPS):
        more = _drawn(points, centers, [1_000_003 * (step + 1) + s for s in seeds], [2 * k for k in ks])
        centers = [np.vstack([c, m]) for c, m in zip(centers, more)]
    weights = [cells[:, 0] for cells in _totals(points, centers)]
    return [_picked(*parts) for parts in zip(centers, weights, ks, seeds)]


def fit_all(points: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> list[Fit]:
    """The fit with the lowest cost of ``restarts`` for every k, with its silhouette on squared distances.

    ``points(vector, u)`` is a stored table, ``u`` a hash of the row.
    """
    labels = [(k, seed + r) for k in ks for r in range(restarts)]
    centers = _starts(points, [k for k, _ in labels], [s for _, s in labels])
    moving = list(range(len(labels)))
    for _ in range(ROUNDS):
        cells = _totals(points, [centers[i] for i in moving])
        left = []
        for i, own in zip(moving, cells):
            held = own[:, 0] > 0
            moved = centers[i].copy()
            moved[held] = own[held, 3:] / own[held, :1]
            if (((moved - centers[i]) ** 2).sum(axis=1) > TOLERANCE**2).any():
                left.append(i)
            centers[i] = moved
        moving = left
        if not moving:
            break
    last = _totals(points, centers)
    costs = [float(own[:, 1].sum()) for own in last]
    best = []
    for start in range(0, len(labels), restarts):
        best.append(min(range(start, start + restarts), key=lambda i: costs[i]))
    scores = _silhouettes(points, [centers[i] for i in best], [last[i] for i in best])
    return [Fit(labels[i][0], centers[i], costs[i], score) for i, score in zip(best, scores)]


def _silhouettes(points: DataFrame, centers: list[np.ndarray], cells: list[np.ndarray]) -> list[float]:
    """Mean silhouettes on squared distances, out of count, sum and squared lengths per cluster."""
    if any((own[:, 0] > 0).sum() < 2 for own in cells):
        raise ValueError("the points fall into one cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(centers)), 0
        for batch in batches:
            for _, x, gaps in points_in(batch, centers):
                n += len(x)
                lengths, rows = (x * x).sum(axis=1), np.arange(len(x))
                for i, (g, own) in enumerate(zip(gaps, cells)):
                    count, near = own[:, 0], g.argmin(axis=1)
                    held = np.maximum(count, 1)
                    mean = lengths[:, None] + own[:, 2] / held - 2.0 * (x @ (own[:, 3:] / held[:, None]).T)
                    mean = np.maximum(mean, 0.0)
                    inner = mean[rows, near] * count[near] / np.maximum(count[near] - 1, 1)
                    mean[:, count == 0] = np.inf
                    mean[rows, near] = np.inf
                    outer = mean.min(axis=1)
                    most = np.maximum(inner, outer)
                    value = np.divide(outer - inner, most, out=np.zeros(len(x)), where=most > 0)
                    total[i] += value[count[near] > 1].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))],
            ["fit", "total", "n"],
        )

    rows = points.mapInArrow(run, "fit int, total double, n bigint").groupBy("fit").agg(
        (F.sum("total") / F.sum("n")).alias("score")
    ).collect()
    scores = {r["fit"]: float(r["score"]) for r in rows}
    return [scores[i] for i in range(len(centers))]


def assigner(centers: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [gaps[0].argmin(axis=1).astype(np.int32) for _, _, gaps in points_in(batch, [centers])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))],
                ["id", "cluster_id"],
            )

    return run
