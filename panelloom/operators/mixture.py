"""Gaussian mixtures by expectation maximization over stored points.

A round is one pass: every task weighs its points under the current components and adds up
``r``, ``r x`` and ``r x xT``; Spark sums these cell by cell, so the driver only sees the totals
of each component. Covariances are symmetric by construction and get a small ridge, so
repeated columns, single points and any partitioning are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import materialize

RIDGE = 1e-6
TOLERANCE = 1e-4  # least gain of the mean log-likelihood per round
ROUNDS = 200


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    #: Mean log-likelihood before each round.
    trail: list[float] = field(default_factory=list)

    def joint(self, points: np.ndarray) -> np.ndarray:
        """Log of weight times density, point by component."""
        out = np.empty((len(points), len(self.weights)))
        for j, (weight, mean, covariance) in enumerate(zip(self.weights, self.means, self.covariances)):
            lower = _cholesky(covariance)
            z = np.linalg.solve(lower, (points - mean).T)
            half = np.log(np.diag(lower)).sum() + 0.5 * len(mean) * np.log(2 * np.pi)
            out[:, j] = np.log(weight) - half - 0.5 * (z**2).sum(axis=0)
        return out


def _cholesky(covariance: np.ndarray) -> np.ndarray:
    """Lower factor; rounding may need more than the ridge that is in already."""
    ridge = 0.0
    while True:
        try:
            return np.linalg.cholesky(covariance + ridge * np.eye(len(covariance)))
        except np.linalg.LinAlgError:
            ridge = max(10 * ridge, RIDGE)


def responsibilities(mixture: Mixture, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each component in each point, and the points' log-likelihoods."""
    joint = mixture.joint(points)
    top = joint.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
    return np.exp(joint - total[:, None]), total


def from_sums(count: np.ndarray, first: np.ndarray, second: np.ndarray, shift: np.ndarray) -> Mixture:
    """The mixture that fits sums of ``r``, ``r x``, ``r x xT`` of points moved by ``-shift`` best."""
    held = np.maximum(count, 1e-12)
    means = first / held[:, None]
    covariances = second / held[:, None, None] - means[:, :, None] * means[:, None, :]
    covariances = (covariances + covariances.transpose(0, 2, 1)) / 2
    covariances += RIDGE * np.eye(first.shape[1])
    return Mixture(held / held.sum(), means + shift, covariances)


def _points_in(batch: pa.RecordBatch, size: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("vector")).flatten()
    return np.asarray(values, dtype=float).reshape(-1, size)


def _sums(points: DataFrame, size: int, k: int, shift: np.ndarray, weigh) -> tuple[np.ndarray, ...]:
    """Totals over all points under ``weigh(points, batch) -> (shares, log-likelihoods)``."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((k, 2 + size + len(upper[0])))
        for batch in batches:
            x = _points_in(batch, size)
            shares, likelihood = weigh(x, batch)
            moved = x - shift
            cells[:, 0] += shares.sum(axis=0)
            cells[0, 1] += likelihood.sum()
            cells[:, 2 : 2 + size] += shares.T @ moved
            for j in range(k):
                cells[j, 2 + size :] += ((moved * shares[:, j, None]).T @ moved)[upper]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(list(cells), pa.list_(pa.float64()))],
            ["component", "cells"],
        )

    found = (
        points.mapInArrow(run, "component int, cells array<double>")
        .select("component", F.posexplode("cells").alias("pos", "value"))
        .groupBy("component", "pos").agg(F.sum("value").alias("value")).toArrow()
    )
    cells = np.zeros((k, 2 + size + len(upper[0])))
    cells[np.asarray(found.column("component")), np.asarray(found.column("pos"))] = np.asarray(found.column("value"))
    second = np.zeros((k, size, size))
    second[:, upper[0], upper[1]] = cells[:, 2 + size :]
    second[:, upper[1], upper[0]] = cells[:, 2 + size :]
    return cells[:, 0], cells[:, 2 : 2 + size], second, cells[0, 1]


def fit_mixture(
    df: DataFrame, k: int, seed: int = 42, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> Mixture:
    """Fit ``k`` components to ``df(vector)``, from a K-means start, until a round gains less than
    ``tolerance`` in mean log-likelihood. Rows without a vector take no part."""
    points = materialize(df.select("vector").filter("vector is not null"), "mixture")
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    n, size = shape["n"], shape["size"]
    if n <= k:
        raise ValueError(f"cannot fit {k} components on {n} rows")
    middle = points.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(
        F.avg("x").alias("x")
    ).orderBy("pos").toArrow()
    shift = np.asarray(middle.column("x"))
    start = KMeans(k=k, seed=seed, predictionCol="cluster_id").fit(
        points.select(array_to_vector("vector").alias("features"))
    )
    centers = np.array(sorted(c.tolist() for c in start.clusterCenters()))

    def hard(x: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        gaps = (centers**2).sum(axis=1) - 2 * x @ centers.T
        return np.eye(len(centers))[gaps.argmin(axis=1)], np.zeros(len(x))

    count, first, second, _ = _sums(points, size, len(centers), shift, hard)
    mixture = from_sums(count, first, second, shift)
    trail: list[float] = []
    for _ in range(rounds):
        current = mixture

        def soft(x: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return responsibilities(current, x)

        count, first, second, likelihood = _sums(points, size, len(centers), shift, soft)
        mixture = from_sums(count, first, second, shift)
        trail.append(float(likelihood / n))
        if len(trail) > 1 and trail[-1] - trail[-2] < tolerance:
            break
    return Mixture(mixture.weights, mixture.means, mixture.covariances, trail)


def assign(df: DataFrame, mixture: Mixture) -> DataFrame:
    """``id, cluster_id``: the component with the largest share; null without a vector."""
    size = mixture.means.shape[1]
    id_type = dict(df.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = mixture.joint(_points_in(batch, size)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best.astype(np.int32))], ["id", "cluster_id"]
            )

    rows = df.select("id", "vector")
    named = rows.filter("vector is not null").mapInArrow(run, f"id {id_type}, cluster_id int")
    blank = rows.filter("vector is null").select("id", F.lit(None).cast("int").alias("cluster_id"))
    return named.unionByName(blank)
