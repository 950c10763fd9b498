"""K-means whose restarts share their passes, against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import clusters, kmeans


def blobs(spark, n=240, parts=5):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 0.2 + [5 * (i % 4), 0, i % 2]).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(parts)


def test_restarts_and_ks_share_passes(spark, monkeypatch):
    rows, df = blobs(spark)
    passes, plain = [], kmeans._totals
    monkeypatch.setattr(kmeans, "_totals", lambda *a: passes.append(1) or plain(*a))
    assigned, curve = clusters.cluster_scan(df, (2, 3, 4, 5), restarts=6)
    assert len(passes) <= kmeans.ROUNDS + 2
    curve = {r["k"]: r for r in curve.collect()}
    assert sorted(curve) == [2, 3, 4, 5] and max(curve.values(), key=lambda r: r["silhouette"])["k"] == 4
    found = {r["id"]: r["cluster_id"] for r in assigned.collect()}
    points, label = np.array([v for _, v in rows]), np.array([found[i] for i, _ in rows])
    assert len(set(zip(label, np.arange(240) % 4))) == 4
    cost = sum(((points[label == c] - points[label == c].mean(axis=0)) ** 2).sum() for c in range(4))
    assert curve[4]["inertia"] == pytest.approx(cost)
    judged = clusters.silhouette(df.join(assigned, "id")).first()[0]
    assert curve[4]["silhouette"] == pytest.approx(judged)


def test_rows_without_vector_and_few_distinct_points(spark):
    df = spark.createDataFrame(
        [(i, [float(i % 2), 1.0]) for i in range(20)] + [(99, None)], "id bigint, vector array<double>"
    )
    assigned, curve = clusters.cluster_scan(df, (3,), restarts=2)
    found = {r["id"]: r["cluster_id"] for r in assigned.collect()}
    assert found[99] is None and found[0] != found[1] and len(found) == 21
    assert curve.first()["silhouette"] == pytest.approx(1.0) and curve.first()["inertia"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        clusters.cluster_scan(df.withColumn("vector", F.array(F.lit(1.0))), (2,), 2)
    with pytest.raises(Exception, match="finite"):
        clusters.cluster_scan(df.withColumn("vector", F.array(F.lit(float("nan")))), (2,), 2)
