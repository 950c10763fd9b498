import numpy as np
import pytest

from panelloom.operators import clusters, mixture


def em(points, start, rounds):
    """Plain EM from a mixture, without Spark."""
    trail = []
    for _ in range(rounds):
        shares, likelihood = mixture.responsibilities(start, points)
        trail.append(likelihood.mean())
        count = shares.sum(axis=0)
        means = shares.T @ points / count[:, None]
        covariances = []
        for j in range(len(count)):
            gap = points - means[j]
            covariances.append((gap * shares[:, j, None]).T @ gap / count[j] + mixture.RIDGE * np.eye(points.shape[1]))
        start = mixture.Mixture(count / count.sum(), means, np.array(covariances))
    return start, trail


def table(spark, points, parts=3):
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(parts)


def blobs(seed=1, n=120):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, s, (n, 3)) for c, s in (((0, 0, 0), 0.5), ((4, 0, 1), 1.0), ((0, 6, 0), 0.3))])


def test_equals_plain_em_and_never_falls(spark):
    points = blobs()
    df = table(spark, points)
    first = mixture.fit_mixture(df, 3, rounds=1, tolerance=-1)
    later = mixture.fit_mixture(df, 3, rounds=9, tolerance=-1)
    want, trail = em(points, first, 8)
    for a, b in ((later.weights, want.weights), (later.means, want.means), (later.covariances, want.covariances)):
        assert np.abs(a - b).max() < 1e-6
    assert np.abs(np.array(later.trail[1:]) - trail).max() < 1e-6
    assert (np.diff(later.trail) > -1e-9).all()


@pytest.mark.parametrize("parts", [1, 8])
def test_singular_and_repeated_columns(spark, parts):
    points = blobs()
    points = np.column_stack([points, points[:, 0], np.zeros(len(points)), points[:, 1] * 2])
    points = np.concatenate([points, np.repeat(points[:1], 50, axis=0)])
    found = clusters.cluster_gmm(table(spark, points, parts), 3).toPandas().sort_values("id")
    own = found["cluster_id"].to_numpy()
    for lo in range(0, 360, 120):
        assert np.bincount(own[lo : lo + 120]).max() > 110
    assert len(set(own)) == 3


def test_rows_without_vector_and_too_few(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None), (4, [9.0])], "id bigint, vector array<double>")
    found = {r["id"]: r["cluster_id"] for r in clusters.cluster_gmm(df, 2).collect()}
    assert found[3] is None and found[1] == found[2] != found[4]
    with pytest.raises(ValueError):
        clusters.cluster_gmm(df, 3)


@pytest.mark.parametrize("parts", [1, 4])
def test_embeddings(spark, parts):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    df = df.selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vector").repartition(parts)
    fitted = mixture.fit_mixture(df, 5)
    assert (np.diff(fitted.trail) > -1e-6).all() and fitted.weights.min() > 0
    assert mixture.assign(df, fitted).filter("cluster_id between 0 and 4").count() == df.count()
