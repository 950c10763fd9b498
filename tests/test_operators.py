import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import calibrate as cal
from panelloom.operators import clusters, eda, features, neighbours, quality, sampling, stats
from panelloom.operators import distributions as dist
from panelloom.plans import jobs
from panelloom.sources import landings, panel, store

LIKERT = ["Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree"]


@pytest.fixture(scope="module")
def likert(spark):
    return spark.createDataFrame([("q", LIKERT)], "question_id string, options array<string>")


def pairs_of(spark, p, q, name="q"):
    rows = [(name, i, f"o{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(p, q))]
    return spark.createDataFrame(rows, "question_id string, option_idx int, option string, p double, q double")


def test_divergences_of_known_vectors(spark):
    same = dist.divergences(pairs_of(spark, [1, 2, 3], [2, 4, 6])).first()
    assert same["js"] == pytest.approx(0, abs=1e-12) and same["wasserstein"] == pytest.approx(0, abs=1e-12)
    apart = dist.divergences(pairs_of(spark, [1, 0, 0], [0, 0, 1])).first()
    assert apart["js"] == pytest.approx(1.0) and apart["wasserstein"] == pytest.approx(2.0)
    assert apart["entropy"] == 0.0 and apart["cosine"] == 0.0


def test_support_changes_the_distance(spark):
    pairs = pairs_of(spark, [1, 0, 0], [0, 0, 1]).withColumn("at", F.pow(F.lit(10.0), "option_idx"))
    assert dist.divergences(pairs, support="at").first()["wasserstein"] == pytest.approx(99.0)


def test_massless_side_is_null_or_an_error(spark):
    pairs = pairs_of(spark, [0, 0], [1, 1])
    assert dist.divergences(pairs).first()["wasserstein"] is None
    with pytest.raises(Exception, match="zero mass"):
        dist.divergences(pairs, strict=True).collect()


def test_weights_shift_the_distribution_and_unmatched_groups_stay(spark, likert):
    rows = [("q", "Agree", 3.0, "18-24"), ("q", "disagree", 1.0, "18-24"), ("q", "Agree", 0.0, "65+"),
            ("q", "no idea", 1.0, "25-34"), ("q", "agree", None, "")]
    df = spark.createDataFrame(rows, "question_id string, answer string, expansion_factor double, age_group string")
    mass = {r["option"]: r["mass"] for r in dist.weighted_distribution(df, likert).collect()}
    assert mass["Agree"] == pytest.approx(5 / 6, abs=1e-5)
    groups = {}
    for r in dist.group_distributions(df, likert).collect():
        groups.setdefault(r["group"], {})[r["option"]] = r["mass"]
    assert set(groups) == {"18-24", "65+", "25-34"}
    assert groups["25-34"]["Neutral"] == pytest.approx(0.2)
    assert groups["18-24"]["Agree"] == pytest.approx(0.75, abs=1e-5)


def test_empirical_target_is_uniform_without_history(spark, likert):
    empty = spark.createDataFrame([], "question_id string, answer string, response_id string")
    assert [r["mass"] for r in dist.empirical_target(empty, likert).collect()] == pytest.approx([0.2] * 5)


def chi_tables(spark, cells):
    rows = [("q", "age_group", g, o, n) for (g, o), n in cells.items()]
    return spark.createDataFrame(rows, "question_id string, dimension string, group string, option string, n bigint")


def test_two_by_two_is_corrected(spark):
    cells = {("a", "x"): 30, ("a", "y"): 10, ("b", "x"): 20, ("b", "y"): 40, ("b", "z"): 0}
    row = stats.chi_square_breakdown(chi_tables(spark, cells)).first()
    n, e = 100, {("a", "x"): 20, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 30}
    want = sum((abs(cells[k] - e[k]) - 0.5) ** 2 / e[k] for k in e)
    assert n == 100 and row["dof"] == 1 and row["chi2"] == pytest.approx(want, abs=1e-4)
    assert row["testable"] and row["significant"]


def test_sparse_and_degenerate_tables(spark):
    sparse = stats.chi_square_breakdown(chi_tables(spark, {("a", "x"): 2, ("b", "y"): 2, ("a", "y"): 1, ("b", "x"): 0})).first()
    assert not sparse["testable"] and sparse["significant"] is None and sparse["chi2"] is not None
    flat = stats.chi_square_breakdown(chi_tables(spark, {("a", "x"): 9, ("b", "x"): 9})).first()
    assert not flat["testable"] and flat["chi2"] is None and flat["reason"] == "degenerate table"


def test_raking_hits_margins_with_mean_one(spark):
    rows = [("young" if i < 70 else "old", "north" if i % 2 else "south") for i in range(100)] + [("other", "north")] * 5
    df = spark.createDataFrame(rows, "age string, region string")
    out = stats.rake(df, {"age": {"young": 0.45, "old": 0.5}, "region": {"north": 0.5, "south": 0.5}})
    assert out.count() == 105
    assert out.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    by = {r["region"]: r["w"] for r in out.groupBy("region").agg((F.sum("weight") / 105).alias("w")).collect()}
    assert by["north"] == pytest.approx(0.5, abs=1e-3)


def test_raking_in_one_task_and_spread_agree(spark):
    rng = np.random.default_rng(9)
    rows = [tuple(f"l{x}" for x in rng.integers(0, 4, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    margins = {c: {f"l{i}": w for i, w in enumerate(s)} for c, s in (
        ("a", (0.1, 0.2, 0.3, 0.4)), ("b", (0.4, 0.3, 0.2, 0.1)), ("c", (0.25, 0.25, 0.5)))}
    both = [
        {tuple(r)[:3]: r["weight"] for r in stats.rake(df, margins, passes=30, task_cells=n).distinct().collect()}
        for n in (1000, 3)
    ]
    assert both[0].keys() == both[1].keys()
    assert all(both[0][k] == pytest.approx(both[1][k]) for k in both[0])
    assert sum(both[0][r] for r in rows if r[0] == "l3") / 400 == pytest.approx(0.4, abs=0.01)
    assert stats.rake(df.limit(0), margins).count() == 0


def month_rows(spark, months, late):
    rows = []
    for m in range(months):
        share = late if m == months - 1 else 50
        rows += [(f"m{m:02d}", "a" if i < share else "b") for i in range(100)]
    return spark.createDataFrame(rows, "month string, cat string")


def test_drift_baselines_and_trigger(spark):
    df = month_rows(spark, 12, 90)
    pooled = stats.drift_pooled(df, "month", "cat").orderBy("period").collect()
    assert len(pooled) == 9 and pooled[-1]["divergence"] > 10 * max(r["divergence"] for r in pooled[:-1])
    series = stats.drift_summed(df, "month", "cat")
    quiet = stats.drift_decision(series, 3.0).first()
    assert not quiet["fired"]  # one period among nine cannot exceed mean + 3 sigma
    clean = series.filter("period < 'm11'")
    fired = stats.drift_decision(series, 3.0, reference=clean).first()
    assert (fired["fired"], fired["fired_period"], fired["rule"]) == (True, "m11", "hard")


def test_consecutive_rule(spark):
    rows = [(f"p{i}", v) for i, v in enumerate([1.0, 5.0, 1.0, 5.0, 5.0, 1.0])]
    series = spark.createDataFrame(rows, "period string, divergence double")
    reference = spark.createDataFrame([("r", 3.0)], "period string, divergence double")
    out = stats.drift_decision(series, 0.0, reference=reference).first()
    assert (out["fired_period"], out["rule"], out["breaches"]) == ("p4", "consecutive", 3)


def test_calibration_is_the_blend_and_plans_meet_both_margins(spark):
    pairs = pairs_of(spark, [0.5, 0.3, 0.2], [0.2, 0.3, 0.5])
    blended = {r["option_idx"]: r["mass"] for r in cal.calibrate(pairs).collect()}
    assert blended == pytest.approx({0: 0.29, 1: 0.3, 2: 0.41})
    plans = cal.transport_plans(pairs, cal.cost_cells(pairs), [0.05, 1.0]).collect()
    for eps in (0.05, 1.0):
        cells = [r for r in plans if r["epsilon"] == eps]
        assert cells[0]["converged"]
        for idx, want in enumerate([0.5, 0.3, 0.2]):
            assert sum(r["mass"] for r in cells if r["i"] == idx) == pytest.approx(want, abs=1e-5)
        for idx, want in enumerate([0.2, 0.3, 0.5]):
            assert sum(r["mass"] for r in cells if r["j"] == idx) == pytest.approx(want, abs=1e-9)
        history = cells[0]["history"]
        assert len(history) == cells[0]["iterations"] and history[-1] <= history[0]


def test_fairness_tolerance(spark):
    overall = spark.createDataFrame([("q", i, 0.25) for i in range(4)], "question_id string, option_idx int, mass double")
    groups = spark.createDataFrame(
        [("q", "far", i, m) for i, m in enumerate([1.0, 0.0, 0.0, 0.0])]
        + [("q", "near", i, 0.25) for i in range(4)],
        "question_id string, group string, option_idx int, mass double",
    )
    gaps = {r["group"]: r for r in cal.parity_gaps(cal.fairness_repair(groups, overall, 0.2, 0.1)).collect()}
    assert gaps["far"]["gap_before"] == 0.75 and gaps["far"]["gap_after"] == pytest.approx(0.6)
    assert gaps["near"]["gap_after"] == 0.0


def test_stratified_sample_sizes(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 990, "big").otherwise("small").alias("s"))
    for n in (1, 7, 100, 999, 5000):
        picked = sampling.stratified_sample(df, n, "s", "id")
        assert picked.count() == min(n, 1000) == picked.select("id").distinct().count()
    assert sampling.stratified_sample(df, 100, "s", "id").filter("s = 'small'").count() == 1
    again = {r["id"] for r in sampling.stratified_sample(df.repartition(3), 100, "s", "id").collect()}
    assert again == {r["id"] for r in sampling.stratified_sample(df, 100, "s", "id").collect()}


def test_histogram_of_a_constant_column(spark):
    out = eda.histogram(spark.createDataFrame([(3,), (3,)], "x int"), "x", 4).collect()
    assert [r["count"] for r in sorted(out)] == [0, 0, 2, 0]


def test_rfm_scores_equal_rank_cuts(spark):
    df = spark.range(11).select(
        F.lpad(F.col("id").cast("string"), 2, "0").alias("panelist_id"), F.lit(5).alias("recency_days"),
        F.col("id").alias("frequency"), F.lit(1.0).alias("monetary"),
    )
    scores = {int(r["panelist_id"]): r["frequency_score"] for r in eda.rfm_scores(df).collect()}
    assert scores == {i: max(1, math.ceil(5 * i / 10)) for i in range(11)}


def test_quality_gate_passes_and_fails(spark):
    df = spark.createDataFrame(
        [("a", "18-24", 1.0, "2026-01-01"), ("b", "25-34", 2.0, "2026-01-02"), ("c", "18-24", 3.0, "2026-01-03")],
        "panelist_id string, age_group string, spend double, seen_at string",
    )

    def checks(frame):
        return [
            quality.null_rate(frame), quality.unique_key("panelist_id"), quality.value_range("spend", 0, 10),
            quality.distribution_balance("age_group"), quality.referential("panelist_id", df, "panelist_id"),
            quality.freshness("seen_at", "2026-01-31"), quality.row_count_delta(0),
            quality.required_columns(frame, ["panelist_id"]),
        ]

    good = quality.gate(quality.run_checks(df, checks(df))).first()
    assert good["passed"] == 8 and good["ok"]
    twice = df.unionByName(df)
    bad = quality.gate(quality.run_checks(twice, checks(twice))).first()
    assert bad["failures"] == 1 and not bad["ok"]


def test_row_contract_tolerance(spark):
    rows = [("p", "2026-01-01", "c", "1", "1.0", "1.0")] * 19 + [("p", "2026-01-01", "c", "0", "1.0", "1.0")]
    df = spark.createDataFrame(rows, "panelist_id string, transaction_date string, product_category string, quantity string, unit_price string, total_value string")
    checked = quality.validate_rows(df, "purchases")
    assert checked.valid.count() == 19 and checked.rejected.first()["error"] == "quantity"
    with pytest.raises(quality.QualityError, match="quantity"):
        quality.validate_rows(df.limit(1).unionByName(df.filter("quantity = 0")), "purchases")


def test_failed_gate_loads_nothing(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    loaded = []
    stages = jobs.Stages(lambda: df, checks=lambda d: [quality.unique_key("k")], load=loaded.append)
    record = jobs.run_job(spark, "demo", stages).first()
    assert record["state"] == "failed" and record["rows_loaded"] == 0 and not loaded
    dry = jobs.run_job(spark, "demo", jobs.Stages(lambda: df, load=loaded.append), dry_run=True).first()
    assert dry["state"] == "complete" and dry["rows_loaded"] == 0 and not loaded


def test_landings(spark, tmp_path):
    wave = spark.range(1200).select(
        F.col("id").alias("QKEY"), F.lit(1.0).alias("WEIGHT"),
        F.when(F.col("id") % 2 == 0, "18-29").otherwise("30+").alias("F_AGECAT"), F.lit("yes").alias("ATP_Q1"),
    )
    with pytest.raises(landings.LandingError):
        landings.land_pew(wave.limit(10), "119")
    with pytest.raises(landings.LandingError):
        landings.land_pew(wave.drop("QKEY"), "119")
    manifest = landings.write_landing(landings.land_pew(wave, "119"), str(tmp_path), "pew", "119", "u").first()
    assert manifest["row_count"] == 1200 and len(manifest["sha256"]) == 64 and manifest["file_size_bytes"] > 0
    rows = jobs.benchmark_frame(landings.read_benchmark(spark, str(tmp_path), "pew", "119"), "pew", "119").collect()
    assert {r["question_id"] for r in rows} == {"atp_q1"}  # lineage columns are no questions
    assert {(r["share"], r["sample_size"]) for r in rows} == {(1.0, 600)}
    ess = spark.createDataFrame([(1, "DE", 11, 5, "x"), (2, "FR", 11, 6, "y")], "idno int, cntry string, essround int, trstplc int, unrelated string")
    assert set(landings.land_ess(ess, "11").columns) == {"idno", "cntry", "trstplc", "source", "round_id", "ingested_at"}
    with pytest.raises(landings.LandingError, match="marker"):
        landings.land_ess(ess, "10")


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([("k1", 1, "a"), ("k2", 1, "b")], "k string, v int, x string")
    new = spark.createDataFrame([("k2", 2, "c"), ("k3", 2, "d")], "k string, v int, x string")
    assert {(r["k"], r["x"]) for r in panel.upsert(old, new, ["k"], "v").collect()} == {("k1", "a"), ("k2", "c"), ("k3", "d")}
    path = str(tmp_path / "vectors")
    store.save_embeddings(old, path, "v1")
    store.save_embeddings(new, path, "v2")
    assert store.load_embeddings(spark, path, "v1").count() == 2
    assert store.load_embeddings(spark, path, "stale").count() == 0
    with pytest.raises(ValueError):
        panel.scan_panelists(old, {"k; drop": 1}, strict=True)


def test_features_of_an_empty_household(spark):
    panelists = spark.createDataFrame([("a",), ("b",)], "panelist_id string")
    bought = spark.createDataFrame([("a", "c1", 1.0, 0.0, True)], "panelist_id string, product_category string, unit_price double, total_value double, is_promotion boolean")
    rows = {r["panelist_id"]: r for r in features.behavior_features(bought, panelists).collect()}
    assert rows["a"]["bin_budget"] == 1.0 and rows["a"]["cat_c1"] == 0.0
    assert rows["b"]["log_rows"] == 0.0 and rows["b"]["promo_rate"] == 0.0


def test_sequences_pad_cut_and_mark_unknown(spark):
    tokens = spark.createDataFrame([("a", "t1", 1), ("a", "t2", 2), ("a", "zz", 3), ("b", "t1", 1)], "panelist_id string, token string, at int")
    vocab = spark.createDataFrame([("t1", 2), ("t2", 3)], "token string, token_id int")
    out = {r["panelist_id"]: r["token_ids"] for r in features.encode_sequences(tokens, vocab, ["at"], 2).collect()}
    assert out == {"a": [3, 1], "b": [2, 0]}


def brute_force(points, k):
    out = {}
    for i, p in points.items():
        ranked = sorted((math.dist(p, q), j) for j, q in points.items() if j != i)
        out[i] = [j for _, j in ranked[:k]]
    return out


def test_knn_with_copies_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    points = {i: [round(float(x), 2) for x in rng.normal(size=3)] for i in range(80)}
    points.update({100 + i: [0.5, 0.5, 0.5] for i in range(40)})  # a third are copies
    df = spark.createDataFrame(list(points.items()), "id bigint, vector array<double>")
    got = {}
    for r in neighbours.knn(df, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor_id"])
    assert got == brute_force(points, 4)


def test_knn_ivf_recall_and_distance_limit(spark):
    rng = np.random.default_rng(4)
    points = {i: rng.normal(size=4).tolist() for i in range(1600)}
    df = spark.createDataFrame(list(points.items()), "id bigint, vector array<double>")
    near = neighbours.knn_ivf(df, 3, probes=10)
    want = {(r["id"], r["neighbor_id"]) for r in neighbours.knn(df, 3).collect()}
    got = {(r["id"], r["neighbor_id"]) for r in near.collect()}
    assert len(want & got) / len(want) > 0.9
    assert neighbours.knn(df, 3, max_distance=0.0).count() == 0


def test_clusters_of_separate_blobs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=2) * 0.1 + [4 * (i % 3), 0]).tolist()) for i in range(90)] + [(99, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    blobs = df.filter("id < 90")
    assigned, curve = clusters.cluster_scan(blobs, (2, 3), restarts=2)
    assert max(curve.collect(), key=lambda r: r["silhouette"])["k"] == 3
    assert assigned.select("cluster_id").distinct().count() == 3
    with pytest.raises(ValueError):
        clusters.cluster_scan(blobs.limit(2), (3,), 1)
    found = {r["id"]: r["cluster_id"] for r in clusters.cluster_dbscan(df, 0.5, 5).collect()}
    assert found[99] == -1
    for b in range(3):
        assert len({found[i] for i in range(90) if i % 3 == b}) == 1
    assert len({found[0], found[1], found[2]}) == 3


def test_file_version_changes_with_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = panel.file_version(spark, path).first()["data_version"]
    assert first == panel.file_version(spark, path).first()["data_version"] and len(first) == 16
    spark.range(1).write.mode("append").parquet(path)
    assert first != panel.file_version(spark, path).first()["data_version"]


def test_epsilon_only_moves_the_plan(spark):
    pairs = pairs_of(spark, [0.6, 0.3, 0.1], [0.1, 0.3, 0.6])
    sweep = cal.epsilon_sweep(cal.transport_plans(pairs, cal.cost_cells(pairs), [0.05, 1.0])).orderBy("epsilon").collect()
    assert sweep[0]["iterations"] > sweep[1]["iterations"]
    assert sweep[0]["plan_entropy"] < sweep[1]["plan_entropy"]


def test_samples_and_halves_with_one_dominant_key(spark):
    from panelloom.operators import sampling

    df = spark.range(2000).selectExpr("id", "if(id < 1800, 'big', concat('s', id % 4)) s")
    drawn = sampling.stratified_sample(df, 100, "s", "id").groupBy("s").count().collect()
    found = {r["s"]: r["count"] for r in drawn}
    assert sum(found.values()) == 100 and found["big"] == 90 and len(found) == 5
    assert sampling.sample_n(df, 700, "id").distinct().count() == 700
    views = sampling.midpoint_views(df, "s", ["id"]).groupBy("s", "view").count().collect()
    assert {(r["s"], r["view"]): r["count"] for r in views}[("big", 1)] == 900
    assert len(views) == 10


def test_cluster_queries_run_the_whole_job(spark, monkeypatch):
    import __spark_entry__ as registry

    scans, widths = [], []

    def scan(df, ks=(clusters.CLUSTERS,), restarts=clusters.RESTARTS, seed=clusters.SEED):
        scans.append((list(ks), restarts))
        return df.selectExpr("id", "0 AS cluster_id"), spark.createDataFrame(
            [(k, 0.0, 0.0) for k in ks], "k INT, inertia DOUBLE, silhouette DOUBLE"
        )

    def wide(df, *_):
        widths.append(len(df.first()["vector"]))
        return df.selectExpr("id", "0 AS cluster_id")

    monkeypatch.setattr(clusters, "cluster_scan", scan)
    monkeypatch.setattr(clusters, "cluster_gmm", wide)
    monkeypatch.setattr(clusters, "cluster_dbscan", wide)
    for name in ("m08_cluster_scan", "m12_embedding_sweep", "n14_embedding_job", "m10_gmm", "m11_dbscan"):
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert scans == [(list(range(2, 9)), 10), *[([5], 10)] * 6]
    assert widths == [64, 64]


def test_content_version_counts_repeated_rows(spark):
    def version(rows):
        df = spark.createDataFrame(rows, "a string, b int")
        return tuple(panel.content_version(df.repartition(3)).first())

    a, b = ("x", 1), ("y", None)
    assert version([a, a]) != version([b, b]) and version([a, b]) == version([b, a])
    assert version([a]) != version([a, a, a]) and version([("x", None)]) != version([("x-", None)])
    assert version([])[0] == 0
