"""Mixing and nearest neighbours, the registered queries, and what happens without the folder."""

import subprocess
import sys

import check
import numpy as np
import pytest

import __spark_entry__ as registry
from panelloom.llm import mixing, nearest, queries

from llm_helpers import SMALL, docs_of


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


def test_mixing_equals_sql(spark, duck):
    status, _, _, detail = check.compare(spark, duck, "op8_mixing", SMALL)
    assert status == "ok", detail


def test_budgets(spark):
    leaves = spark.createDataFrame(
        [("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "fr", "c", 1000), ("d1", "en", "d", 50)],
        "domain string, lang string, source string, tokens bigint",
    )
    found = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 0.5, 4).collect()}
    # Root 580: d1 is full at 200, d0 gets 380; en and fr 190 each; b is full at 40, a gets 150.
    assert found == {"a": 150, "b": 40, "c": 190, "d": 200}
    weighted = mixing.leaf_budgets(leaves, 0.5, 4, {"lang": {"fr": 3.0}}).collect()
    assert {r["source"]: r["budget"] for r in weighted} == {"a": 55, "b": 40, "c": 285, "d": 200}


def test_mixing_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x " * 3000), (3, "x " * 3000), (4, "y z")]
    docs = docs_of(spark, rows).withColumnRenamed("score", "tokens")
    taken = mixing.mix_sources(docs, fraction=1.0)
    assert taken.columns[-3:] == ["domain", "tokens", "epoch"] and taken.count() > 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    nameless = docs.selectExpr("doc_id", "text", "string(null) lang", "string(null) source", "n_chars")
    assert mixing.mix_sources(nameless).count() > 0


def brute(vectors, ids, query, k):
    far = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    order = np.lexsort((ids, far))
    order = order[ids[order] != ids[query]][:k]
    return ids[order], far[order]


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = nearest.nearest(table, table.filter("vec_id % 100 = 0")).toPandas()
    data = table.toPandas().sort_values("vec_id")
    vectors, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    hits = total = 0
    for query, own in rows.groupby("query_id"):
        own = own.sort_values("rank")
        want, _ = brute(vectors, ids, int(np.flatnonzero(ids == query)[0]), 10)
        hits += len(set(want) & set(own["vec_id"]))
        total += 10
        at = np.searchsorted(ids, own["vec_id"])
        base = vectors[np.searchsorted(ids, query)]
        assert np.allclose(own["score"], np.sqrt(((vectors[at] - base) ** 2).sum(axis=1)), rtol=1e-12)
        assert list(own["rank"]) == list(range(1, 11)) and own["score"].is_monotonic_increasing
    assert hits / total >= 0.9


def test_all_lists_probed_is_exact_with_copies(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[40:120] = vectors[40]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest.nearest(df, df.filter("vec_id % 10 = 0"), probes=1000).toPandas()
    ids = np.arange(300)
    for query, own in found.groupby("query_id"):
        want, far = brute(vectors, ids, query, 10)
        own = own.sort_values("rank")
        assert list(own["vec_id"]) == list(want) and np.allclose(own["score"], far)


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
        (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (None, [1.0, 2.0]), (8, [1.0, 1.0]),
        (8, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest.nearest(df, df).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [
        (0, 1, 6), (0, 2, 8), (6, 1, 8), (6, 2, 0), (8, 1, 6), (8, 2, 0)
    ]
    assert nearest.nearest(df.limit(0), df).count() == 0


def test_every_query_is_registered():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) <= set(registry.queries()) and set(queries.SQL) <= set(names)


def test_registry_without_the_folder():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('panelloom.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name.split('.queries')[0])\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
    )
    from pathlib import Path

    root = Path(registry.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_nearest_folds_repeated_ids(spark):
    """Many rows of one id near the query must not push other ids out."""
    rng = np.random.default_rng(4)
    query = [1.0, 0.0, 0.0, 0.0]
    rows = [(0, query)] + [(7, [1.0, 0.01 * i, 0.0, 0.0]) for i in range(1, 16)]
    rows += [(100 + i, rng.normal(size=4).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()
    far = {}
    for i, v in rows[1:]:
        far[i] = min(far.get(i, 9e9), float(np.sqrt(((np.array(v) - query) ** 2).sum())))
    want = sorted(far, key=lambda i: (far[i], i))[:10]
    assert [r["vec_id"] for r in found] == want


def test_mixing_takes_zero_weights(spark):
    docs = spark.createDataFrame(
        [(i, "a b c d", "en" if i % 2 else "de", f"s{i % 5}") for i in range(200)],
        "doc_id bigint, text string, lang string, source string",
    )
    found = mixing.mix_sources(docs, weights={"lang": {"de": 0}, "source": {"s1": 0.0, "s2": 3.0}})
    assert {r["lang"] for r in found.select("lang").distinct().collect()} == {"en"}
    assert "s1" not in {r["source"] for r in found.select("source").distinct().collect()}
    tokens = found.agg({"tokens": "sum"}).first()[0]
    assert 0.85 * 800 <= tokens <= 800  # the others take the whole budget
    assert mixing.mix_sources(docs, weights={"lang": {"de": 0, "en": 0}}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, weights={"lang": {"de": -1}})
