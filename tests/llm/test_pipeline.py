"""Every stage of the pipeline against a plain version of it, on the smallest tables."""

import hashlib

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from panelloom.llm import pieces, queries  # noqa: E402
from panelloom.llm.common import Steps  # noqa: E402

import test_jaccard  # noqa: E402
from llm_helpers import SMALL, docs_of  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    steps, docs = Steps(spark, "test"), spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(steps.keep(stage(spark, out[-1], SMALL), name))
    return out


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS
    assert {"doc_id", "ids", "n_tokens"} <= set(stages[-1].columns)


def test_toxic_documents_go(spark, stages):
    toxic = spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1")
    clean = spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 0")
    kept = stages[1].select("doc_id")
    assert kept.join(clean, "doc_id").count() >= 0.97 * clean.join(stages[0], "doc_id").count()
    assert kept.join(toxic, "doc_id").count() < toxic.join(stages[0], "doc_id").count()


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = sorted(doc for doc, _, component in test_jaccard.brute(rows) if doc == component)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == want


def test_repeats_are_cut(stages):
    rows = sorted((r["doc_id"], r["text"] or "") for r in stages[2].collect())
    seen, want = {}, {}
    for doc, text in rows:
        raw = text.encode()
        for p in range(len(raw) - 49):
            seen.setdefault(raw[p : p + 50], doc)
    for doc, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen[raw[p : p + 50]] < doc:
                gone[p : p + 50] = b"\1" * 50
        want[doc] = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    assert {r["doc_id"]: r["text"] or "" for r in stages[3].collect()} == want


def test_mixing_equals_sql(stages, tmp_path):
    stages[3].coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(r[0] for r in con.execute(queries.MIXING_SQL).fetchall())
    assert sorted(r["doc_id"] for r in stages[4].collect()) == want


def test_ids_decode_to_the_text(stages):
    texts = {r["doc_id"]: r["text"] or "" for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    table = pieces.load().decoder()
    for r in rows:
        raw = b"".join(table[i] for i in r["ids"])
        assert raw.decode() == texts[r["doc_id"]] and r["round_trip"]
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_odd_rows(spark):
    rows = [
        (None, "no id"), (None, None), (1, ""), (1, "same id"), (2, "words " * 3000),
        (3, "words " * 3000), (4, "?!"), (5, "one two three four five six seven"),
    ]
    docs = docs_of(spark, rows).drop("score")
    for _, stage in corpus_pipeline.STAGES:
        full, empty = stage(spark, docs, SMALL), stage(spark, docs.limit(0), SMALL)
        assert full.columns == empty.columns and empty.count() == 0
        docs = full.select(*corpus_pipeline.COLUMNS) if "text" in full.columns else docs
    assert full.count() > 0
