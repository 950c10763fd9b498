import hashlib
import random

import numpy as np
import pytest

from panelloom.llm import suffixes

from llm_helpers import SMALL, docs_of


def brute(rows):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: -(2**63) if i is None else i
    for i, b in texts:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    rows = suffixes.remove_repeats(df).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
    return sorted((tuple(r) for r in rows.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "über", "x", "the", "of"]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(3)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        if rng.random() < 0.6:
            text += rng.choice(passages) + " " + " ".join(rng.choices(words, k=5))
        if rng.random() < 0.3 and rows:
            old = rows[rng.randrange(len(rows))][1] or ""
            text = old[: len(old) // 2] + "#" + old[len(old) // 2 :]
        rows.append((i * 3, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(docs_of(spark, rows).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 9) % 26) for i in range(3000))
    rows = [
        (None, long[:200]), (1, None), (2, ""), (3, "a" * 500), (4, "a" * 49), (5, "a" * 50),
        (6, long), (6, long), (7, long + long), (8, long[:49]), (9, "é" * 60), (10, "xé" + "é" * 60),
    ]
    assert run(docs_of(spark, rows)) == brute(rows)
    assert run(docs_of(spark, rows).limit(0)) == []


def test_hot_anchor_and_long_text_are_split(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=160))
    rows = [
        (i, "".join(rng.choices("klmnop", k=40)) + passage + "".join(rng.choices("qrst", k=40)))
        for i in range(40)
    ]
    found = suffixes.remove_repeats(docs_of(spark, rows).repartition(3), hot_strings=3).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    data = np.frombuffer(b"".join(t.encode() for _, t in rows), np.uint8)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 700)
    parts = list(suffixes._sliced(data, np.array([0, len(data)])))
    assert sum(int(p[4].sum()) for p in parts) == len(data) - 49


def test_column_wise_construction():
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 100, 200).astype(np.uint8))
    strings = []
    for _ in range(200):
        at, size = rng.integers(0, 115), rng.integers(50, 85)
        text = bytearray(base[at : at + size])
        if rng.random() < 0.5:
            text[rng.integers(0, len(text))] = 120
        strings.append(bytes(text))
    docs = rng.integers(0, 60, 200)
    least = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], 999), int(d))
    data, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    found = suffixes.smallest_documents(data, lengths, docs)
    assert found.tolist() == [least[s[i : i + 50]] for s in strings for i in range(len(s) - 49)]


def test_text_without_repeats(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = suffixes.remove_repeats(docs, keep_text=True)
    assert kept.columns[: len(docs.columns)] == docs.columns
    clean = kept.filter("n_removed = 0").join(docs.select("doc_id", docs.text.alias("old")), "doc_id")
    assert clean.filter("text = old").count() == clean.count() > 0


def test_equal_strings_have_equal_anchors_too():
    h, x = np.array([7, 7, 8, 8], np.uint64), np.array([5, 5, 5, 5], np.uint64)
    assert suffixes._later(h, x, np.array([2, 1, 4, 3])).tolist() == [True, False, True, False]
    assert suffixes._later(h, x, np.array([1, 1, 3, 3])).tolist() == [False] * 4


@pytest.mark.parametrize("hot", [1, 4, 30])
def test_split_anchors_equal_brute_force(spark, hot):
    rng = random.Random(11)
    line = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, t) for i, t in corpus(7)]
    for i in range(1, 40):  # a common line, whole or cut, between words of its own
        part = line[rng.randint(0, 30) : rng.randint(60, 90)]
        rows.append((1000 - 2 * i, "".join(rng.choices("klm", k=20)) + part + "".join(rng.choices("nop", k=20))))
    found = suffixes.remove_repeats(docs_of(spark, rows).repartition(3), hot_strings=hot).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_anchors_that_meet_by_chance_are_not_fetched(spark, monkeypatch):
    rng = random.Random(3)
    short, passage = "".join(rng.choices("abcdefgh", k=20)), "".join(rng.choices("abcdefgh", k=70))
    rows = [
        (i, "".join(rng.choices("klmnop", k=60)) + short + "".join(rng.choices("qrst", k=60)))
        for i in range(400)
    ]
    rows += [(900 + i, "".join(rng.choices("uvw", k=60)) + passage) for i in range(2)]
    kept, keep = {}, suffixes.Steps.keep

    def count(self, df, name, free=True):
        out = keep(self, df, name, free)
        kept[name] = out
        return out

    monkeypatch.setattr(suffixes.Steps, "keep", count)
    found = suffixes.remove_repeats(docs_of(spark, rows)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
    # Only the strings at the passage's edges are left; equal ones need no bytes.
    asked = kept["found"].filter("h is not null")
    assert 0 < asked.count() <= 8 and asked.filter("doc < 900").count() == 0
