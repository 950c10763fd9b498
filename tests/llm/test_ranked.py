import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import ranked

from llm_helpers import docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id bigint, text string, score int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(doc, Counter(terms(t))) for doc, t in docs]
    bags = [(doc, b) for doc, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for doc, bag in bags:
            m = 10 + (90 * sum(bag.values()) * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in set(terms(text))
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    table = spark.createDataFrame([(i, t, 1) for i, t in items], ITEM)
    found = ranked.rank_documents(docs_of(spark, docs).repartition(4), table, **kw)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed, size=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["ÄÖ", "語x", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=n))

    docs = [(1000 - i, text(rng.choice([0, 1, 5, 40, 200]))) for i in range(size)]
    return docs, [(i, text(rng.choice([1, 3, 20]))) for i in range(15)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    monkeypatch.setattr(ranked, "ITEM_BYTES", [60, 1 << 20, 400][seed])  # several blocks of items
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    long = "aa bb " * 200_000
    docs = [(1, "aa bb cc"), (1, "aa bb cc"), (None, "aa bb cc"), (2, None), (3, ""), (4, "--"), (5, long), (6, "AA"), (-7, "zz")]
    docs += [(100 + i, "bb cc") for i in range(30)]  # ties
    items = [(1, "Aa cc"), (1, "Aa cc"), (1, "zz"), (None, "bb"), (2, None), (3, ""), (4, "none of these")]
    assert run(spark, docs, items) == brute(docs, [i for i in items if i[1]])
    assert run(spark, docs, items, k=3) == brute(docs, [i for i in items if i[1]], 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, "")], [(1, "a")]) == []


def test_trie_prunes():
    """Where few documents answer an item, most nodes are never gone into."""
    rng = np.random.default_rng(3)
    docs, width = 600, 80
    rows = [np.sort(rng.choice(width - 10, 12, replace=False)) for _ in range(docs)]
    for i in range(12):  # some hold the rare terms of the item
        rows[50 * i] = np.concatenate([rows[50 * i][:4], np.arange(width - 10, width)])
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    places = np.concatenate(rows)
    m = np.full(docs, 100)
    trie = ranked.Trie(np.arange(docs), m, bounds, places, np.ones(len(places), np.int64), width)
    items = ranked.Items(np.array([0, 12]), np.concatenate([[0, 1], np.arange(width - 10, width)]), np.array([5, 5] + [900] * 10))
    best = ranked.Best(1, 10)
    entered = trie.search(items, best)
    assert entered < len(trie.children) / 3
    assert {-d for _, d in best.heaps[0]} < {50 * i for i in range(12)}
    for node, below in enumerate(trie.children):  # bounds hold
        counts, smallest = trie._counts(below), trie._m(below)
        assert (counts.max(axis=0) == trie.most[node]).all() and smallest.min() == trie.least[node]
