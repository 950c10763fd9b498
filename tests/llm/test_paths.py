import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import paths
from panelloom.llm.jaccard import bitmaps, map_bytes

from llm_helpers import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 2:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)}


def similar(a, b):
    common, union = len(a & b), len(a | b)
    return union > 0 and 100 * common >= 80 * union


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in groups[find(i)] if d is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def run(df, **kw):
    found = paths.near_copies(df, **kw)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(seed, size=150):
    """Texts, copies with a few changed words (many of them near the limit), a shared passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = rng.choices(words, k=50)
    rows, texts = [], []
    for i in range(size):
        if texts and rng.random() < 0.6:
            own = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(own) // 15))):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.choice([1, 2, 3, 8, 30, 120, 400]))
            if rng.random() < 0.3:
                own = own + passage
        texts.append(own)
        rows.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(own)))
    return rows


@pytest.mark.parametrize("seed, sizes", [(0, {}), (1, {"task_sets": 8, "tight_sets": 4})])
def test_equals_brute_force(spark, seed, sizes):
    rows = corpus(seed)
    assert run(docs_of(spark, rows).repartition(4), **sizes) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(5, "a b c d"), (5, "x y z"), (4, "X Y z"), (3, None), (2, ""), (1, " \n\t"), (None, "q r s"),
            (None, "u v"), (9, "one"), (8, "ONE"), (7, long), (6, long + " tail"), (-3, "a b c e")]
    rows += [(100 + i, "same text again and again") for i in range(40)]
    assert run(docs_of(spark, rows)) == brute(rows)
    assert run(docs_of(spark, [])) == []
    assert run(docs_of(spark, [(1, None)])) == [(1, 0, 1, True)]


def test_large_group(spark):
    """A group of near copies larger than a task should hold: one class, few pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(rng.choices(base, k=100))) for i in range(100)]
    assert run(docs_of(spark, rows), task_sets=100, tight_sets=32) == brute(rows)


def table_of(sets):
    trees = 1
    tokens = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    roots, values = paths.minwise(tokens, np.cumsum(sizes) - sizes, trees)
    raw, ends = bitmaps(tokens, sizes).tobytes(), np.cumsum(map_bytes(sizes))
    bits = [raw[a:b] for a, b in zip(ends - map_bytes(sizes), ends)]
    rows = pa.table({
        "doc": np.arange(len(sets)), "size": sizes.astype(np.int32),
        "tokens": pa.array([v.tobytes() for v in values], pa.binary()), "bits": pa.array(bits, pa.binary()),
    })
    return rows, roots


def test_recall_of_a_tree(monkeypatch):
    """Pairs at just 0.8 in a node with many others: a tree finds the share that theory gives."""
    monkeypatch.setattr(paths, "SMALL", 4)
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(400):
        base = rng.integers(0, 2**63, 100).astype(np.uint64)
        other = base.copy()
        other[:11] = rng.integers(0, 2**63, 11).astype(np.uint64)  # 89 of 111
        sets += [np.sort(base), np.sort(other)]
    common = rng.integers(0, 2**63, 40).astype(np.uint64)  # all have these, so nodes are full
    sets = [np.unique(np.concatenate([s, common])) for s in sets]
    rows, roots = table_of(sets)
    n = len(sets)
    node = roots.T.ravel()
    again = pa.concat_tables([rows, rows])
    i, j = paths.follow(paths.Sets.of(again), node, np.repeat([1, 2], n).astype(np.int64))
    found = {(min(a, b), max(a, b)) for a, b in zip((i % n).tolist(), (j % n).tolist())}
    hit = sum((2 * k, 2 * k + 1) in found for k in range(400))
    assert hit >= 0.93 * 400
    # Exhaustive comparison of the same table has all of them: filters lose none.
    monkeypatch.setattr(paths, "SMALL", n)
    i, j = paths.follow(paths.Sets.of(rows), np.zeros(n, np.uint64), np.zeros(n, np.int64))
    assert sum(abs(a - b) == 1 and min(a, b) % 2 == 0 for a, b in zip(i.tolist(), j.tolist())) >= 399


def test_groups_are_confirmed_on_full_sets():
    """Rows of two groups, one id with an empty text besides: the links that brute force needs."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    base = rng.choices(words, k=60)
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(own))
    rows = [(1 + i % 2, i, i, t) for i, t in enumerate(texts)] + [(2, 59, 59, "")]
    rows.sort()
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("group", "doc", "label", "text"))})
    found = [
        pair for batch in paths._recheck(iter(table.to_batches(max_chunksize=7)))
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    ]
    links = [
        (a, b) for a in range(60) for b in range(a)
        if a % 2 == b % 2 and similar(shingles(texts[a]), shingles(texts[b]))
    ]
    assert classes(*zip(*found), 60) == classes(*zip(*links), 60) and set(found) <= {(b, a) for a, b in links}
    assert len(found) < 60 < len(links)


def test_forest():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = 30
        i, j = rng.integers(0, n, (2, 25))
        i, j = i[i != j], j[i != j]
        a, b, tree = paths.forest(i, j, n)
        assert len(set(tree.tolist())) == sum(len(c) > 1 for c in classes(i, j, n))
        assert len(a) == n - len(classes(i, j, n)) and classes(a, b, n) == classes(i, j, n)


def classes(i, j, n):
    name = list(range(n))
    for a, b in zip(i, j):
        old, new = name[a], name[b]
        name = [new if x == old else x for x in name]
    return {frozenset(k for k in range(n) if name[k] == c) for c in name}


def test_trees():
    assert paths.trees_for(0.9) == 1 and paths.trees_for(0.999999) == 5 and paths.trees_for(0.9999999999) > 5
