"""Ranked lexical search: branch and bound over document tries, for all items at once.

Documents are restricted to the terms that the items use, and a document's terms are put in
the order of their frequency. In a block of documents these vectors share the paths of a trie;
paths without a branch are one node. A node knows, for every term, the largest count among the
documents below it, and their smallest ``m``. Both make a term's share larger, so the score of
this imagined document bounds all scores below. The search goes down depth-first, the most
promising child first, and takes along the items whose tenth score so far the bound reaches;
where no item is left, the subtree is done.

A task keeps the best documents of every item over all of its blocks; only these are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import U64, Steps, column, mix, pieces, powers

#: Bytes of item texts that one pass over the documents answers, about.
ITEM_BYTES = 1 << 20
#: Documents of a block at most, and cells of its table of counts.
BLOCK_DOCS, BLOCK_CELLS = 2048, 1 << 22
CHILDREN = 64  # looked at together
NO_ID = 2**63 - 1  # stands for a null id; larger than any other

_TERM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_lo : _hi + 1] = True


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term (letters and digits, and all beyond ASCII; A-Z as a-z), and the number
    of terms before each text's start, and in all."""
    inside = _TERM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    start[cuts] = inside[cuts]
    at = np.flatnonzero(start)
    counts = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, U64), counts
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    place = np.arange(len(data)) - np.repeat(
        np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(data)]]))
    )
    place[~inside] = 0
    with np.errstate(over="ignore"):
        value = np.where(inside, (lower.astype(U64) + U64(1)) * powers(int(place.max()) + 1)[place], U64(0))
        return mix(np.add.reduceat(value, at)), counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of every item."""
    for rows, data, offsets in pieces(batches):
        terms, counts = term_hashes(data, offsets)
        lists = [np.unique(terms[a:b]).view(np.int64) for a, b in zip(counts[:-1], counts[1:])]
        yield pa.RecordBatch.from_arrays(
            [column(rows, "item_id"), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "terms"]
        )


VECTOR = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def _vectors(vocabulary: np.ndarray):
    """Per document with a term: how many it has, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            terms, counts = term_hashes(data, offsets)
            n = np.diff(counts)
            place = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
            known = np.flatnonzero(vocabulary[place] == terms) if len(vocabulary) else place[:0]
            owner = np.searchsorted(counts, known, "right") - 1
            cell, times = np.unique(owner * len(vocabulary) + place[known], return_counts=True)
            bounds = np.searchsorted(cell, np.arange(len(n) + 1) * len(vocabulary))
            some = pa.array(n > 0)
            lists = [
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(v.astype(np.int32)))
                for v in (cell % max(len(vocabulary), 1), times)
            ]
            arrays = [column(rows, "doc_id"), pa.array(n.astype(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays(
                [a.filter(some) for a in arrays], ["doc_id", "n", "terms", "counts"]
            )

    return run


@dataclass(frozen=True)
class Items:
    """Terms of items as places in the frequency order, with their weights, item after item."""

    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def only(self, chosen: np.ndarray) -> Items:
        sizes = np.diff(self.starts)[chosen]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[chosen] - starts[:-1], sizes)
        return Items(starts, self.places[at], self.weights[at])

    def scores(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """One row of scores per row of ``tf``; every item has a term."""
        used, at = np.unique(self.places, return_inverse=True)
        tf = tf[:, used].astype(np.int64)
        share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])
        return np.add.reduceat(share[:, at] * self.weights, self.starts[:-1], axis=1)


class Best:
    """The ``k`` best documents of every item; of equal scores the smaller id."""

    def __init__(self, items: int, k: int) -> None:
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.k = k
        #: A score must reach this to be looked at.
        self.floor = np.ones(items, np.int64)

    def offer(self, item: int, score: int, doc: int) -> None:
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -doc))
        elif (score, -doc) > heap[0]:
            heapq.heapreplace(heap, (score, -doc))
        if len(heap) == self.k:
            self.floor[item] = heap[0][0]


class Trie:
    """Documents of a block, sorted by their term sequences, and the nodes above them."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, bounds: np.ndarray, places: np.ndarray,
                 counts: np.ndarray, width: int) -> None:
        sequences = [places[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        order = sorted(range(len(docs)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.docs, self.m = docs[order], m[order]
        tf = np.zeros((len(docs), width), np.int32)
        rank = np.empty(len(docs), np.int64)
        rank[order] = np.arange(len(docs))
        tf[np.repeat(rank, np.diff(bounds)), places] = counts
        self.tf = tf
        shared = [0]
        for a, b in zip(order[:-1], order[1:]):
            x, y = sequences[a], sequences[b]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        # A node is (children, tf maxima, smallest m); a child below len(docs) is a document.
        self.children: list[list[int]] = []
        self.most: list[np.ndarray] = []
        self.least: list[int] = []
        open_nodes: list[tuple[int, list[int]]] = []  # depth and children so far

        def close(child: int, depth: int) -> int:
            """Ends the open nodes deeper than ``depth``; ``child`` is what hangs below them."""
            while open_nodes and open_nodes[-1][0] > depth:
                children = open_nodes.pop()[1]
                children.append(child)
                child = self._node(children)
            return child

        for i, depth in enumerate(shared[1:], 1):
            child = close(i - 1, depth)
            if open_nodes and open_nodes[-1][0] == depth:
                open_nodes[-1][1].append(child)
            else:
                open_nodes.append((depth, [child]))
        self.root = close(len(docs) - 1, -1)

    def _node(self, children: list[int]) -> int:
        self.children.append(children)
        self.most.append(self._counts(children).max(axis=0))
        self.least.append(int(self._m(children).min()))
        return len(self.docs) + len(self.children) - 1

    def _counts(self, children: list[int]) -> np.ndarray:
        n = len(self.docs)
        return np.stack([self.tf[c] if c < n else self.most[c - n] for c in children])

    def _m(self, children: list[int]) -> np.ndarray:
        n = len(self.docs)
        return np.array([self.m[c] if c < n else self.least[c - n] for c in children], np.int64)

    def search(self, items: Items, best: Best) -> int:
        """Offers every document that can be among the best; the number of nodes gone into."""
        every = np.arange(len(items.starts) - 1)
        if self.root < len(self.docs):
            self._look([self.root], every, items, best)
            return 0
        entered = 0
        stack = [(self.root, every, np.full(len(every), np.iinfo(np.int64).max), items)]
        while stack:
            node, active, bound, own = stack.pop()
            reached = bound >= best.floor[active]
            if not reached.any():
                continue
            if 2 * reached.sum() < len(active):
                own = own.only(np.flatnonzero(reached))
                active = active[reached]
            entered += 1
            children = self.children[node - len(self.docs)]
            below: list[tuple[int, np.ndarray]] = []
            for lo in range(0, len(children), CHILDREN):
                below += self._look(children[lo : lo + CHILDREN], active, own, best)
            below.sort(key=lambda pair: int(pair[1].sum()))
            stack += [(child, active, bounds, own) for child, bounds in below]
        return entered

    def _look(self, children: list[int], active: np.ndarray, items: Items, best: Best):
        """Offers the documents among ``children``; the others, with their bounds."""
        scores = items.scores(self._counts(children), self._m(children))
        leaf = np.array([c < len(self.docs) for c in children])
        row, at = np.nonzero((scores >= best.floor[active]) & leaf[:, None])
        found = scores[row, at]
        first = np.argsort(-found, kind="stable")
        for r, a, score in zip(row[first].tolist(), at[first].tolist(), found[first].tolist()):
            if score >= best.floor[active[a]]:
                best.offer(int(active[a]), score, int(self.docs[children[r]]))
        return [(c, s) for c, s, flat in zip(children, scores, leaf) if not flat]


FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


def _search(ids: list[int | None], items: Items, order: np.ndarray, total: int, terms: int, k: int):
    """``order``: place of every vocabulary entry; ``total`` documents have ``terms`` terms in all."""
    width = len(order)
    block = int(min(max(BLOCK_CELLS // max(width, 1), 16), BLOCK_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                docs = np.asarray(column(part, "doc_id").fill_null(NO_ID))
                n = np.asarray(column(part, "n"))
                lists, counts = column(part, "terms"), column(part, "counts")
                bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                places, counts = order[np.asarray(lists.flatten())], np.asarray(counts.flatten())
                owner = np.repeat(np.arange(len(n)), np.diff(bounds))
                by = np.lexsort((places, owner))
                m = 10 + (90 * n * total) // terms
                Trie(docs, m, bounds, places[by], counts[by], width).search(items, best)
        rows = [
            (item, ids[item], None if doc == -NO_ID else -doc, score)
            for item, heap in enumerate(best.heaps)
            for score, doc in heap
        ]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")]
        )

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item.

    Needs ``docs(doc_id, text)`` and ``items(item_id, text)``; other columns are ignored. Only
    scores above 0 count; of equal scores the smaller ``doc_id`` comes first, a null id last.
    Rows of ``docs`` that repeat an id are documents of their own. Rows of ``items`` that
    repeat id and text come once; those that repeat the id alone are ranked each on its own.
    Null and empty texts have no terms: as documents they do not count, as items they find nothing.

    Items are answered in blocks of about ``ITEM_BYTES`` of text, one pass over the documents each;
    terms are compared by 64-bit hashes.
    """
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(
        "text is not null"
    ).distinct()
    size = texts.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    blocks = -(-size // ITEM_BYTES)
    steps = Steps(docs.sparkSession, "ranked")
    found: DataFrame | None = None
    for number in range(blocks):
        chosen = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        part = _rank_block(docs, chosen, steps, number, k)
        if part is not None:
            found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found


def _rank_block(docs: DataFrame, texts: DataFrame, steps: Steps, number: int, k: int) -> DataFrame | None:
    rows = texts.mapInArrow(_item_terms, "item_id bigint, terms array<bigint>").filter("size(terms) > 0")
    asked = sorted(
        ((r["item_id"], sorted(r["terms"])) for r in rows.collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    if not asked:
        return None
    vocabulary = np.unique(np.concatenate([np.array(t, np.int64) for _, t in asked]).view(U64))
    stored = steps.keep(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInArrow(_vectors(vocabulary), VECTOR),
        f"vectors{number}", free=False,
    )
    sums = stored.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not sums["docs"]:
        return None
    # One number per term of the items of this block.
    held = stored.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[np.asarray(held.column("term"))] = np.asarray(held.column("count"))
    order = np.empty(len(df), np.int64)
    order[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * d + 1))) for d in df.tolist()])
    own = [np.searchsorted(vocabulary, np.array(t, np.int64).view(U64)) for _, t in asked]
    flat = np.concatenate(own)
    items = Items(np.concatenate([[0], np.cumsum([len(o) for o in own])]), order[flat], weight[flat])
    run = _search([i for i, _ in asked], items, order, sums["docs"], sums["terms"], k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        stored.filter("size(terms) > 0").select("doc_id", "n", "terms", "counts")
        .mapInArrow(run, FOUND)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
