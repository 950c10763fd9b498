"""Near copies by chosen paths: a recursive set similarity join on minwise tokens.

A set of shingles has a few minwise tokens: under each of a number of hash functions, its smallest
value. Sets of similarity s agree in each of them with probability s. A tree deals the sets
into nodes: a node picks two of the tokens that its path has not used yet, by a hash of the
node, and every set goes on to the two children named by its own values. Similar sets meet again
in 2 s > 1 children in expectation, so with a fixed probability they stay together down any
depth, and independent trees bring the recall to its target. Unrelated sets part level by level.

Small nodes are compared exhaustively, and so are nodes in which most sets are close to one
that is picked by a hash: they would not fall apart. What is compared are all minwise tokens of the
tree and bitmaps of the parities of hashed shingles; only a spanning forest of the likely pairs
leaves a node, so a group of n near copies gives n pairs. These are confirmed on the full sets.
Where one fails, the full sets of its tree meet once more, and likely pairs of different
components are confirmed there; only the links that join them leave.

Nodes with more sets than a task should hold are split by Spark, level by level, over all
tasks; below that size a task follows its nodes down by itself. A large node of sets that are
close to one is not split: all are compared with that one, and those that stay outside of its
largest component with all members, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import BASE, MIX_B, U64, Steps, column, mix, pieces
from panelloom.llm.components import components
from panelloom.llm.jaccard import bitmaps, differing, map_bytes, word_hashes
from panelloom.session import small_side

WORDS = 2
BRANCH = 2
TOKENS = 32  # minwise tokens of a tree, one byte each but for the root's
RECALL = 0.999999  # of links at similarity 0.8, if tokens were independent
#: Least agreeing tokens of a pair that is compared further: 15 of 32 is missed by a pair of
#: similarity 0.8 about once in 100,000 times per tree.
LIKELY = 15
CLOSE, CLOSE_SHARE = 18, 0.75
SMALL = 64
#: Sets of a node that one task follows down by itself, and those of a node that may be compared
#: as it is, within a task or as a block.
TASK_SETS, TIGHT_SETS = 1 << 15, 1 << 12
CHUNK, CHUNK_BYTES = TASK_SETS, 64 << 20
PAIR_BYTES = 1 << 23
VERIFY_PART = 256
NO_ID = 2**63 - 1  # stands for a null id; larger than any other
SEED = U64(0xA24BAED4963EE407)


def trees_for(recall: float, similarity: float = 0.8) -> int:
    """Trees that miss a pair of this similarity less often than 1 - ``recall``.

    A tree loses a pair like a branching process dies out: the probability q solves
    q = (1 - similarity + similarity * q) ** BRANCH.
    """
    q = 0.0
    for _ in range(1000):
        q = (1 - similarity + similarity * q) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and the n + 1 bounds."""
    words, counts = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        grams = mix(words[:-1] * BASE + words[1:]) if len(words) > 1 else words[:0]
        sets = []
        for first, last in zip(counts[:-1], counts[1:]):
            if last - first >= WORDS:
                sets.append(np.unique(grams[first : last - 1]))
            else:
                sets.append(mix(words[first:last] ^ SEED))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, U64), bounds


def minwise(tokens: np.ndarray, starts: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: ids of their nodes below the roots (two per tree), and their tokens as
    bytes (``TOKENS`` per tree)."""
    n = len(starts)
    roots = np.zeros((n, trees * BRANCH), U64)
    out = np.zeros((n, trees * TOKENS), np.uint8)
    factor = mix(np.arange(1, trees * TOKENS + 1, dtype=U64) * SEED) | U64(1)
    with np.errstate(over="ignore"):
        for i in range(trees * TOKENS):
            value = mix(np.minimum.reduceat(tokens * factor[i], starts))
            out[:, i] = value & U64(255)
            if i % TOKENS < BRANCH:
                roots[:, i // TOKENS * BRANCH + i % TOKENS] = mix(value + U64(i + 1) * BASE)
    return roots, out


SKETCH = "doc bigint, row bigint, size int, d1 bigint, d2 bigint, bits binary, roots array<bigint>, tokens binary"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _sketch(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for rows, data, offsets in pieces(batches):
            docs = np.asarray(column(rows, "doc_id"))
            number = row + np.arange(len(docs))
            row += len(docs)
            tokens, bounds = shingle_sets(data, offsets)
            sizes = np.diff(bounds)
            digest = np.zeros((2, len(docs)), U64)
            some = np.flatnonzero(sizes)
            with np.errstate(over="ignore"):
                for i, salt in enumerate((SEED, MIX_B)):
                    if len(some):
                        digest[i, some] = np.add.reduceat(mix(tokens ^ salt), bounds[some])
            # Of equal sets in a piece, the first of the smallest id alone is sketched.
            by = np.lexsort((number, docs, digest[1], digest[0]))
            new = np.ones(len(by), bool)
            new[1:] = (np.diff(digest[:, by], axis=1) != 0).any(axis=0)
            shown = np.zeros(len(docs), bool)
            shown[by[new]] = True
            shown &= sizes > 0
            own = tokens[np.repeat(shown, sizes)]
            size = sizes[shown]
            starts = np.cumsum(size) - size
            bits, roots, values = [], [], []
            if len(size):
                nodes, found = minwise(own, starts, trees)
                roots = nodes.view(np.int64).tolist()
                values = [v.tobytes() for v in found]
                raw, ends = bitmaps(own, size).tobytes(), np.cumsum(map_bytes(size))
                bits = [raw[a:b] for a, b in zip(ends - map_bytes(size), ends)]
            at = np.cumsum(shown) - 1
            pick = pa.array(np.where(shown, at, 0), mask=~shown)
            heavy = [
                pa.array(v, t).take(pick)
                for v, t in ((bits, pa.binary()), (roots, pa.list_(pa.int64())), (values, pa.binary()))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs), pa.array(number), pa.array(sizes.astype(np.int32)),
                    *[pa.array(d.view(np.int64)) for d in digest], *heavy,
                ],
                _names(SKETCH),
            )

    return run


# --- nodes -----------------------------------------------------------------------------------

ENTRY = "node bigint, mask bigint, doc bigint, size int, tokens binary, bits binary"


def picks(node: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``BRANCH`` unused tokens that each node branches on; False where none is left."""
    number = np.arange(TOKENS, dtype=U64)
    with np.errstate(over="ignore"):
        order = mix(node[:, None] * BASE + number) >> U64(1)
    used = ((mask[:, None] >> np.arange(TOKENS)) & 1) > 0
    order[used] = ~U64(0)
    first = np.argsort(order, axis=1, kind="stable")[:, :BRANCH]
    return first, ~np.take_along_axis(used, first, axis=1)


def children(node: np.ndarray, mask: np.ndarray, tokens: np.ndarray):
    """(entry, node, mask) of all children that the entries go on to."""
    chosen, free = picks(node, mask)
    entry, side = np.nonzero(free)
    token = chosen[entry, side]
    with np.errstate(over="ignore"):
        value = tokens[entry, token].astype(U64) + U64(256) * (token.astype(U64) + U64(1))
        below = mix(node[entry] ^ mix(value * SEED))
    return entry, below, mask[entry] | (np.int64(1) << token)


@dataclass
class Sets:
    """Entries of a task: what pairs are compared by."""

    doc: np.ndarray
    size: np.ndarray
    tokens: np.ndarray
    label: np.ndarray | None
    widths: np.ndarray
    maps: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch, label: np.ndarray | None = None) -> Sets:
        doc, size = (np.asarray(rows.column(c)).astype(np.int64) for c in ("doc", "size"))
        tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint8)
        bits = rows.column("bits").to_pylist()
        widths = map_bytes(size)
        tiles = {}
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            tiles[width] = at, np.frombuffer(b"".join([bits[i] for i in at.tolist()]), U64).reshape(len(at), -1)
        # Sets that differ by a quarter at most have maps of one width, or of two neighbours.
        maps = {}
        for width, (at, tile) in tiles.items():
            if 2 * width in tiles:
                wide, other = tiles[2 * width]
                folded = np.bitwise_xor.reduce(other.reshape(len(wide), 2, -1), axis=1)
                at, tile = np.concatenate([at, wide]), np.concatenate([tile, folded])
            place = np.full(len(doc), -1)
            place[at] = np.arange(len(at))
            maps[width] = place, tile
        return cls(doc, size, tokens.reshape(-1, TOKENS), label, widths, maps)

    def close(self, i: np.ndarray, j: np.ndarray, least: int = CLOSE) -> np.ndarray:
        out = np.zeros(len(i), bool)
        step = PAIR_BYTES // TOKENS
        for lo in range(0, len(i), step):
            part = slice(lo, lo + step)
            out[part] = (self.tokens[i[part]] == self.tokens[j[part]]).sum(axis=1) >= least
        return out

    def likely(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that may be similar, of different documents (and components)."""
        keep = (5 * self.size[i] >= 4 * self.size[j]) & (5 * self.size[j] >= 4 * self.size[i])
        keep &= self.doc[i] != self.doc[j]
        if self.label is not None:
            keep &= self.label[i] != self.label[j]
        i, j = i[keep], j[keep]
        keep = self.close(i, j, LIKELY)
        i, j = i[keep], j[keep]
        width = np.minimum(self.widths[i], self.widths[j])
        keep = np.zeros(len(i), bool)
        for w in np.unique(width).tolist():
            place, tile = self.maps[w]
            at = np.flatnonzero(width == w)
            step = max(PAIR_BYTES // w, 1)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                x = tile[place[i[part]]] ^ tile[place[j[part]]]
                apart = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                keep[part] = apart <= differing(self.size[i[part]], self.size[j[part]])
        return i[keep], j[keep]


def within(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places inside each of the small runs, distance by distance."""
    lengths = ends - starts
    at = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    last = np.repeat(ends, lengths)
    distance = 1
    while len(at):
        fits = at + distance < last
        at, last = at[fits], last[fits]
        if len(at):
            yield at, at + distance
        distance += 1


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the graph of the pairs on ``n`` vertices, and the tree of each edge."""
    low, high = np.minimum(i, j), np.maximum(i, j)
    parent = np.arange(n)
    np.minimum.at(parent, high, low)
    star = np.flatnonzero(parent != np.arange(n))
    root = parent
    while (root[root] != root).any():
        root = root[root]
    more = np.flatnonzero(root[low] != root[high])
    to = root.copy()

    def find(x: int) -> int:
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    kept = []
    for e in more.tolist():
        a, b = find(int(root[low[e]])), find(int(root[high[e]]))
        if a != b:
            to[max(a, b)] = min(a, b)
            kept.append(e)
    while (to[to] != to).any():
        to = to[to]
    first, second = np.concatenate([parent[star], low[kept]]), np.concatenate([star, high[kept]])
    return first, second, to[first]


def follow(sets: Sets, node: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs of entries that meet in a node that is compared, below the given ones."""
    entry = np.arange(len(node))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(entry):
        order = np.argsort(node, kind="stable")
        entry, node, mask = entry[order], node[order], mask[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
        ends = np.concatenate([starts[1:], [len(node)]])
        size = ends - starts
        small = (size > 1) & (size <= SMALL)
        for a, b in within(starts[small], ends[small]):
            found.append(sets.likely(entry[a], entry[b]))
        starts, ends = starts[size > SMALL], ends[size > SMALL]
        goes_on = np.zeros(len(entry), bool)
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            members = entry[lo:hi]
            with np.errstate(over="ignore"):
                pivot = int(np.argmin(mix(sets.doc[members].view(U64) ^ node[lo])))
            near = sets.close(np.full(len(members), members[pivot]), members)
            used_up = int(mask[lo]).bit_count() >= TOKENS
            if used_up or near.mean() >= CLOSE_SHARE:
                found += _exhaust(sets, members, pivot)
            else:
                goes_on[lo:hi] = True
        at = np.flatnonzero(goes_on)
        which, node, mask = children(node[at], mask[at], sets.tokens[entry[at]])
        entry = entry[at[which]]
    empty = np.zeros(0, np.int64)
    i = np.concatenate([f[0] for f in found]) if found else empty
    j = np.concatenate([f[1] for f in found]) if found else empty
    return i, j


def _exhaust(sets: Sets, members: np.ndarray, pivot: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs of a node that does not fall apart: all members with the pivot, and the others
    that this does not connect with all members."""
    i, j = sets.likely(np.full(len(members), members[pivot]), members)
    others = members[~np.isin(members, j) & (np.arange(len(members)) != pivot)]
    return [(i, j), *[sets.likely(np.full(len(members), one), members) for one in others.tolist()]]


PAIR = "group bigint, a bigint, b bigint"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the likely pairs below every node; ``group`` names a tree of it."""
    for rows in _whole(batches, "node"):
        sets = Sets.of(rows)
        node = np.asarray(rows.column("node")).astype(np.int64).view(U64)
        i, j = follow(sets, node, np.asarray(rows.column("mask")).astype(np.int64))
        i, j, root = forest(i, j, len(node))
        # A document has one entry per node, but nodes are followed together.
        group = mix(node[i] ^ mix(sets.doc[root].view(U64))).view(np.int64)
        a, b = np.minimum(sets.doc[i], sets.doc[j]), np.maximum(sets.doc[i], sets.doc[j])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (group, a, b)], _names(PAIR))


def _recheck(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside of a group that connect different components, confirmed on the full sets: at
    most one per component that they join to another."""
    for rows in _whole(batches, "group"):
        texts = pa.table({"text": rows.column("text").combine_chunks()}).to_batches()
        parts = [shingle_sets(data, offsets) for _, data, offsets in pieces(texts)]
        tokens = np.concatenate([t for t, _ in parts])
        size = np.concatenate([np.diff(bounds) for _, bounds in parts])
        # An id that several rows have may have a text without words besides.
        rows, size = rows.filter(pa.array(size > 0)), size[size > 0]
        starts = np.cumsum(size) - size
        raw, ends = bitmaps(tokens, size).tobytes(), np.cumsum(map_bytes(size))
        values = minwise(tokens, starts, 1)[1]
        sets = Sets.of(
            pa.table(
                {
                    "doc": rows.column("doc"), "size": size,
                    "tokens": pa.array([v.tobytes() for v in values], pa.binary()),
                    "bits": pa.array([raw[x:y] for x, y in zip(ends - map_bytes(size), ends)], pa.binary()),
                }
            ),
            np.asarray(rows.column("label")),
        )
        group = np.asarray(rows.column("group"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        links = [
            link for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())
            for link in _connect(sets, lo, hi, tokens, starts)
        ]
        if links:
            pairs = np.sort(sets.doc[np.array(links)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _connect(
    sets: Sets, lo: int, hi: int, tokens: np.ndarray, starts: np.ndarray
) -> Iterator[tuple[int, int]]:
    """Links that join the components of the sets from ``lo`` to ``hi``: every set against those
    after it, likely ones first, as long as the two are not joined yet."""
    root = {label: label for label in sets.label[lo:hi].tolist()}

    def find(label: int) -> int:
        while root[label] != label:
            root[label] = root[root[label]]
            label = root[label]
        return label

    labels = sets.label.tolist()
    for one in range(lo, hi - 1):
        if len(root) == 1:
            return
        others = np.arange(one + 1, hi)
        for j in sets.likely(np.full(len(others), one), others)[1].tolist():
            a, b = find(labels[one]), find(labels[j])
            if a == b:
                continue
            x = tokens[starts[one] : starts[one] + sets.size[one]]
            y = tokens[starts[j] : starts[j] + sets.size[j]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                root[max(a, b)] = min(a, b)
                yield one, j


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that come in the order of ``key``, about ``CHUNK`` or ``CHUNK_BYTES`` at a time, no key cut."""
    held: list[pa.RecordBatch] = []
    size = weight = 0
    for batch in batches:
        step = max(1, min(CHUNK, CHUNK_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for lo in range(0, batch.num_rows, step):
            held.append(batch.slice(lo, step))
            size += held[-1].num_rows
            weight += held[-1].nbytes
            if size < CHUNK and weight < CHUNK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            keys = np.asarray(rows.column(key))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield rows.slice(0, cut)
                rest = rows.slice(cut)
                held, size, weight = rest.to_batches(), rest.num_rows, rest.nbytes
    if size:
        yield pa.Table.from_batches(held)


# --- nodes too large for a task --------------------------------------------------------------


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether an entry is close to its node's pivot, and whether the two are a likely pair."""
    for batch in batches:
        n = batch.num_rows
        own = pa.table({c: column(batch, c) for c in ("doc", "size", "tokens", "bits")})
        pivot = pa.table({c: column(batch, f"p_{c}") for c in ("doc", "size", "tokens", "bits")})
        sets = Sets.of(pa.concat_tables([own, pivot]))
        i, j = np.arange(n), np.arange(n, 2 * n)
        likely = np.zeros(n, bool)
        likely[sets.likely(i, j)[0]] = True
        names = [*_names(ENTRY), "p_doc", "n"]
        yield pa.RecordBatch.from_arrays(
            [*[column(batch, c) for c in names], pa.array(sets.close(i, j)), pa.array(likely)],
            [*names, "close", "likely"],
        )


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = np.asarray(column(batch, "node")).astype(np.int64).view(U64)
        mask = np.asarray(column(batch, "mask")).astype(np.int64)
        tokens = np.frombuffer(b"".join(column(batch, "tokens").to_pylist()), np.uint8)
        entry, below, used = children(node, mask, tokens.reshape(-1, TOKENS))
        at = pa.array(entry)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(below.view(np.int64)), pa.array(used),
                *[column(batch, c).take(at) for c in ("doc", "size", "tokens", "bits")],
            ],
            _names(ENTRY),
        )


def _split(entries: DataFrame, steps: Steps, task_sets: int, tight_sets: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries of nodes that fit a task, and those of nodes above ``tight_sets`` that would not fall
    apart, the latter with their pivot. The tables of large nodes are small against the entries."""
    fitting: list[DataFrame] = []
    tight: list[DataFrame] = []
    level = 0
    while True:
        sizes = entries.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > tight_sets)
        large = small_side(sizes, f"paths-large{level}")
        if large.isEmpty():
            break
        drawn = F.struct(F.xxhash64("node", "doc").alias("draw"), "doc", "size", "tokens", "bits")
        pivots = small_side(
            entries.join(large, "node").groupBy("node").agg(F.min(drawn).alias("p"), F.max("n").alias("n"))
            .select("node", "n", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("doc", "size", "tokens", "bits")]),
            f"paths-pivots{level}",
        )
        flagged = entries.join(pivots, "node").mapInArrow(
            _against_pivot, f"{ENTRY}, p_doc bigint, n bigint, close boolean, likely boolean"
        )
        judged = flagged.groupBy("node").agg(
            F.avg(F.col("close").cast("double")).alias("share"), F.max("n").alias("n"),
            F.max(F.bit_count("mask")).alias("used"),
        ).select(
            "node", ((F.col("share") >= CLOSE_SHARE) | (F.col("used") >= TOKENS)).alias("tight"),
            (F.col("n") > task_sets).alias("wide"),
        ).filter("tight or wide")
        judged = small_side(judged, f"paths-judged{level}")
        tight.append(flagged.join(judged.filter("tight"), "node", "left_semi"))
        fitting.append(entries.join(judged, "node", "left_anti").select(*_names(ENTRY)))
        wide = entries.join(judged.filter("not tight"), "node", "left_semi")
        entries = steps.keep(
            wide.select(*_names(ENTRY)).mapInArrow(_branch, ENTRY), f"entries{level + 1}", free=False
        )
        level += 1
    fitting.append(entries)
    return reduce(DataFrame.unionByName, fitting), reduce(DataFrame.unionByName, tight) if tight else None


def _strangers(key: tuple, members: pa.Table, strangers: pa.Table) -> pa.Table:
    """Likely pairs of a block of strangers with a block of members, of different components."""
    names = ("doc", "size", "tokens", "bits", "label")
    sides = [t.select([f"{s}_{c}" for c in names]).rename_columns(names) for s, t in (("m", members), ("s", strangers))]
    both = pa.concat_tables(sides)
    n, total = members.num_rows, both.num_rows
    sets = Sets.of(both, np.asarray(both.column("label")))
    found = [sets.likely(np.full(n, one), np.arange(n)) for one in range(n, total)]
    i, j = (np.concatenate([f[side] for f in found]) for side in (0, 1)) if found else ([], [])
    i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
    a, b = np.minimum(sets.doc[i], sets.doc[j]), np.maximum(sets.doc[i], sets.doc[j])
    return pa.table({"a": a, "b": b})


def _across(tight: DataFrame, labels: DataFrame, tight_sets: int) -> DataFrame:
    """Likely pairs of the members of a large node that lie outside of its largest component with
    all of its members, block by block."""
    named = tight.join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    per = named.groupBy("node", "label").agg(F.count("*").alias("n"))
    largest = per.groupBy("node").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"),
        (F.sum("n") - F.max("n")).alias("others"),
    ).filter("others > 0")
    blocks = largest.select(
        "node", "largest", F.ceil(F.col("n") / tight_sets).cast("int").alias("parts"),
        F.ceil(F.col("others") / max(tight_sets // 4, 1)).cast("int").alias("turns"),
    )
    rows = named.join(blocks, "node")
    names = ["node", "doc", "size", "tokens", "bits", "label", "part", "turn"]

    def spread(df: DataFrame, own: str, other: str, parts: str, copies: str, side: str) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("doc"), F.col(parts)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))
        )
        return dealt.select(*[F.col(c).alias(f"{side}_{c}") for c in names])

    left = spread(rows, "part", "turn", "parts", "turns", "m")
    right = spread(rows.filter("label <> largest"), "turn", "part", "turns", "parts", "s")
    return (
        left.groupBy("m_node", "m_part", "m_turn")
        .cogroup(right.groupBy("s_node", "s_part", "s_turn"))
        .applyInArrow(_strangers, "a bigint, b bigint")
    )


# --- confirmation ----------------------------------------------------------------------------


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar: 100 * intersection >= 80 * union."""
    for batch in batches:
        for rows, data, offsets in pieces([batch], "text_a"):
            x, x_at = shingle_sets(data, offsets)
            keep = np.zeros(rows.num_rows, bool)
            done = 0
            for part, other, ends in pieces([rows], "text_b"):
                y, y_at = shingle_sets(other, ends)
                for i in range(part.num_rows):
                    a = x[x_at[done] : x_at[done + 1]]
                    b = y[y_at[i] : y_at[i + 1]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    union = len(a) + len(b) - common
                    keep[done] = union > 0 and 100 * common >= 80 * union
                    done += 1
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "a").filter(mask), column(rows, "b").filter(mask)], ["a", "b"]
            )


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of distinct ``pairs``; a document of many pairs is dealt out in parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_PART).cast("int").alias("parts"))
    left = (
        texts.join(parts, texts["doc_id"] == parts["a"])
        .select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return (
        dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirm, "a bigint, b bigint").distinct()
    )


def near_copies(
    docs: DataFrame, recall: float = RECALL, task_sets: int = TASK_SETS, tight_sets: int = TIGHT_SETS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document of ``docs(doc_id, text)``.

    Sets of distinct 2-word shingles are linked at Jaccard similarity 0.8 and more, confirmed on
    the full sets; ``recall`` is the least share of links at just 0.8 that is found in
    expectation (similar ones are found more often, and a component holds by any of its links).
    ``component_id`` is the smallest id reachable, ``kept`` tells the document that has it.

    A text of one word is a set of its own; null, empty and blank texts have none, and no links.
    Equal sets are always linked. Rows that repeat an id are linked through it; a null id is a
    value of its own, larger than all others. Other columns are ignored. Shingles are compared
    by 64-bit hashes, equal sets by 128 bits.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "paths")
    trees = trees_for(recall)
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text"
    )
    sets = steps.keep(texts.mapInArrow(_sketch(trees), SKETCH), "sets", free=False)
    leaders = steps.keep(
        sets.filter("size > 0").groupBy("d1", "d2").agg(
            F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("n")
        ).select("d1", "d2", F.col("first.doc").alias("leader"), F.col("first.row").alias("row"), "n"),
        "leaders", free=False,
    )
    same = (
        sets.select("doc", "d1", "d2").join(leaders.filter("n > 1").select("d1", "d2", "leader"), ["d1", "d2"])
        .filter("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    )
    shown = steps.keep(
        sets.filter("tokens is not null").join(leaders.select("d1", "d2", "row"), ["d1", "d2", "row"], "left_semi")
        .select("doc", "size", "bits", "tokens", "roots"),
        "shown", free=False,
    )
    entries = steps.keep(
        shown.select("doc", "size", "bits", "tokens", F.posexplode("roots").alias("place", "node")).select(
            "node", F.expr(f"shiftleft(1L, place % {BRANCH})").alias("mask"), "doc", "size",
            F.expr(f"substring(tokens, place div {BRANCH} * {TOKENS} + 1, {TOKENS})").alias("tokens"), "bits",
        ),
        "entries0", free=False,
    )
    fitting, tight = _split(entries, steps, task_sets, tight_sets)
    found = fitting.repartition("node").sortWithinPartitions("node").mapInArrow(_follow, PAIR)
    if tight is not None:
        # Without a group: what fails here is left to the blocks below.
        star = tight.filter("likely").select(
            F.lit(None).cast("bigint").alias("group"), F.least("doc", "p_doc").alias("a"), F.greatest("doc", "p_doc").alias("b")
        )
        found = found.unionByName(star)
    pairs = steps.keep(found, "pairs")
    if tight is None:
        steps.drop("entries0")
    # Only texts with a likely partner are needed from here on; they move once.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    near = steps.keep(texts.join(small_side(wanted, "paths-wanted"), "doc_id", "left_semi"), "near", free=False)
    links = steps.keep(_links(pairs.select("a", "b").distinct(), near).union(same), "links", free=False)
    known = steps.keep(components(links, steps, "known"), "known", free=False)

    # Groups with a pair that failed, and strangers of large nodes: likely pairs across components.
    # Every set with a likely partner has an edge in the forest, so it is in its group.
    labels = known.select(F.col("node").alias("doc"), "component")
    failed = pairs.join(links, ["a", "b"], "left_anti").select("group").distinct()
    again = steps.keep(
        pairs.join(failed, "group", "left_semi").select("group", F.explode(F.array("a", "b")).alias("doc")).distinct()
        .join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc")),
        "again", free=False,
    )
    late = (
        again.join(near.withColumnRenamed("doc_id", "doc"), "doc").select("group", "doc", "label", "text")
        .repartition("group").sortWithinPartitions("group").mapInArrow(_recheck, "a bigint, b bigint")
    )
    if tight is not None:
        wide = steps.keep(
            _across(tight, labels, tight_sets).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"),
            "wide", free=False,
        )
        late = late.union(_links(wide, texts))
    late = steps.keep(late, "late", free=False)
    if late.isEmpty():
        final = known
    else:
        final = steps.keep(components(links.union(late), steps, "final"), "final", free=False)
    known_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    component = F.coalesce(F.when(F.col("component") != NO_ID, F.col("component")), known_id)
    return (
        sets.select("doc", "size").join(final.withColumnRenamed("node", "doc"), "doc", "left")
        .select(
            known_id.alias("doc_id"), F.col("size").cast("bigint").alias("n_shingles"),
            component.alias("component_id"), known_id.eqNullSafe(component).alias("kept"),
        )
    )
