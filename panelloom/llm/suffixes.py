"""Removal of repeated byte strings by column-wise suffix sorting of the whole collection.

The suffixes that matter are windows of ``LENGTH`` bytes. Each window belongs to its anchor, the
``K`` bytes in it with the smallest hash (the leftmost of equals); neighbouring windows of one
anchor form a string of at most ``2 * LENGTH - K`` bytes. Equal windows have equal anchors, so
the collection falls into independent parts by anchor, which the shuffle deals out: anchors
that occur once are done, and equal strings are kept once, with the smallest document.

The more text there is, the more anchors meet by chance. A window reaches ``SIDE`` bytes or more
beyond its anchor on the left, or else on the right, so a string falls into two halves, and a half
is asked only if another document's string has the anchor together with its ``SIDE`` bytes there.

Of the strings that remain, a task builds the Burrows-Wheeler transform column by column: each
round takes one more symbol of every string, from its end on, puts it at the place of the
string's last suffix, and inserts the suffix that begins with it at the rank that the transform
itself gives (its smaller symbols, and equal symbols before it). Common prefixes are updated for
each inserted suffix and its neighbours. Runs of suffixes that share ``LENGTH`` bytes then tell,
for each window, the smallest document that has it. The sequential files of the construction are
the shuffled and stored tables between the steps, in the folder that all executors share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelloom.llm.common import (
    BASE,
    PIECE_BYTES,
    U64,
    Steps,
    as_bytes,
    batch_rows,
    column,
    gram_hashes,
    mix,
    pieces,
    powers,
    settled,
    sliding_min,
)
from panelloom.llm.packed import FLUSH_ENTRIES, Packer, gather, schema, send

LENGTH = 50
K = 16
WINDOWS = LENGTH - K + 1
#: Anchors with more different strings than this are split by their sides, and halves whose side has
#: more by window.
HOT_STRINGS = 2048
#: Strings of one construction, at least; all of an anchor are in the same.
CHUNK = 1024
#: A window reaches so many bytes beyond its anchor, on the left or on the right.
SIDE = -(-(LENGTH - K) // 2)
#: What is asked of a string: its left and right half; halves that go apart; halves that go by window.
LEFT, RIGHT, APART, LEFT_HOT, RIGHT_HOT = 1, 2, 4, 8, 16
LOW48 = U64((1 << 48) - 1)
LOW24 = PLACE = U64((1 << 24) - 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
NO_ID = -(2**63)
ENTRY = {
    "h": np.uint64, "x": np.uint64, "doc": np.int64, "start": np.int32, "count": np.uint8,
    "tag": np.uint16, "left": np.uint32, "right": np.uint32, "anchor": np.uint8,
}
COVERED = {"doc": np.int64, "start": np.int32, "count": np.uint8, "tag": np.uint16}


def _powers(n: int, cache: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the next piece."""
    if len(cache.get("up", ())) < n:
        cache["up"] = powers(n)
        with np.errstate(over="ignore"):
            down = np.full(n, INVERSE)
            down[0] = 1
            cache["down"] = np.multiply.accumulate(down)
    return cache["up"][:n], cache["down"][:n]


def _half(anchor: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Windows of the left half: those that begin ``SIDE`` bytes or more before the anchor."""
    return np.clip(anchor - SIDE + 1, 0, count)


def strings_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, string hash, text number, start in its text and number of windows of every
    string, then 24 bits of the hash of its anchor with ``SIDE`` bytes to the left, of that with
    those to the right (of any bytes where the half has no windows), and the anchor's place in
    it; texts under ``LENGTH`` bytes have none."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    none = (empty.astype(U64), empty.astype(U64), *[empty] * 6)
    if n < LENGTH:
        return none
    grams = gram_hashes(data, K)
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=U64)
    place = (sliding_min(key, WINDOWS) & PLACE).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge)[: len(place)])
    if not len(at):
        return none
    anchor = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])
    # Between the windows of two texts there are others that are not valid: runs end there.
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    end = start + count - 1 + LENGTH
    anchor = anchor[first]
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        whole = (sums[end] - sums[start]) * down[start]
        whole = mix(whole + count.astype(U64))
        lo = np.maximum(anchor - SIDE, start)
        left = mix((sums[anchor + K] - sums[lo]) * down[lo]) & LOW24
        right = mix((sums[np.minimum(anchor + K + SIDE, end)] - sums[anchor]) * down[anchor]) & LOW24
    owner = np.searchsorted(offsets, start, "right") - 1
    return grams[anchor], whole, owner, start - offsets[owner], count, left, right, anchor - start


def _sliced(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """``strings_of``; a text longer than a piece is taken in overlapping parts."""
    if len(data) <= 2 * PIECE_BYTES:
        yield strings_of(data, offsets)
        return
    for lo in range(0, len(data), PIECE_BYTES):
        part = data[lo : lo + PIECE_BYTES + LENGTH - 1]
        h, x, owner, start, *rest = strings_of(part, np.array([0, len(part)]))
        yield h, x, owner, start + lo, *rest


def _tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two bytes of each text's digest: they tell rows that repeat an id apart."""
    raw = data.tobytes()
    return np.array(
        [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=2).digest(), "big")
         for a, b in zip(offsets[:-1], offsets[1:])],
        np.uint16,
    )


def _later(h: np.ndarray, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Strings that a smaller document has too: anchor's and string's hashes are equal."""
    order = np.lexsort((x, h))
    new = (np.diff(h[order]) != 0) | (np.diff(x[order]) != 0)
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    least = np.minimum.reduceat(doc[order], first)
    lengths = np.diff(np.concatenate([first, [len(x)]]))
    later = np.zeros(len(x), bool)
    later[order] = doc[order] > np.repeat(least, lengths)
    return later


def _index(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, covered = Packer(0, ENTRY, len(ENTRY)), Packer(1, COVERED, len(ENTRY))
        held: list[tuple] = []
        size, turn = 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            h, x, doc, start, count, tag, *sides = (np.concatenate(c) for c in zip(*held))
            h, x = h & LOW48, x & LOW48
            later = _later(h, x, doc)
            covered.add((doc[later] % parts).astype(np.int32), doc[later], start[later], count[later], tag[later])
            own = ~later
            packer.add(
                (mix(h[own]) % U64(parts)).astype(np.int32),
                h[own], x[own], doc[own], start[own], count[own], tag[own], *[v[own] for v in sides],
            )
            yield from packer.flush()
            yield from covered.flush()

        for rows, data, offsets in pieces(batches):
            docs = np.asarray(column(rows, "doc_id"))
            tags = _tags(data, offsets)
            for h, x, owner, start, count, *sides in _sliced(data, offsets):
                sides = [v.astype(ENTRY[name]) for v, name in zip(sides, ("left", "right", "anchor"))]
                held.append((h, x, docs[owner], start, count, tags[owner], *sides))
                size += len(h)
            if size >= FLUSH_ENTRIES:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


FOUND = (
    "doc bigint, tag int, start int, count int, h bigint, wanted boolean, anchor int, "
    "sides int, starts array<int>"
)


def asked_sides(
    anchors: np.ndarray, docs: np.ndarray, strings: dict[str, np.ndarray], hot_strings: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per string, whether a smaller document has its anchor with the same side, and which halves
    another document's string can share a window with (``LEFT``, ``RIGHT`` and so on; 0: none).
    ``anchors`` numbers the anchors; ``docs`` has each string's smallest document."""
    wanted = np.zeros(len(anchors), bool)
    sides, crowded = np.zeros(len(anchors), np.int32), np.zeros(len(anchors), np.int32)
    count = strings["count"].astype(np.int64)
    half = _half(strings["anchor"].astype(np.int64), count)
    for name, here, bit, hot in (("left", half > 0, LEFT, LEFT_HOT), ("right", half < count, RIGHT, RIGHT_HOT)):
        at = np.flatnonzero(here)
        if not len(at):
            continue
        key = (anchors[at].astype(U64) << U64(24)) | strings[name][at].astype(U64)
        order = np.lexsort((docs[at], key))
        at, key = at[order], key[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        later = docs[at] > np.repeat(docs[at[first]], sizes)
        wanted[at[later]] = True
        mixed = np.repeat(np.logical_or.reduceat(later, first), sizes)
        sides[at[mixed]] |= bit
        crowded[at[mixed & np.repeat(sizes > hot_strings, sizes)]] |= hot
    strings_left = np.bincount(anchors[sides > 0], minlength=int(anchors.max(initial=-1)) + 1)
    apart = (sides > 0) & (strings_left[anchors] > hot_strings)
    return wanted, np.where(apart, sides | crowded | APART, sides)


def _shared(hot_strings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings known to repeat one of a smaller document, and the strings to be sorted: those
        with a half that another document's string can share a window with."""
        found = gather(batches, {0: ENTRY, 1: COVERED})
        c = found[1]
        yield from _rows(c["doc"], c["tag"], c["start"], c["count"])
        e = found[0]
        if not len(e["h"]):
            return
        order = np.lexsort((e["start"], e["tag"], e["doc"], e["x"], e["h"]))
        e = {name: value[order] for name, value in e.items()}
        new_h = np.concatenate([[True], np.diff(e["h"]) != 0])
        new_x = new_h | np.concatenate([[True], np.diff(e["x"]) != 0])
        x_at = np.flatnonzero(new_x)
        x_of, h_of = np.cumsum(new_x) - 1, np.cumsum(new_h) - 1
        least_x = e["doc"][x_at]
        later = e["doc"] > least_x[x_of]
        yield from _rows(e["doc"][later], e["tag"][later], e["start"][later], e["count"][later])
        one = {name: e[name][x_at] for name in ("count", "left", "right", "anchor")}
        wanted, sides = asked_sides(h_of[x_at], least_x, one, hot_strings)
        keep = ~later & (sides > 0)[x_of]
        if not keep.any():
            return
        at = np.flatnonzero(keep)
        # Occurrences of a string in one text become one row.
        same = np.zeros(len(at), bool)
        same[1:] = (x_of[at[1:]] == x_of[at[:-1]]) & (e["tag"][at[1:]] == e["tag"][at[:-1]])
        head = np.flatnonzero(~same)
        for lo in range(0, len(head), 1 << 15):
            hi = min(lo + (1 << 15), len(head))
            ends = np.concatenate([head, [len(at)]])
            part = at[head[lo:hi]]
            span = at[ends[lo] : ends[hi]]
            lists = pa.ListArray.from_arrays(
                pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(e["start"][span])
            )
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(e["doc"][part]),
                    pa.array(e["tag"][part].astype(np.int32)),
                    pa.nulls(n, pa.int32()),
                    pa.array(e["count"][part].astype(np.int32)),
                    pa.array(e["h"][part].view(np.int64)),
                    pa.array(wanted[x_of[part]]),
                    pa.array(e["anchor"][part].astype(np.int32)),
                    pa.array(sides[x_of[part]]),
                    lists,
                ],
                [f.split()[0] for f in FOUND.split(", ")],
            )

    return run


def _rows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(doc), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        n = len(doc[part])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[part]),
                pa.array(tag[part].astype(np.int32)),
                pa.array(start[part]),
                pa.array(count[part].astype(np.int32)),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.bool_()),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.list_(pa.int32())),
            ],
            [f.split()[0] for f in FOUND.split(", ")],
        )


STRING = "h bigint, doc bigint, tag int, shift int, starts array<int>, wanted boolean, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked halves, out of their texts. Halves of a hot anchor are dealt out by anchor
    and side, and those of a hot side are cut into windows, dealt out by the window; in a batch the
    smallest document stands for a window, and what others have is known to repeat it (a row
    without bytes)."""
    for batch in batches:
        asked = column(batch, "asked")
        h, count, wanted, anchor, sides, starts = asked.flatten().flatten()
        bounds = np.asarray(asked.offsets) - asked.offsets[0].as_py()
        first = np.asarray(pc.list_element(starts, 0))
        count, anchor, sides = np.asarray(count), np.asarray(anchor), np.asarray(sides)
        half = _half(anchor, count)
        docs, tags = np.asarray(column(batch, "doc")), np.asarray(column(batch, "tag"))
        data, offsets = as_bytes(column(batch, "text"))
        raws = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        own = _tags(data[offsets[0] : offsets[-1]], offsets - offsets[0]) == tags
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))

        def rows(at: np.ndarray, key: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
            """Windows ``lo`` to ``hi`` of the strings ``at``."""
            size = hi - lo + LENGTH - 1
            found = [
                raws[i][a : a + n]
                for i, a, n in zip(owner[at].tolist(), (first[at] + lo).tolist(), size.tolist())
            ]
            pick = pa.array(at)
            return pa.RecordBatch.from_arrays(
                [
                    key, pa.array(docs[owner[at]]), pa.array(tags[owner[at]]),
                    pa.array(lo.astype(np.int32)), starts.take(pick), wanted.take(pick),
                    pa.array(found, pa.binary()),
                ],
                [f.split()[0] for f in STRING.split(", ")],
            )

        apart = (sides & APART) > 0
        plain = np.flatnonzero(own[owner] & ~apart)
        lo = np.where((sides & LEFT) > 0, 0, half)[plain]
        yield rows(plain, h.take(pa.array(plain)), lo, np.where((sides & RIGHT) > 0, count, half)[plain])
        spans: list[tuple[int, int, int]] = []
        for bit, hot, lo, hi, core in (
            (LEFT, LEFT_HOT, np.zeros_like(half), half, anchor - SIDE),
            (RIGHT, RIGHT_HOT, half, count, anchor),
        ):
            split = own[owner] & apart & ((sides & bit) > 0)
            whole = np.flatnonzero(split & ((sides & hot) == 0))
            if len(whole):
                keys = [
                    _digest(raws[i][a : a + K + SIDE], bytes([bit]))
                    for i, a in zip(owner[whole].tolist(), (first + core)[whole].tolist())
                ]
                yield rows(whole, pa.array(keys, pa.int64()), lo[whole], hi[whole])
            at = np.flatnonzero(split & ((sides & hot) > 0))
            spans += zip(at.tolist(), lo[at].tolist(), hi[at].tolist())
        if spans:
            yield _windows(spans, owner, first, raws, docs, tags, starts, wanted)


def _digest(raw: bytes, kind: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=kind).digest(), "big", signed=True)


def _windows(spans, owner, first, raws, docs, tags, starts, wanted) -> pa.RecordBatch:
    by_window: dict[bytes, list[tuple[int, int]]] = {}
    for at, begin, end in spans:
        raw, lo = raws[owner[at]], int(first[at])
        for shift in range(begin, end):
            by_window.setdefault(raw[lo + shift : lo + shift + LENGTH], []).append((at, shift))
    rows: list[tuple] = []
    for window, places in by_window.items():
        least = min(int(docs[owner[at]]) for at, _ in places)
        h = _digest(window)
        shown = False
        for at, shift in places:
            repeats = int(docs[owner[at]]) > least
            asks = wanted[at].as_py()
            if not asks and (repeats or shown):
                continue
            shown |= not repeats
            rows.append((h, int(docs[owner[at]]), int(tags[owner[at]]), shift,
                         starts[at].as_py(), asks, None if repeats else window))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(zip(*rows), kinds)],
        [f.split()[0] for f in STRING.split(", ")],
    )


def smallest_documents(data: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every window of every string, string after string, the smallest document with it."""
    n = len(lengths)
    width = int(lengths.max())
    matrix = np.zeros((n, width), np.uint8)  # right-aligned
    ends = np.cumsum(lengths)
    shift = np.arange(1, n + 1) * width - ends
    matrix.ravel()[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    flat = matrix.ravel()
    # The transform holds symbols moved up by one; 0: no symbol yet.
    used = np.unique(matrix)
    code = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    bwt = np.zeros(n, code.dtype)
    who = np.arange(n, dtype=np.int32)
    size = np.zeros(n, np.uint8 if width < 256 else np.uint32)
    prefix = np.zeros(n, np.uint8)
    rank = np.arange(n)
    reach = np.arange(LENGTH)
    for number in range(1, width + 1):
        active = np.flatnonzero(lengths >= number)
        bwt[rank[active]] = code[matrix[active, width - number]]
        order = np.argsort(bwt, kind="stable")
        place = np.empty(len(bwt), np.int64)
        place[order] = np.arange(len(bwt))
        blank = int((bwt == 0).sum())
        new = place[rank[active]] - blank + n
        rank[active] = new
        total = len(bwt) + len(active)
        old = np.ones(total, bool)
        old[new] = False

        def spread(values: np.ndarray, inserted: np.ndarray | int) -> np.ndarray:
            out = np.empty(total, values.dtype)
            out[old] = values
            out[new] = inserted
            return out

        bwt, who, size, prefix = (
            spread(bwt, 0), spread(who, active), spread(size, number), spread(prefix, 0)
        )
        if number >= LENGTH:
            changed = np.unique(np.concatenate([new, new + 1]))
            changed = changed[changed < total]
            changed = changed[(size[changed] >= LENGTH) & (size[changed - 1] >= LENGTH)]
            for lo in range(0, len(changed), 1 << 14):
                right = changed[lo : lo + (1 << 14)]
                a = who[right - 1].astype(np.int64) * width + width - size[right - 1]
                b = who[right].astype(np.int64) * width + width - size[right]
                differ = flat[a[:, None] + reach] != flat[b[:, None] + reach]
                prefix[right] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    first = np.flatnonzero(prefix < LENGTH)
    least = np.minimum.reduceat(docs[who], first)
    least = np.repeat(least, np.diff(np.concatenate([first, [len(who)]])))
    long = np.flatnonzero(size >= LENGTH)
    order = long[np.lexsort((-size[long].astype(np.int64), who[long]))]
    return least[order]


HIT = "doc bigint, tag int, start int, mask bigint"


def _hits(rows: pa.Table, mask: np.ndarray) -> pa.RecordBatch:
    """One row per start of the rows with a mask."""
    at = np.flatnonzero(mask)
    starts = rows.column("starts").combine_chunks().take(pa.array(at))
    sizes = np.diff(np.asarray(starts.offsets))
    doc, tag = (np.asarray(rows.column(c))[at] for c in ("doc", "tag"))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(doc, sizes)), pa.array(np.repeat(tag, sizes)), starts.flatten(),
            pa.array(np.repeat(mask[at], sizes)),
        ],
        [f.split()[0] for f in HIT.split(", ")],
    )


def _solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    one = np.int64(1)
    known = rows.filter(pc.is_null(rows.column("bytes")))
    if known.num_rows:
        yield _hits(known, one << np.asarray(known.column("shift")).astype(np.int64))
    rows = rows.filter(pc.is_valid(rows.column("bytes")))
    if not rows.num_rows:
        return
    strings = rows.column("bytes").cast(pa.large_binary()).combine_chunks()
    data = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
    lengths = np.asarray(pc.binary_length(strings)).astype(np.int64)
    h, docs = np.asarray(rows.column("h")), np.asarray(rows.column("doc"))
    shift = np.asarray(rows.column("shift")).astype(np.int64)
    wanted = np.asarray(rows.column("wanted").combine_chunks().cast(pa.uint8())) > 0
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.flatnonzero(np.diff(h)) + 1
    mask = np.zeros(len(h), np.int64)
    lo = 0
    while lo < len(h):
        later = cuts[np.searchsorted(cuts, lo + CHUNK) :]
        hi = int(later[0]) if len(later) else len(h)
        least = smallest_documents(data[ends[lo] : ends[hi]], lengths[lo:hi], docs[lo:hi])
        count = lengths[lo:hi] - LENGTH + 1
        first = np.cumsum(count) - count
        place = np.arange(len(least)) - np.repeat(first, count) + np.repeat(shift[lo:hi], count)
        repeats = least < np.repeat(docs[lo:hi], count)
        mask[lo:hi] = np.add.reduceat(np.where(repeats, one << place, 0), first)
        lo = hi
    mask[~wanted] = 0
    yield _hits(rows, mask)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of ``h``; a construction takes whole anchors."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 8 * CHUNK:
            rows = pa.Table.from_batches(held)
            h = np.asarray(rows.column("h"))
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield from _solve(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = rows.num_rows - cut
    if size:
        yield from _solve(pa.Table.from_batches(held))


RESULT = [
    ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"),
    ("kept_sha256", "string"),
]


def _windows_of(marks: pa.ListArray, tags: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Which bytes a removed window starts at, out of the marks of all texts."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(marks), 0))
    row = np.repeat(np.arange(len(marks)), lengths)
    start, mask, tag = (np.asarray(a) for a in marks.flatten().flatten())
    own = tag == tags[row]
    at = (offsets[row] + start)[own]
    mask = mask[own]
    first = np.zeros(n, bool)
    shift = 0
    while len(at):
        first[at[(mask & 1) > 0] + shift] = True
        mask = mask >> 1
        left = mask > 0
        at, mask, shift = at[left], mask[left], shift + 1
    return first


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            marks = column(rows, "marks")
            marked = np.asarray(pc.fill_null(pc.list_value_length(marks), 0)) > 0
            tags = np.zeros(rows.num_rows, np.int64)
            for i in np.flatnonzero(marked).tolist():
                tags[i] = _tags(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])[0]
            sums = np.zeros(len(data) + LENGTH + 1, np.int32)
            np.cumsum(_windows_of(marks, tags, offsets, len(data)), out=sums[LENGTH + 1 :])
            # A byte goes if one of the windows that may cover it does; none reaches over a text's end.
            gone = sums[LENGTH + 1 :] > sums[1 : len(data) + 1]
            count = np.concatenate([[0], np.cumsum(gone)])
            n_removed = np.diff(count[offsets])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            cuts = offsets[:-1][np.diff(offsets) > 0]
            begins[cuts] = gone[cuts]
            n_spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
            raw, keep = data.tobytes(), ~gone
            kept = [
                (data[a:b][keep[a:b]].tobytes() if n else raw[a:b])
                for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n_removed.tolist())
            ]
            columns = {name: column(rows, name) for name in rows.schema.names if name != "marks"}
            if keep_text:
                changed = pa.array(n_removed > 0)
                short = [k.decode("utf-8", "ignore") if n else None for k, n in zip(kept, n_removed)]
                columns["text"] = pc.if_else(changed, pa.array(short, pa.string()), columns["text"].cast(pa.string()))
            values = (
                np.diff(offsets), n_removed, n_spans, [hashlib.sha256(k).hexdigest() for k in kept]
            )
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), *[pa.array(v, k) for v, k in zip(values, kinds)]],
                [*columns, *[name for name, _ in RESULT]],
            )

    return run


def remove_repeats(
    docs: DataFrame, keep_text: bool = False, hot_strings: int = HOT_STRINGS
) -> DataFrame:
    """Remove every byte covered by a 50-byte string that starts in a document with a smaller
    ``doc_id`` too; all strings are judged on the input.

    Needs ``doc_id`` and ``text``. All columns of ``docs`` are kept, and ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept_sha256`` added (columns of these names are replaced).
    With ``keep_text`` the text is what remains, as text: bytes of a character that was cut
    are dropped there, while the digest is over all remaining bytes. Null texts count as empty.
    A null ``doc_id`` is smaller than any other. Rows that repeat an id do not remove from
    each other, whether their texts agree or not.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "suffixes")
    batch_rows(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    texts = docs.select(key.alias("doc_id"), "text")
    blocks = texts.mapInArrow(settled(_index(parts)), schema(len(ENTRY)))
    found = steps.keep(send(blocks, parts).mapInArrow(settled(_shared(hot_strings)), FOUND), "found")
    wanted = (
        found.filter("h is not null")
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("h", "count", "wanted", "anchor", "sides", "starts")).alias("asked"))
    )
    strings = (
        wanted.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
        .select("doc", "tag", "asked", "text")
        .mapInArrow(settled(_fetch), STRING)
    )
    hits = steps.keep(
        strings.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(settled(_sort), HIT), "hits"
    )
    every = F.expr("shiftleft(1L, count) - 1")
    marks = (
        found.filter("h is null").select("doc", "tag", "start", every.alias("mask"))
        .union(hits)
        .groupBy(F.col("doc").alias("__key"))
        .agg(F.collect_list(F.struct("start", "mask", "tag")).alias("marks"))
    )
    added = [name for name, _ in RESULT]
    kept = docs.drop(*added, "marks")
    marked = kept.withColumn("__key", key).join(marks, "__key", "left").drop("__key")
    kinds = [StructField(n, LongType() if t == "bigint" else StringType()) for n, t in RESULT]
    return marked.select(*kept.columns, "marks").mapInArrow(
        settled(_cut(keep_text)), StructType([*kept.schema.fields, *kinds])
    )
