"""Encoding to and decoding from SentencePiece ids, by streaming Viterbi.

The vocabulary comes from a given model file; it is not trained here. The file ranks its pieces
by merge order, so a piece of rank r is taken to be as likely as a word of rank r
(log-probability -log(r + 2), less a constant), and the best segmentation is the one with the
highest sum. Characters without a piece fall back to one id per UTF-8 byte. A space is
written as U+2581; a U+2581 of the text itself goes by bytes, so decoding gives back every
text exactly. Nothing is normalized and no space is added.

The search keeps the last ``longest piece`` positions only. Whenever all paths that can still
win pass through one boundary, the ids before it are final and are handed out, so memory does not
grow with the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from panelloom.llm.common import batch_rows, column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BYTE_COST = 14.0  # per byte: dearer than any piece
CACHE = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their ids and scores, and the ids of the 256 bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    trie: dict  # character: (score of the piece that ends here or None, further characters)
    bytes: tuple[int, ...]
    longest: int
    breaks_at_space: bool  # no piece has a space mark after another character

    def decoder(self) -> dict[int, bytes]:
        table = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        table.update({i: bytes([b]) for b, i in enumerate(self.bytes)})
        return table


def from_pieces(pieces: list[str], byte_ids: list[int], first: int = 0) -> Vocabulary:
    """A vocabulary of ``pieces`` in order of rank; ids count from ``first``."""
    ids = {p: first + r for r, p in enumerate(pieces)}
    scores = {p: -math.log(r + 2) - 1.0 for r, p in enumerate(pieces)}
    trie: dict = {}
    for piece, score in scores.items():
        kids = trie
        for char in piece[:-1]:
            kids = kids.setdefault(char, (None, {}))[1]
        kids[piece[-1]] = (score, kids.get(piece[-1], (None, {}))[1])
    inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
    return Vocabulary(ids, scores, trie, tuple(byte_ids), max(map(len, pieces), default=1), not inner)


def load(path: str = MODEL) -> Vocabulary:
    """Vocabulary of a model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = [
        i for i in range(size)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    ]
    byte_ids = {model.id_to_piece(i): i for i in special if model.is_byte(i)}
    first = max(special, default=-1) + 1
    pieces = [model.id_to_piece(i) for i in range(first, size)]
    return from_pieces(pieces, [byte_ids[f"<0x{b:02X}>"] for b in range(256)], first)


def viterbi(text: str, vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of ``text`` (spaces already marked, a literal mark as U+FFFF0), in runs that are final.

    Every boundary is reached by its best last piece, of equals the longest. ``best`` and
    ``back`` hold the boundaries from ``done`` on: score, and start of the last piece.
    """
    trie, longest = vocabulary.trie, vocabulary.longest
    size = len(text)
    done = 0
    best, back = [0.0], [0]
    for start in range(size):
        here = best[start - done]
        at, kids = start - done, trie
        while len(best) < min(at + longest, size - done) + 1:
            best.append(NEVER)
            back.append(0)
        for char in text[start : start + longest]:
            node = kids.get(char)
            if node is None:
                break
            score, kids = node
            at += 1
            if score is not None and here + score > best[at]:
                best[at], back[at] = here + score, start
        at = start - done + 1
        if best[at] == NEVER or text[start] not in vocabulary.ids:
            score = here + _byte_score(text[start])
            if score > best[at]:
                best[at], back[at] = score, start
        if start - done >= 2 * longest:
            # Later pieces begin after start - longest: where do the paths to there meet?
            live = set(range(start - longest + 1, start + 1))
            while len(live) > 1:
                last = max(live)
                live.discard(last)
                live.add(back[last - done] if last > done else done)
            meet = live.pop()
            if meet > done:
                yield _path(text, back, done, meet, vocabulary)
                shift = best[meet - done]  # scores stay small however long the text is
                best = [b - shift for b in best[meet - done :]]
                back = back[meet - done :]
                done = meet
    if size > done:
        yield _path(text, back, done, size, vocabulary)


NEVER = -math.inf


def _raw(char: str) -> bytes:
    return (SPACE if char == LITERAL else char).encode()


def _byte_score(char: str) -> float:
    return -BYTE_COST * len(_raw(char))


LITERAL = "\U000FFFF0"  # stands for a space mark that the text itself holds


def _path(text: str, back: list[int], lo: int, hi: int, vocabulary: Vocabulary) -> list[int]:
    steps, at = [], hi
    while at > lo:
        start = back[at - lo]
        piece = text[start:at]
        own = vocabulary.ids.get(piece)
        steps.append([own] if own is not None else [vocabulary.bytes[b] for b in _raw(piece)])
        at = start
    return [i for own in reversed(steps) for i in own]


class Encoder:
    """Encodes texts; remembers words where no piece can cross the space before them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, list[int]] = {}

    def word(self, marked: str) -> list[int]:
        found = self.known.get(marked)
        if found is None:
            if len(marked) > 64:
                return [i for run in viterbi(marked, self.vocabulary) for i in run]
            found = self._short(marked)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[marked] = found
        return found

    def _short(self, text: str) -> list[int]:
        """The same search where the whole text fits into the window."""
        trie, own = self.vocabulary.trie, self.vocabulary.ids
        size = len(text)
        best = [NEVER] * (size + 1)
        back = [0] * (size + 1)
        best[0] = 0.0
        for start in range(size):
            here, at, kids = best[start], start, trie
            for char in text[start:]:
                node = kids.get(char)
                if node is None:
                    break
                score, kids = node
                at += 1
                if score is not None and here + score > best[at]:
                    best[at] = here + score
                    back[at] = start
            if best[start + 1] == NEVER or text[start] not in own:
                score = here + _byte_score(text[start])
                if score > best[start + 1]:
                    best[start + 1], back[start + 1] = score, start
        return _path(text, back, 0, size, self.vocabulary)

    def encode(self, text: str) -> list[int]:
        if LITERAL in text or not self.vocabulary.breaks_at_space:
            return self._whole(text)
        marked = text.replace(SPACE, LITERAL)
        out: list[int] = []
        if "  " in marked:  # runs of spaces belong together with the word after them
            parts, run = [], ""
            first, *rest = marked.split(" ")
            if first:
                parts.append(first)
            for word in rest:
                run += SPACE
                if word:
                    parts.append(run + word)
                    run = ""
            if run:
                parts.append(run)
        else:
            first, *rest = marked.split(" ")
            parts = ([first] if first else []) + [SPACE + w for w in rest]
        word, known = self.word, self.known
        for part in parts:
            out += known.get(part) or word(part)
        return out

    def _whole(self, text: str) -> list[int]:
        """No shortcut: character by character, literal marks and their stand-in by bytes."""
        out: list[int] = []
        for i, part in enumerate(_split(text, (SPACE, LITERAL))):
            if i % 2:
                out += [self.vocabulary.bytes[b] for b in part.encode()]
            else:
                for run in viterbi(part.replace(" ", SPACE), self.vocabulary):
                    out += run
        return out


def _split(text: str, marks: tuple[str, ...]) -> list[str]:
    """Text between single marks, and the marks, in turn."""
    parts, held = [], []
    for c in text:
        if c in marks:
            parts += ["".join(held), c]
            held = []
        else:
            held.append(c)
    return [*parts, "".join(held)]


ADDED = [
    ("n_tokens", LongType()), ("ids", ArrayType(IntegerType())), ("ids_sha256", StringType()),
    ("decoded_sha256", StringType()), ("round_trip", BooleanType()),
]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_tokens``, ``ids``, digests of the ids (as
    little-endian 32-bit numbers) and of the decoded bytes, and ``round_trip`` (decoding gives
    the text). Null and empty texts have no ids and decode to nothing. Columns with these
    names are replaced. ``model`` is read on the driver; its pieces go to the tasks.
    """
    batch_rows(docs.sparkSession)
    vocabulary = load(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.drop(*[name for name, _ in ADDED])
    rest = [f for f in kept.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        table = shared.value.decoder()
        for batch in batches:
            lengths, values, ids_sha, text_sha, same = [0], [], [], [], []
            for text in column(batch, "text").to_pylist():
                text = text or ""
                found = encoder.encode(text)
                raw = b"".join(map(table.__getitem__, found))
                own = pa.array(found, pa.int32())
                values.append(own)
                lengths.append(lengths[-1] + len(own))
                data = own.buffers()[1]
                ids_sha.append(hashlib.sha256(data.to_pybytes()[: 4 * len(own)] if data else b"").hexdigest())
                text_sha.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == text.encode())
            flat = pa.concat_arrays(values) if values else pa.array([], pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)
            counts = [b - a for a, b in zip(lengths, lengths[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *[column(batch, f.name) for f in rest],
                    pa.array(counts, pa.int64()), ids, pa.array(ids_sha, pa.string()),
                    pa.array(text_sha, pa.string()), pa.array(same, pa.bool_()),
                ],
                [*[f.name for f in rest], *[name for name, _ in ADDED]],
            )

    schema = StructType([*rest, *[StructField(name, kind) for name, kind in ADDED]])
    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns of ``tokens`` with ``text``, decoded from ``ids`` (null stays null; an id that
    the vocabulary does not know, and bytes that are no UTF-8, become U+FFFD)."""
    batch_rows(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))
    kept = tokens.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.decoder()
        bad = "�".encode()
        for batch in batches:
            texts = [
                None if ids is None
                else b"".join(table.get(i, bad) for i in ids).decode("utf-8", "replace")
                for ids in column(batch, "ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"]
            )

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("text", StringType())]))
