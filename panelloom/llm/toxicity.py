"""Toxicity: a factorization machine over hashed terms.

Each distinct word of a text gives terms: itself, and its character 4- and 5-grams with marks
at its ends. Terms are hashed to a fixed number of buckets; every bucket has a weight and a
short vector, and the score adds all weights and the inner products of all pairs of terms:
pairs that matter only together (an insult next to a mentioned group) get their say, which a
linear model cannot give them. All buckets are learnt: a bucket's share in the two labels only
sets the step of its weight and the least step of its vector, so terms that tell nothing alone
keep a vector. Learning takes place on the driver over a bounded sample of distinct texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from panelloom.llm.common import Steps, batch_rows, column, settled

BUCKETS = 1 << 18
FACTORS = 6
#: Distinct labelled texts used for learning, in expectation, of each label, and their terms in
#: all: where the texts are so long that they have more, fewer of both labels are used.
LEARN_PER_LABEL = 4000
LEARN_TERMS = 32_000_000
#: Parts in which the features come to the driver, and terms of one gradient step.
READS = 32
STEP_TERMS = 1 << 20
#: Steps of a weight: least and most, with the fourth power of its gap over so many standard
#: errors between; and the least step of a vector, whatever the gap.
STEADY_GAP, LEAST_STEP, MOST_STEP = 4.5, 0.03, 4.0
LEAST_VECTOR_STEP = 0.1
#: A bucket and its count in a text are sent as one number; larger counts are sent in parts.
COUNT_LIMIT = 1 << 13
SLICE = 10_000_000
CACHE = 200_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray  # those that take part
    weights: np.ndarray  # one of each
    vectors: np.ndarray  # FACTORS of each


def constant(bias: float) -> Model:
    return Model(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def terms_of(word: str) -> list[int]:
    """Buckets of a word."""
    marked = f"^{word}$"
    grams = {marked}
    for n in (4, 5):
        grams.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return sorted({zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams})


def words_in(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Scorer:
    """Sums of a word's terms, remembered for the words met last."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # Weight, squared length and vector of every bucket.
        self.table = np.zeros((BUCKETS, 2 + FACTORS))
        self.table[model.buckets, 0] = model.weights
        self.table[model.buckets, 1] = (model.vectors**2).sum(axis=1)
        self.table[model.buckets, 2:] = model.vectors
        self.sums = np.zeros((1024, 2 + FACTORS))
        self.known: dict[str, int] = {}

    def _meet(self, words: list[str]) -> None:
        """Sums of words not met yet."""
        terms = [terms_of(word) for word in words]
        starts = np.cumsum([0, *map(len, terms)])[:-1]
        first = len(self.known)
        while first + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        flat = [t for own in terms for t in own]
        self.sums[first : first + len(words)] = np.add.reduceat(self.table[flat], starts, axis=0)
        self.known.update(zip(words, range(first, first + len(words))))

    def score(self, text: str) -> float:
        if len(self.known) >= CACHE:
            self.known.clear()
        words = sorted(words_in(text))
        new = [word for word in words if word not in self.known]
        if new:
            self._meet(new)
        at = [self.known[word] for word in words]
        total = self.sums[at].sum(axis=0) if at else np.zeros(2 + FACTORS)
        margin = self.model.bias + total[0] + 0.5 * ((total[2:] ** 2).sum() - total[1])
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def _terms(text: str, known: dict[str, list[int]]) -> list[int]:
    """Buckets of all terms of the distinct words; a term of several words comes several times."""
    found: list[int] = []
    for word in sorted(words_in(text)):
        own = known.get(word)
        if own is None:
            if len(known) >= CACHE:
                known.clear()
            own = known[word] = terms_of(word)
        found += own
    return found


def _steps(starts: np.ndarray, slot: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Steps of a bucket's weight and vector: short where most texts have it; the weight's is
    longer the further its shares in the two labels lie apart."""
    texts, ones = len(labels), max(labels.sum(), 1e-9)
    zeros = max(texts - labels.sum(), 1e-9)
    held, toxic = np.zeros(size), np.zeros(size)
    for lo in range(0, texts, 256):
        hi = min(lo + 256, texts)
        part = slot[starts[lo] : starts[hi]]
        held += np.bincount(part, minlength=size)
        toxic += np.bincount(part, np.repeat(labels[lo:hi], np.diff(starts[lo : hi + 1])), size)
    share = (held + 1) / (texts + 2)
    error = np.sqrt(share * (1 - share) * (1 / ones + 1 / zeros)) + 1e-12
    gap = np.abs(toxic / ones - (held - toxic) / zeros) / error
    idf = np.maximum(np.log((texts + 1) / (held + 1)), 0) / np.log(texts + 1)
    weight = 0.5 * idf**2 * (LEAST_STEP + np.minimum((gap / STEADY_GAP) ** 4, MOST_STEP))
    vector = np.maximum(weight, LEAST_VECTOR_STEP * np.maximum(1 - held / (texts + 1), 0))
    return np.stack([weight, *[vector] * FACTORS], axis=1).astype(np.float32)


def fit(
    starts: np.ndarray, slot: np.ndarray, count: np.ndarray, labels: np.ndarray, used: np.ndarray,
    epochs: int = 12, least_rounds: int = 200, rate: float = 0.05, decay: float = 1e-4,
    batch: int = 256, seed: int = 7,
) -> Model:
    """Adaptive gradient steps on the logistic loss. ``slot`` and ``count`` list the terms of
    text after text, by place in the buckets ``used``, from ``starts`` on. Labels may be shares.
    A step takes ``batch`` texts, or fewer if these have more than ``STEP_TERMS`` terms."""
    rng = np.random.default_rng(seed)
    texts = len(labels)
    scale = _steps(starts, slot, labels, len(used))
    params = np.zeros((len(used), 1 + FACTORS), np.float32)
    params[:, 1:] = rng.normal(0, 0.01, (len(used), FACTORS))
    speed = np.full(params.shape, 1e-6, np.float32)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, bias_speed = float(np.log(share / (1 - share))), 1e-6
    for _ in range(max(epochs, -(-least_rounds * batch // max(texts, 1)))):
        order = rng.permutation(texts)
        for chosen in _batches(order, np.diff(starts)[order], batch):
            lengths = starts[chosen + 1] - starts[chosen]
            # Texts without a term have the bias alone.
            bare, chosen, lengths = chosen[lengths == 0], chosen[lengths > 0], lengths[lengths > 0]
            total = len(bare) + len(chosen)
            first = np.cumsum(lengths) - lengths
            error = np.zeros(0)
            if len(chosen):
                at = np.repeat(starts[chosen] - first, lengths) + np.arange(lengths.sum())
                row = np.repeat(np.arange(len(chosen)), lengths)
                ids, n = slot[at], count[at].astype(np.float32)
                by = np.argsort(ids, kind="stable")
                heads = np.flatnonzero(np.diff(ids[by], prepend=-1))
                own = ids[by][heads]
                pos = np.empty(len(ids), np.int64)
                pos[by] = np.repeat(np.arange(len(own)), np.diff(heads, append=len(ids)))
                local, step = params[own], scale[own]
                x = (local * step)[pos]
                part = n[:, None] * x
                sums = np.add.reduceat(part, first)
                squares = np.add.reduceat((part[:, 1:] * x[:, 1:]).sum(axis=1), first)
                margin = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
                error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[chosen]
                pull = (error[row] * n).astype(np.float32)
                slope = np.empty_like(x)
                slope[:, 0] = pull
                slope[:, 1:] = pull[:, None] * (sums[row, 1:] - x[:, 1:])
                grad = np.add.reduceat(slope[by], heads) / total * step + decay * local
                speed[own] += grad**2
                params[own] = local - rate * grad / np.sqrt(speed[own])
            alone = 1 / (1 + np.exp(-bias)) - labels[bare]
            lean = float((error.sum() + alone.sum()) / total)
            bias_speed += lean**2
            bias -= rate * lean / np.sqrt(bias_speed)
    learnt = params.astype(float) * scale
    return Model(bias, used, learnt[:, 0].copy(), learnt[:, 1:].copy())


def _part(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text, their buckets and counts, and shares; equal texts come once."""
    _, first = np.unique(np.asarray(rows.column("digest")), return_index=True)
    rows = rows.take(pa.array(first))
    lists = rows.column("terms").combine_chunks()
    packed = np.asarray(lists.flatten())
    lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    slot, count = packed // COUNT_LIMIT, packed % COUNT_LIMIT + 1
    return lengths, slot.astype(np.uint32), count.astype(np.uint16), np.asarray(rows.column("share"))


def _batches(order: np.ndarray, lengths: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    upto = np.cumsum(lengths)
    lo = 0
    while lo < len(order):
        before = upto[lo] - lengths[lo]
        hi = int(np.searchsorted(upto, before + STEP_TERMS, "right"))
        hi = min(max(hi, lo + 1), lo + batch)
        yield order[lo:hi]
        lo = hi


def learn(docs: DataFrame, labels: DataFrame, per_label: int = LEARN_PER_LABEL) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``.

    Equal texts count once, with the share of toxic ones among their labels. About
    ``per_label`` distinct texts of each kind (by the larger share) are used, chosen by a hash of
    the text; this bounded list goes to the texts, which therefore stay where they are. Rows
    with a null label, id or text teach nothing; of several labels of a document the largest
    counts. Their terms are bounded too (``LEARN_TERMS``), so the driver's memory is. Without both labels the model is constant (near 0 or 1, or one half without rows).
    """
    marks = (
        labels.filter("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    if marks.isEmpty():
        return constant(0.0)
    texts = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    distinct = (
        texts.select("doc_id", "digest").join(marks, "doc_id").groupBy("digest")
        .agg(F.avg("toxic").alias("share"), F.min("doc_id").alias("doc_id"))
        .withColumn("toxic", (F.col("share") >= 0.5).cast("int"))
    )
    steps = Steps(docs.sparkSession, "toxicity")
    distinct = steps.keep(distinct, "distinct")
    sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        kinds = sizes or {r["toxic"] for r in marks.select("toxic").distinct().collect()}
        return constant({(0,): -5.0, (1,): 5.0}.get(tuple(kinds), 0.0))
    shares = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, int(SLICE * shares[1])).otherwise(int(SLICE * shares[0]))
    chosen = distinct.filter(
        F.pmod(F.xxhash64(F.lit("toxicity"), F.col("digest")), F.lit(SLICE)) < limit
    ).select("doc_id", "digest", "share")
    batch_rows(docs.sparkSession)
    sample = texts.join(F.broadcast(chosen), ["doc_id", "digest"]).select("digest", "share", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            terms = []
            for text in column(batch, "text").to_pylist():
                bucket, n = np.unique(np.array(_terms(text, known), np.int64), return_counts=True)
                part = -(-n // COUNT_LIMIT)
                bucket, left = np.repeat(bucket, part), np.repeat(n, part)
                left -= COUNT_LIMIT * (np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part))
                terms.append((bucket * COUNT_LIMIT + np.minimum(left, COUNT_LIMIT) - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "digest"), column(batch, "share"), pa.array(terms, pa.list_(pa.int32()))],
                ["digest", "share", "terms"],
            )

    kept = steps.keep(
        sample.mapInArrow(settled(features), "digest bigint, share double, terms array<int>"), "features", free=False
    )
    terms = kept.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    if terms > LEARN_TERMS:  # the draw of the digest again, so that a part of each label goes
        kept = kept.filter(
            F.pmod(F.xxhash64(F.lit("terms"), F.col("digest")), F.lit(SLICE)) < int(SLICE * LEARN_TERMS / terms)
        )
    found = [
        _part(kept.filter(F.pmod("digest", F.lit(READS)) == i).select("digest", "share", "terms").toArrow())
        for i in range(READS)
    ]
    lengths, slot, count, labels_of = (np.concatenate(c) for c in zip(*found))
    del found
    if not len(lengths):
        return constant(0.0)
    held = np.zeros(BUCKETS, bool)
    held[slot] = True
    place = (np.cumsum(held) - 1).astype(np.uint32)
    for lo in range(0, len(slot), STEP_TERMS):
        slot[lo : lo + STEP_TERMS] = place[slot[lo : lo + STEP_TERMS]]
    model = fit(np.concatenate([[0], np.cumsum(lengths)]), slot, count, labels_of, np.flatnonzero(held))
    # Undo the sampling of labels, so that 0.5 means as likely as not in all distinct texts.
    return replace(model, bias=float(model.bias + np.log(shares[0] / shares[1])))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on);
    existing columns of these names are replaced. Null and empty texts get the model's bias."""
    spark = docs.sparkSession
    batch_rows(spark)
    kept = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            scores = [scorer.score(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                [*batch.schema.names, "score", "predicted"],
            )

    schema = StructType(
        [
            *kept.schema.fields,
            StructField("score", DoubleType()),
            StructField("predicted", IntegerType()),
        ]
    )
    return kept.mapInArrow(settled(score), schema)
