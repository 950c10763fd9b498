"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased in ASCII; their n-grams of 1 to 4 characters are hashed to a fixed
number of buckets. Learning counts (language, bucket) pairs in Spark, so the model has
languages x buckets cells whatever the size of the corpus; it goes to the tasks as one matrix of
log-probabilities. A batch is a sparse matrix, texts by buckets, in rows of bucket numbers; its
product with the model scores all its texts for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelloom.llm.common import BASE, U64, batch_rows, column, mix, pieces

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
#: Texts per language used for learning, in expectation; smaller languages give all theirs.
LEARN_PER_LANGUAGE = 4000
SLICE = 10_000_000  # resolution of the sample


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray  # buckets x languages, log-probabilities


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, A-Z as a-z, and the offsets counted in them."""
    begins = (data & 0xC0) != 0x80
    if begins.all():
        codes = data.astype(np.uint32)
    else:
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(begins)])[offsets]
    return np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes), offsets


def buckets_of(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the ``n``-grams that lie inside of one text, and their texts."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = codes.astype(U64)
    with np.errstate(over="ignore"):
        value = np.full(count, U64(n))
        for i in range(n):
            value = value * BASE + wide[i : i + count]
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(owner)) + np.repeat(offsets[:-1] - np.cumsum(lengths) + lengths, lengths)
    return (mix(value[at]) >> U64(48)).astype(np.int64), owner


def product(bucket: np.ndarray, owner: np.ndarray, table: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` the rows of ``table`` that each text's buckets name."""
    step = max((1 << 22) // max(table.shape[1], 1), 1)
    for lo in range(0, len(bucket), step):
        own = owner[lo : lo + step]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[first]] += np.add.reduceat(table[bucket[lo : lo + step]], first, axis=0, dtype=float)


def learn(
    labelled: DataFrame, per_language: int = LEARN_PER_LANGUAGE, smoothing: float = 0.5
) -> Model:
    """Count n-grams of ``labelled(doc_id, text, lang)``.

    Of each language about ``per_language`` texts are used, chosen by a hash of the id; rows
    with a null or empty language or text teach nothing.
    """
    spark = labelled.sparkSession
    usable = labelled.filter("lang is not null and lang <> '' and text is not null and text <> ''")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    code = F.create_map(*[F.lit(x) for lang in languages for x in (lang, number[lang])])
    keep = F.create_map(
        *[F.lit(x) for lang in languages
          for x in (lang, min(SLICE, int(SLICE * per_language / sizes[lang]) + 1))]
    )
    sample = usable.filter(
        F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(SLICE)) < keep[F.col("lang")]
    ).select(code[F.col("lang")].alias("code"), "text")
    batch_rows(spark)
    width = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, BUCKETS), np.int64)
        for rows, data, offsets in pieces(batches):
            lang_of = np.asarray(column(rows, "code")).astype(np.int64)
            text, cuts = characters(data, offsets)
            for n in SIZES:
                bucket, owner = buckets_of(text, cuts, n)
                key = lang_of[owner] * BUCKETS + bucket
                sums += np.bincount(key, minlength=width * BUCKETS).reshape(width, BUCKETS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lang.astype(np.int32)),
                pa.array(bucket.astype(np.int32)),
                pa.array(sums[lang, bucket]),
            ],
            ["lang", "bucket", "n"],
        )

    counts = (
        sample.mapInArrow(count, "lang int, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    table = np.full((BUCKETS, width), smoothing)
    table[counts["bucket"], counts["lang"]] += counts["n"]
    table = np.log(table / table.sum(axis=0))
    total = sum(sizes.values())
    prior = np.log([sizes[lang] / total for lang in languages])
    return Model(languages, prior, table.astype(np.float32))


def _has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    lower = data | np.uint8(32)
    ascii_letter = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (existing columns of these
    names are replaced).

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or where
    the model knows no language. Ties go to the smaller name. The score is the posterior of
    the winner, with overlapping n-grams counted as one observation.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    kept = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, data, offsets in pieces(batches):
            texts = column(rows, "text")
            total = np.zeros((len(texts), len(known.languages)))
            codes, cuts = characters(data, offsets)
            for n in SIZES if known.languages else ():
                product(*buckets_of(codes, cuts, n), known.table, total)
            total = known.prior + total / len(SIZES)
            names, scores = [], []
            letters = _has_letter(data, offsets, texts)
            for i, letter in enumerate(letters):
                if not letter or not known.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total[i]))
                names.append(known.languages[best])
                scores.append(float(1 / np.exp(total[i] - total[i, best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*rows.schema.names, "lang_pred", "score"],
            )

    schema = StructType(
        [
            *kept.schema.fields,
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
        ]
    )
    return kept.mapInArrow(score, schema)
