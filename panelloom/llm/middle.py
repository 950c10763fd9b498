"""Fill-in-the-middle rewriting of texts by lines, as a pipeline of Arrow kernels.

A batch's texts are split into lists of lines; the lists are flattened, each line with the index
of its text and its ordinal there. Two cut points per text give every line its role. The
lines of one role, filtered out and put back into lists, are joined to one piece per text, and
pieces and marks are joined to the output. No row is handled on its own in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelloom.llm.common import column, pieces

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = [
    ("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()),
    ("middle_chars", LongType()), ("output", StringType()),
]
DRAWS = ["__draw1", "__draw2", "__draw3", "__draw4"]


def draws(seed: int, key: Column) -> list[Column]:
    """Four numbers below 2 ** 32 out of the digest of seed and key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(name)
        for i, name in enumerate(DRAWS)
    ]


def remainder(values: pa.Array, by: pa.Array | int) -> pa.Array:
    by = pa.scalar(by, pa.int64()) if isinstance(by, int) else by
    return pc.subtract(values, pc.multiply(pc.divide(values, by), by))


def lines_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lines of all texts, each with its line end, and the index of each line's text."""
    lists = pc.split_pattern(texts, "\n")
    parent = pc.list_parent_indices(lists)
    parts = pc.list_flatten(lists)
    last = pc.equal(ordinals(parent, len(texts)), pc.subtract(pc.list_value_length(lists), 1).take(parent))
    ended = pc.binary_join_element_wise(parts, pa.scalar("\n", parts.type), pa.scalar("", parts.type))
    lines = pc.if_else(last, parts, ended)
    real = pc.or_(pc.invert(last), pc.greater(pc.binary_length(parts), 0))
    return lines.filter(real), parent.filter(real)


def lengths(parent: pa.Array, texts: int) -> pa.Array:
    """How many entries each of ``texts`` lists has; ``parent`` is ascending."""
    counts = pc.value_counts(parent)
    found = pc.index_in(pa.array(np.arange(texts), parent.type), counts.field("values"))
    return pc.fill_null(counts.field("counts").take(found), 0)


def offsets(parent: pa.Array, texts: int) -> pa.Array:
    sums = pc.cumulative_sum(lengths(parent, texts))
    return pa.concat_arrays([pa.array([0], sums.type), sums])


def ordinals(parent: pa.Array, texts: int) -> pa.Array:
    """Place of every entry in its own list."""
    starts = offsets(parent, texts)
    return pc.subtract(pa.array(np.arange(len(parent)), starts.type), starts.take(parent))


def joined(lines: pa.Array, parent: pa.Array, mask: pa.Array, texts: int) -> pa.Array:
    """The lines under ``mask`` as one string per text."""
    lines, parent = lines.filter(mask), parent.filter(mask)
    lists = pa.LargeListArray.from_arrays(offsets(parent, texts), lines)
    return pc.binary_join(lists, pa.scalar("", lines.type))


def rewrite(
    texts: pa.Array, drawn: list[pa.Array], fim_percent: int, spm_percent: int
) -> list[pa.Array]:
    """The added columns of texts without nulls."""
    texts = texts.cast(pa.large_string())
    size = len(texts)
    lines, parent = lines_of(texts)
    n = lengths(parent, size)
    cuts = [remainder(d, pc.add(n, 1)) for d in drawn[:2]]
    low, high = pc.min_element_wise(*cuts).take(parent), pc.max_element_wise(*cuts).take(parent)
    place = ordinals(parent, size)
    before = pc.less(place, low)
    after = pc.greater_equal(place, high)
    prefix, middle, suffix = (
        joined(lines, parent, mask, size)
        for mask in (before, pc.and_not(pc.invert(before), after), after)
    )
    marked = pc.or_(
        pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)),
        pc.match_substring(texts, MIDDLE),
    )
    plain = pc.or_(
        pc.or_(pc.equal(pc.binary_length(texts), 0), marked),
        pc.greater_equal(remainder(drawn[2], 100), fim_percent),
    )
    spm = pc.less(remainder(drawn[3], 100), spm_percent)
    p, s, m, glue = (pa.scalar(v, texts.type) for v in (PREFIX, SUFFIX, MIDDLE, ""))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, glue)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, glue)
    none = pa.scalar(None, pa.int64())
    return [
        n,
        pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
    ]


def fill_in_middle(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """``docs`` with ``n`` lines, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``
    (code points; null if plain) and ``output``; existing columns of these names are replaced.

    Needs ``doc_id`` and ``text``. Of 100 texts, ``fim_percent`` are rewritten in expectation, and
    ``spm_percent`` of these with the suffix first; which ones, and where the two cuts lie,
    follows from ``seed`` and the id, so equal ids are cut at equal shares of the draws. A null
    text counts as empty and stays plain, as does one that holds a mark; a null id draws as an
    empty one. Texts are taken whole, about two megabytes (or a single text) at a time.
    """
    kept = docs.drop(*[name for name, _ in ADDED], *DRAWS)
    names = kept.columns
    schema = StructType([*kept.schema.fields, *[StructField(n, t) for n, t in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in pieces(batches):
            texts = pc.fill_null(column(batch, "text"), "")
            found = rewrite(texts, [column(batch, d) for d in DRAWS], fim_percent, spm_percent)
            found = [a.cast(pa.string()) if a.type == pa.large_string() else a for a in found]
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, name) for name in names], *found],
                [*names, *[name for name, _ in ADDED]],
            )

    return kept.select("*", *draws(seed, F.col("doc_id"))).mapInArrow(run, schema)


def rebuild(output: pa.Array, form: pa.Array) -> pa.Array:
    """Texts out of outputs and forms: the marks stand once each, in the order of the form."""
    output = output.cast(pa.large_string())
    whole = pc.equal(form, "plain")
    first = pc.equal(form, "spm")
    # Without its first mark, an output is (head, second mark, tail, MIDDLE, middle).
    inner = pc.utf8_slice_codeunits(pc.if_else(whole, "", output), len(PREFIX))
    mark = pc.if_else(first, PREFIX, SUFFIX)
    sides = [_halves(inner, m) for m in (PREFIX, SUFFIX)]
    by_prefix = pc.equal(mark, PREFIX)
    head, rest = (pc.if_else(by_prefix, a, b) for a, b in zip(*sides))
    tail, middle = _halves(rest, MIDDLE)
    prefix, suffix = pc.if_else(first, tail, head), pc.if_else(first, head, tail)
    built = pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar("", output.type))
    return pc.if_else(whole, output, built)


def _halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``mark``; all and nothing without it."""
    parts = pc.split_pattern(texts, mark, max_splits=1)
    short = pc.less(pc.list_value_length(parts), 2)
    blank = pa.array([[""]], parts.type).take(pa.array(np.zeros(len(texts), np.int64)))
    padded = pc.if_else(short, blank, pc.list_slice(parts, 1))
    return pc.list_element(parts, 0), pc.list_element(padded, 0)


def restore(rewritten: DataFrame) -> DataFrame:
    """``rewritten`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone; an
    existing column of this name is replaced. Null outputs stay null."""
    kept = rewritten.drop("restored")
    schema = StructType([*kept.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in pieces(batches, "output"):
            text = rebuild(column(batch, "output"), column(batch, "form")).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "restored"])

    return kept.mapInArrow(run, schema)
