"""Answer distributions in long form: ``(keys, option_idx, option, mass)``.

Answers are first counted per distinct answer text (combined before the
shuffle), so matching and everything after it work on small frames however many
rows one question holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import expr
from panelloom.session import n_rows, one

TINY = 1e-12


# --- catalog and scaffolds ------------------------------------------------

def question_catalog(responses: DataFrame, order: str = "response_id") -> DataFrame:
    """Questions with options by answer index; the first row in ``order`` names each."""
    labels = responses.groupBy("question_id", "answer_index").agg(
        F.min_by(F.struct("answer", "question_text", "question_type"), order).alias("first"),
        F.min(order).alias("at"),
    )
    entry = F.struct(F.col("answer_index"), F.col("first.answer").alias("option"))
    return labels.groupBy("question_id").agg(
        F.min_by("first.question_text", "at").alias("question_text"),
        F.min_by("first.question_type", "at").alias("question_type"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    ).select(
        "question_id", "question_text", "question_type",
        F.transform("entries", lambda e: e["option"]).alias("options"),
    )


def option_table(catalog: DataFrame) -> DataFrame:
    return catalog.select("question_id", F.posexplode("options").alias("option_idx", "option"))


def matched_counts(
    responses: DataFrame,
    catalog: DataFrame,
    rule: str = "exact",
    answer: str = "answer",
    keys: Sequence[str] = (),
    measures: Mapping[str, Column] | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Measures per matched option; unmatched answers drop out, or come under a null
    option with ``keep_unmatched``.

    ``rule`` is ``equal`` (raw text), ``exact`` (trim and case) or
    ``first_substring``. Measures must be sums.
    """
    measures = measures or {"count": n_rows()}
    distinct = responses.groupBy("question_id", *keys, F.col(answer).alias("__answer")).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    joined = distinct.join(catalog.select("question_id", "options"), "question_id")
    if rule == "equal":
        place = F.array_position("options", F.col("__answer"))
        index = F.when(place > 0, (place - 1).cast("int"))
    elif rule == "exact":
        index = expr.match_exact("__answer", "options")
    elif rule == "first_substring":
        index = expr.match_first_substring("__answer", "options")
    else:
        raise ValueError(f"unknown matching rule {rule!r}")
    placed = joined.withColumn("option_idx", index)
    if not keep_unmatched:
        placed = placed.filter("option_idx IS NOT NULL")
    return placed.groupBy("question_id", *keys, "option_idx").agg(
        *[F.sum(name).alias(name) for name in measures]
    )


def scaffold(
    counts: DataFrame, catalog: DataFrame, measures: Sequence[str] = ("count",),
    groups: DataFrame | None = None,
) -> DataFrame:
    """Every option of every question (and group), zero where nothing was counted."""
    frame = option_table(catalog)
    keys = ["question_id", "option_idx"]
    if groups is not None:
        frame = groups.join(frame, "question_id")
        keys = [*groups.columns, "option_idx"]
    return frame.join(counts, keys, "left").na.fill(0, list(measures))


def empirical_counts(
    responses: DataFrame, catalog: DataFrame, cohort: DataFrame | None = None
) -> DataFrame:
    if cohort is not None:
        responses = responses.join(cohort.select("panelist_id"), "panelist_id", "left_semi")
    return scaffold(matched_counts(responses, catalog, "equal"), catalog)


def _normalized(frame: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    return frame.withColumn(name, value / F.sum(value).over(Window.partitionBy(*keys)))


def empirical_target(responses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Historical share per option, floored at 1e-12; uniform without history."""
    return _normalized(
        empirical_counts(responses, catalog), ["question_id"], F.col("count") + TINY, "mass"
    ).drop("count")


def _weight() -> Column:
    w = F.col("expansion_factor")
    return F.when(w.isNull() | (w == 0), 1.0).otherwise(w)


def weighted_cells(
    responses: DataFrame, catalog: DataFrame, dim: str, answer: str = "answer"
) -> DataFrame:
    """Expansion weight per (question, group, option): one scan that serves both the
    overall and the group distributions. Blank groups stay in as null, and so do
    unmatched answers, whose groups must not vanish."""
    value = F.col(dim).cast("string")
    named = responses.withColumn("group", F.when(value != "", value))
    return matched_counts(
        named, catalog, "first_substring", answer, ["group"], {"weight": F.sum(_weight())}, True
    )


def overall_from_cells(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """Weighted shares plus 1e-6 per option, normalized."""
    counts = cells.groupBy("question_id", "option_idx").agg(F.sum("weight").alias("weight"))
    full = scaffold(counts, catalog, ["weight"])
    return _normalized(full, ["question_id"], F.col("weight") + 1e-6, "mass").drop("weight")


def groups_from_cells(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same per group; blank groups drop out."""
    named = cells.filter("`group` IS NOT NULL")
    full = scaffold(named, catalog, ["weight"], named.select("question_id", "group").distinct())
    return _normalized(full, ["question_id", "group"], F.col("weight") + 1e-6, "mass").drop("weight")


def weighted_distribution(responses: DataFrame, catalog: DataFrame, answer: str = "answer") -> DataFrame:
    """Expansion-weighted shares per question."""
    counts = matched_counts(
        responses, catalog, "first_substring", answer, measures={"weight": F.sum(_weight())}
    )
    return overall_from_cells(counts, catalog)


def group_distributions(
    responses: DataFrame, catalog: DataFrame, dim: str = "age_group", answer: str = "answer"
) -> DataFrame:
    """Expansion-weighted shares per question and demographic group."""
    return groups_from_cells(weighted_cells(responses, catalog, dim, answer), catalog)


def conditional_distribution(
    responses: DataFrame, catalog: DataFrame, given: str = "behavioral_archetype"
) -> DataFrame:
    """P(option | group) with half an answer added per option."""
    named = responses.filter(F.col(given).isNotNull())
    counts = matched_counts(named, catalog, "equal", keys=[given])
    groups = named.select("question_id", given).distinct()
    full = scaffold(counts, catalog, ["count"], groups)
    return _normalized(full, ["question_id", given], F.col("count") + 0.5, "mass").drop("count")


def mix_conditionals(conditionals: DataFrame, panelists: DataFrame, given: str = "behavioral_archetype") -> DataFrame:
    """Population mix: sum over groups of group share times P(option | group)."""
    sizes = panelists.filter(F.col(given).isNotNull()).groupBy(given).agg(n_rows().alias("n"))
    shares = sizes.select(given, (F.col("n") / one(sizes, F.sum("n"))).alias("w"))
    return (
        conditionals.join(shares, given)
        .groupBy("question_id", "option_idx", "option")
        .agg(F.sum(F.col("w") * F.col("mass")).alias("mass"))
    )


def align(p: DataFrame, q: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Two distributions side by side; an option on one side only gets zero."""
    on = [*keys, "option_idx"]
    left = p.select(*on, F.col("option").alias("__a"), F.col("mass").alias("p"))
    right = q.select(*on, F.col("option").alias("__b"), F.col("mass").alias("q"))
    return left.join(right, on, "full_outer").select(
        *on, F.coalesce("__a", "__b").alias("option"),
        F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"),
    )


# --- divergences ----------------------------------------------------------

def xlog2(p: Column, m: Column) -> Column:
    return F.when(p > TINY, p * F.log2(p / m)).otherwise(0.0)


def with_shares(pairs: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Normalize ``p`` and ``q`` per key; a negative or massless side gives null
    (``strict``: an error)."""
    w = Window.partitionBy(*keys)

    def share(c: str) -> Column:
        total, low = F.sum(c).over(w), F.min(c).over(w)
        bad = F.raise_error(F.lit("negative or zero mass")).cast("double") if strict else F.lit(None)
        return F.when((low < 0) | (total < TINY), bad).otherwise(F.col(c) / total)

    return pairs.select("*", share("p").alias("ps"), share("q").alias("qs")).drop("p", "q")


def divergences(
    pairs: DataFrame, keys: Sequence[str] = ("question_id",), support: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """JS (base 2), W1, cosine and the entropies of ``p`` per key.

    Without ``support`` options sit one unit apart.
    """
    ordered = Window.partitionBy(*keys).orderBy("option_idx")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    step = F.lit(1.0) if support is None else F.lead(support).over(ordered) - F.col(support)
    last = F.lead(F.lit(1)).over(ordered).isNull()
    ps, qs = F.col("ps"), F.col("qs")
    mid = (ps + qs) / 2
    usable = mid.isNotNull()
    cells = with_shares(pairs, keys, strict).select(
        *keys, "ps", "qs",
        F.when(usable, xlog2(ps, mid) / 2 + xlog2(qs, mid) / 2).alias("js"),
        F.when(
            usable, F.when(last, 0.0).otherwise(F.abs(F.sum(ps - qs).over(upto)) * step)
        ).alias("w1"),
        F.when(ps.isNotNull(), -xlog2(ps, F.lit(1.0))).alias("h"),
    )
    norm = F.sqrt(F.sum(ps * ps)) * F.sqrt(F.sum(qs * qs))
    n = F.count(F.lit(1))

    def clip(x: Column, low: float) -> Column:
        return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(1.0), x)))

    angle = F.when(norm < TINY, 0.0).otherwise(F.sum(ps * qs) / norm)
    return cells.groupBy(*keys).agg(
        clip(F.sum("js"), 0.0).alias("js"),
        F.sum("w1").alias("wasserstein"),
        clip(angle, -1.0).alias("cosine"),
        F.sum("h").alias("entropy"),
        F.when(n < 2, 0.0).otherwise(F.sum("h") / F.log2(n)).alias("normalized_entropy"),
        (F.sum(F.abs(ps - qs)) / 2).alias("total_variation"),
    )


def entropies(
    dist: DataFrame, keys: Sequence[str] = ("question_id",), base: float = 2.0, value: str = "mass"
) -> DataFrame:
    """Shannon entropy in ``base`` and its share of the maximum."""
    if base <= 1.0:
        raise ValueError("entropy base must exceed 1")
    share = F.col(value) / F.sum(value).over(Window.partitionBy(*keys))
    h = F.sum(F.when(F.col("s") > TINY, -F.col("s") * F.ln("s")).otherwise(0.0))
    n = F.count(F.lit(1))
    return dist.withColumn("s", share).groupBy(*keys).agg(
        (h / F.ln(F.lit(base))).alias("entropy"),
        F.when(n < 2, 0.0).otherwise(h / F.ln(n)).alias("normalized_entropy"),
    )


def parity_gap(groups: DataFrame, overall: DataFrame, keys: Sequence[str] = ("question_id", "group")) -> DataFrame:
    """Total variation between each group and the overall distribution."""
    base = overall.select("question_id", "option_idx", F.col("mass").alias("overall"))
    return groups.join(base, ["question_id", "option_idx"]).groupBy(*keys).agg(
        (F.sum(F.abs(F.col("mass") - F.col("overall"))) / 2).alias("gap")
    )


def cdf(dist: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Running share in option order: each option owns ``[cdf_lo, cdf_hi)``."""
    w = Window.partitionBy(*keys).orderBy("option_idx").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("mass").over(w)
    return dist.withColumn("cdf_hi", hi).withColumn("cdf_lo", F.col("cdf_hi") - F.col("mass"))


# --- per-question results --------------------------------------------------

def question_results(
    responses: DataFrame, catalog: DataFrame, answer: str = "answer"
) -> DataFrame:
    """Counts and percentages per option with entropy and valid counts."""
    counts = scaffold(matched_counts(responses, catalog, "exact", answer), catalog)
    valid = F.col("is_valid") if "is_valid" in responses.columns else F.lit(True)
    totals = responses.groupBy("question_id").agg(
        n_rows().alias("total_responses"),
        F.count_if(F.coalesce(valid, F.lit(True))).alias("valid_responses"),
    )
    w = Window.partitionBy("question_id")
    matched = F.sum("count").over(w)
    share = F.when(matched > 0, F.col("count") / matched)
    h = F.sum(F.when(share > TINY, -share * F.log2(share)).otherwise(0.0)).over(w)
    size = F.count(F.lit(1)).over(w)
    return counts.join(totals, "question_id", "left").select(
        "question_id", "option_idx", "option", F.col("count").cast("bigint").alias("count"),
        F.bround(F.coalesce(100 * share, F.lit(0.0)), 1).alias("percentage"),
        F.coalesce("total_responses", F.lit(0)).alias("total_responses"),
        F.coalesce("valid_responses", F.lit(0)).alias("valid_responses"),
        F.bround(h, 3).alias("entropy"),
        F.bround(F.when(size < 2, 0.0).otherwise(h / F.log2(size)), 3).alias("normalized_entropy"),
    )


# --- uncertainty ----------------------------------------------------------

def category_uncertainty(responses: DataFrame, catalog: DataFrame, answer: str = "answer") -> DataFrame:
    """Mean clipped uncertainty per chosen option; ``1 - confidence`` when absent."""
    fallback = 1.0 - F.coalesce(F.col("confidence"), F.lit(0.5))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("uncertainty"), fallback)))
    counts = matched_counts(
        responses, catalog, "first_substring", answer, measures={"total": F.sum(value), "n": n_rows()}
    )
    full = scaffold(counts, catalog, ["total", "n"])
    return full.select(
        "question_id", "option_idx", "option",
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("uncertainty"),
    )


def sample_uncertainty(samples: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalized entropy of repeated answers per key, capped at 1."""
    per = samples.groupBy(*keys, "question_id", "answer").agg(n_rows().alias("n"))
    # Entropy from sums alone: H = ln(T) - sum(n ln n) / T.
    h = per.groupBy(*keys, "question_id").agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("nlogn")
    )
    sizes = catalog.select("question_id", F.size("options").alias("k"))
    entropy = F.greatest(F.lit(0.0), F.ln("t") - F.col("nlogn") / F.col("t"))
    return h.join(sizes, "question_id").select(
        *keys, "question_id",
        F.when(F.col("k") < 2, 0.0).otherwise(F.least(F.lit(1.0), entropy / F.ln("k"))).alias(
            "uncertainty"
        ),
    )


def distribution_uncertainty(dist: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    return entropies(dist.withColumn("mass", F.col("mass")), keys).select(
        *keys,
        F.coalesce(F.least(F.lit(1.0), F.col("normalized_entropy")), F.lit(0.0)).alias("uncertainty"),
    )


# --- breakdowns -----------------------------------------------------------

def breakdown_cells(responses: DataFrame, dims: Sequence[str], answer: str = "answer") -> DataFrame:
    """Counts by (question, dimension, group, answer) for all dimensions in one scan.

    Rows are first counted over the combination of all dimensions; only those
    cells are unpivoted. Null groups drop out, as in a cross tabulation.
    """
    joint = responses.groupBy("question_id", F.col(answer).alias("answer"), *dims).agg(n_rows().alias("n"))
    long = joint.select(
        "question_id", "answer", "n", *[F.col(d).cast("string").alias(d) for d in dims]
    ).unpivot(["question_id", "answer", "n"], list(dims), "dimension", "group")
    return (
        long.filter("`group` IS NOT NULL AND answer IS NOT NULL")
        .groupBy("question_id", "dimension", "group", "answer")
        .agg(F.sum("n").alias("n"))
    )


def contingency(responses: DataFrame, catalog: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Option by group tables of every dimension, zero-filled, options only."""
    cells = breakdown_cells(responses, dims)
    groups = cells.select("question_id", "dimension", "group").distinct()
    frame = groups.join(option_table(catalog), "question_id")
    keyed = cells.withColumnRenamed("answer", "option")
    return frame.join(keyed, ["question_id", "dimension", "group", "option"], "left").na.fill(0, ["n"])


def breakdown_pct(responses: DataFrame, catalog: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Column percentages per group over all of its responses."""
    cells = breakdown_cells(responses.fillna({"answer": ""}), dims)
    totals = cells.groupBy("question_id", "dimension", "group").agg(F.sum("n").alias("total"))
    frame = totals.join(option_table(catalog), "question_id")
    keyed = cells.withColumnRenamed("answer", "option")
    return frame.join(keyed, ["question_id", "dimension", "group", "option"], "left").select(
        "question_id", "dimension", expr.humanize("group").alias("group"), "option_idx", "option",
        (100 * F.coalesce(F.col("n"), F.lit(0)) / F.greatest(F.col("total"), F.lit(1))).alias("pct"),
    )


def cohort_summary(cohort: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Percentages per value of each attribute; a missing value reads ``unknown``."""
    joint = cohort.groupBy(*attributes).agg(n_rows().alias("n"))
    long = joint.select(
        "n", *[F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias(a) for a in attributes]
    ).unpivot(["n"], list(attributes), "attribute", "value")
    total = one(joint, F.sum("n"))
    return long.groupBy("attribute", "value").agg(F.sum("n").alias("n")).select(
        "attribute", "value", "n", F.bround(F.col("n") / total * 100, 1).alias("percentage")
    )


def benchmark_distributions(
    df: DataFrame, questions: Sequence[str], source: str, version: str, group: str | None = "age_group"
) -> DataFrame:
    """Share per option over answered rows, sample size over all rows of the group."""
    has_group = group is not None and group in df.columns
    keyed = df.withColumn(
        "demographic_group", F.col(group).cast("string") if has_group else F.lit("all")
    ).filter("demographic_group IS NOT NULL")
    long = keyed.select(
        "demographic_group", *[F.col(q).cast("string").alias(q) for q in questions]
    ).unpivot(["demographic_group"], list(questions), "question_id", "option")
    counts = long.groupBy("question_id", "demographic_group", "option").agg(n_rows().alias("n"))
    w = Window.partitionBy("question_id", "demographic_group")
    answered = F.sum(F.when(F.col("option").isNotNull(), F.col("n"))).over(w)
    return counts.select(
        F.lit(source).alias("source"), F.lit(version).alias("version"), "question_id",
        "demographic_group", "option", (F.col("n") / answered).alias("share"),
        F.sum("n").over(w).alias("sample_size"),
    ).filter("option IS NOT NULL")


def joint_distribution(pairs: DataFrame, a: str = "index_a", b: str = "index_b") -> DataFrame:
    cells = pairs.groupBy(a, b).agg(n_rows().alias("n"))
    return cells.withColumn("share", F.col("n") / one(cells, F.sum("n")))
