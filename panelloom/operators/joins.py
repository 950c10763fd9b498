"""Joins with panel meaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.ranking import first_rows
from panelloom.session import n_rows, one


def pair_answers(responses: DataFrame, question_a: str, question_b: str) -> DataFrame:
    """Respondents who answered both questions, with both answer positions.

    One scan: both answers land in one group per respondent, no self join.
    """
    def at(q: str) -> F.Column:
        return F.max(F.when(F.col("question_id") == q, F.col("answer_index")))

    both = responses.filter(F.col("question_id").isin(question_a, question_b))
    return (
        both.groupBy("panelist_id")
        .agg(at(question_a).alias("index_a"), at(question_b).alias("index_b"))
        .filter("index_a IS NOT NULL AND index_b IS NOT NULL")
    )


def join_reference(panel: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Reference groups with the panel's share; groups only in the panel are ignored."""
    counts = panel.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("group")).agg(
        n_rows().alias("n")
    )
    shares = counts.select("group", (F.col("n") / one(counts, F.sum("n"))).alias("panel_share"))
    return reference.join(shares, "group", "left").na.fill(0.0, ["panel_share"])


def attach_first(
    results: DataFrame, evidence: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Left join on the first evidence row per key, null where there is none."""
    return results.join(first_rows(evidence, keys, order), list(keys), "left")
