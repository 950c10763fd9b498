import math

import pytest
from pyspark.sql import functions as F

from panelloom.functions import expr, screens, tails
from panelloom.sources import panel


def values(df, column):
    return [r[column] for r in df.collect()]


def test_price_edges_fall_on_opposite_sides(spark):
    df = spark.createDataFrame([(1.99,), (2.0,), (5.0,), (10.0,), (20.0,), (25.0,)], "p double")
    out = df.select(expr.price_bin("p").alias("bin"), expr.price_tier("p").alias("tier"))
    assert values(out, "bin") == ["budget", "value", "mid", "premium", "luxury", "luxury"]
    assert values(out, "tier") == ["budget", "budget", "value", "mid", "premium", "luxury"]


def test_price_tier_of_missing_and_negative(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.0,)], "p double")
    assert values(df.select(expr.price_tier("p").alias("t")), "t") == ["nan", "nan", "budget"]


def test_matching_rules_differ(spark):
    options = ["Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree"]
    df = spark.createDataFrame(
        [(" AGREE ", options), ("disagree", options), ("I would say: Agree", options), ("maybe", options)],
        "a string, o array<string>",
    )
    out = df.select(
        expr.match_exact("a", "o").alias("exact"),
        expr.match_first_substring("a", "o").alias("near"),
        expr.is_valid_option("a", "o").alias("valid"),
    )
    assert values(out, "exact") == [3, 1, None, None]
    assert values(out, "near") == [3, 1, 3, None]
    assert values(out, "valid") == [True, True, True, False]


def test_first_option_wins_among_substring_hits(spark):
    df = spark.createDataFrame([("agree!", ["Disagree", "Agree"])], "a string, o array<string>")
    # "disagree" does not occur in "agree!", "agree" does.
    assert df.select(expr.match_first_substring("a", "o").alias("i")).first()["i"] == 1


def test_equal_numbers_with_leading_zeros_are_valid(spark):
    df = spark.createDataFrame([("007", ["7"])], "a string, o array<string>")
    assert df.select(expr.is_valid_option("a", "o").alias("v")).first()["v"]


def test_cohort_equality_of_unknown_columns(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.filter(expr.cohort_equals(df, {"zz": ""})).count() == 1
    assert df.filter(expr.cohort_equals(df, {"zz": "1"})).count() == 0
    assert df.filter(expr.cohort_equals(df, {"b": "None"})).count() == 1


@pytest.mark.parametrize(
    "text,kind",
    [
        ("How likely are you to buy?", "net_promoter"),
        ("Do you agree?", "likert_5"),
        ("Rank these brands", "ranking"),
        ("Which store?", "single_choice"),
    ],
)
def test_question_type_from_words(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    spec = df.select(expr.question_spec(F.lit("oops"), "t").alias("s")).first()["s"]
    assert spec["question_type"] == kind
    assert len(spec["options"]) == {"net_promoter": 11, "ranking": 0}.get(kind, 5)


def test_question_spec_from_json(spark):
    raw = '```json\n{"question_type": "nonsense", "options": ["a", "b"]}\n```'
    df = spark.createDataFrame([(raw, "Do you agree?")], "j string, t string")
    spec = df.select(expr.question_spec("j", "t").alias("s")).first()["s"]
    assert (spec["question_type"], spec["options"]) == ("single_choice", ["a", "b"])


def test_prompt_clauses(spark):
    df = spark.createDataFrame(
        [("Q?", ["a", "b"], "ctx", ["x"])], "q string, o array<string>, c string, p array<string>"
    )
    text = df.select(expr.question_prompt("q", "o", "c", "p").alias("t")).first()["t"]
    assert "Response Options:\n  1. a\n  2. b" in text
    assert "Context: ctx" in text and "  Q1: x" in text


def test_display_ids(spark):
    df = spark.createDataFrame([("Unilever", "2026-08-01"), ("Nobody", "2026-02-01")], "c string, d string")
    out = df.select(
        expr.survey_id(F.lit(2026), F.lit(142)).alias("s"),
        expr.contract_id("c", F.to_date("d"), F.lit(47)).alias("k"),
    )
    assert values(out, "s")[0] == "SRV-2026-00142"
    assert values(out, "k") == ["NIQ-UNI-2026-Q3-047", "NIQ-GEN-2026-Q1-047"]


def exact_tail(x, k):
    h = x / 2
    if k % 2 == 0:
        return sum(math.exp(-h) * h**j / math.factorial(j) for j in range(k // 2))
    tail = math.erfc(math.sqrt(h))
    return tail + sum(math.exp(-h) * h ** (j - 0.5) / math.gamma(j + 0.5) for j in range(1, (k + 1) // 2))


def test_chi_square_tail(spark):
    cases = [(x, k) for x in (0.1, 1.0, 3.84, 10.0, 40.0) for k in (1, 2, 3, 4, 7, 16)]
    df = spark.createDataFrame(cases, "x double, k int").withColumn("p", tails.chi2_sf("x", "k"))
    for row in df.collect():
        assert row["p"] == pytest.approx(exact_tail(row["x"], row["k"]), abs=1e-12)


@pytest.mark.parametrize(
    "statistic, dof",
    [(2000.0, 2000), (1600.0, 1501), (5.0, 1), (100.0, 101), (60.0, 1), (0.0, 3), (7.5, 4)],
)
def test_chi_square_tail_in_log_space(spark, statistic, dof):
    x = statistic / 2
    if x == 0:
        want = 1.0
    elif dof % 2 == 0:
        want = sum(math.exp(-x + j * math.log(x) - math.lgamma(j + 1)) for j in range(dof // 2))
    else:
        want = math.erfc(math.sqrt(x)) + sum(
            math.exp(-x + (j - 0.5) * math.log(x) - math.lgamma(j + 0.5))
            for j in range(1, (dof - 1) // 2 + 1)
        )
    row = spark.createDataFrame([(statistic, dof)], "x double, k int").select(
        tails.chi2_sf("x", "k").alias("p")
    ).first()
    assert abs(row["p"] / want - 1) < 1e-8


def test_erfc_keeps_its_digits(spark):
    values = [0.0, 0.1, 0.9, 1.99, 2.01, 3.5, 5.0, 10.0, 25.0]
    df = spark.createDataFrame([(v,) for v in values], "z double")
    for r in df.select("z", tails.erfc(df["z"]).alias("e")).collect():
        assert abs(r["e"] / math.erfc(r["z"]) - 1) < 1e-9


def test_scans_and_texts_are_not_cut(spark):
    df = spark.range(10_050).selectExpr("string(id) panelist_id")
    assert panel.scan_panelists(df).count() == 10_050
    long = "x" * 5000
    row = spark.createDataFrame([(long,)], "t string").select(
        screens.sanitize("t").alias("all"), screens.sanitize("t", 2000).alias("cut")
    ).first()
    assert len(row["all"]) == 5000 and len(row["cut"]) == 2000
