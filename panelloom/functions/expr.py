"""Column expressions: bins, labels, matching rules and display forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom import schemas

LikeCol = str | Column


def col(c: LikeCol) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: LikeCol) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm(c: LikeCol) -> Column:
    return F.lower(strip(c))


# --- price ---------------------------------------------------------------

def price_bin(price: LikeCol) -> Column:
    """Left-closed edges: 2.00 is already ``value``."""
    p = col(price)
    return (
        F.when(p < 2.0, "budget")
        .when(p < 5.0, "value")
        .when(p < 10.0, "mid")
        .when(p < 20.0, "premium")
        .otherwise("luxury")
    )


def price_tier(price: LikeCol) -> Column:
    """Right-closed edges: 2.00 is still ``budget``; missing or negative is ``nan``."""
    p = col(price)
    return (
        F.when(p.isNull() | F.isnan(p) | (p < 0.0), "nan")
        .when(p <= 2.0, "budget")
        .when(p <= 5.0, "value")
        .when(p <= 10.0, "mid")
        .when(p <= 20.0, "premium")
        .otherwise("luxury")
    )


def behavior_token(category: LikeCol, price: LikeCol, promo: LikeCol) -> Column:
    flag = F.when(F.coalesce(col(promo), F.lit(False)), "promo").otherwise("no_promo")
    return F.concat_ws("|", col(category), price_bin(price), flag)


# --- scales and labels ---------------------------------------------------

def normalize_scale(value: LikeCol, scale: Sequence[str]) -> Column:
    return F.when(col(value).isin(list(scale)), col(value)).otherwise("unknown")


def scale_position(value: LikeCol, scale: Sequence[str]) -> Column:
    """0-based position on the scale, null when off it."""
    place = F.array_position(F.array(*[F.lit(v) for v in scale]), col(value).cast("string"))
    return F.when(place > 0, (place - 1).cast("int"))


def humanize(c: LikeCol) -> Column:
    return F.initcap(F.regexp_replace(col(c).cast("string"), "_", " "))


def size_bucket(n: LikeCol) -> Column:
    c = col(n)
    return (
        F.when(c <= 50, "1-50").when(c <= 100, "51-100").when(c <= 500, "101-500").otherwise("500+")
    )


def archetype_name(cluster: LikeCol) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in schemas.ARCHETYPES.items() for x in kv])
    return labels[col(cluster).cast("int")]


def flag_over_budget(tokens: LikeCol, budget: int = 512) -> Column:
    return F.coalesce(col(tokens), F.lit(0)) > budget


# Display id formats and client codes.
SURVEY_ID_FORMAT = "SRV-%d-%05d"
CONTRACT_ID_FORMAT = "NIQ-%s-%d-Q%d-%03d"
CLIENT_CODES = {
    "Unilever": "UNI", "Procter & Gamble": "PG", "Nestlé": "NES", "PepsiCo": "PEP",
    "Coca-Cola": "KO", "Mondelēz": "MDLZ", "Mars": "MARS", "Colgate-Palmolive": "CL",
    "Reckitt": "RKT", "Internal Research": "INT",
}


def survey_id(year: LikeCol, sequence: LikeCol) -> Column:
    return F.format_string(SURVEY_ID_FORMAT, col(year), col(sequence))


def contract_id(client: LikeCol, on: LikeCol, sequence: LikeCol) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in CLIENT_CODES.items() for x in kv])
    code = F.coalesce(codes[col(client)], F.lit("GEN"))
    return F.format_string(
        CONTRACT_ID_FORMAT, code, F.year(col(on)), F.quarter(col(on)), col(sequence)
    )


# --- the three answer-matching rules (kept apart on purpose) --------------

def match_exact(answer: LikeCol, options: LikeCol) -> Column:
    """0-based option index by equality after trim and lower case, else null."""
    place = F.array_position(F.transform(col(options), norm), norm(answer))
    return F.when(place > 0, (place - 1).cast("int"))


def match_first_substring(answer: LikeCol, options: LikeCol) -> Column:
    """Exact match wins; otherwise the first option containing, or contained in,
    the answer; otherwise null."""
    a = norm(answer)
    lowered = F.transform(col(options), norm)
    exact = F.array_position(lowered, a)
    hits = F.transform(lowered, lambda o: F.contains(a, o) | F.contains(o, a))
    near = F.array_position(hits, F.lit(True))
    return F.when(exact > 0, (exact - 1).cast("int")).when(near > 0, (near - 1).cast("int"))


def is_valid_option(answer: LikeCol, options: LikeCol) -> Column:
    """Any option equal, containing or contained, or the same whole number.

    Equal numbers differ only by leading zeros, so containment covers them.
    """
    a = norm(answer)
    return F.exists(
        col(options), lambda o: F.contains(a, norm(o)) | F.contains(norm(o), a)
    )


# --- cohort filters ------------------------------------------------------

def cohort_lists(filters: Mapping[str, Sequence[str]]) -> Column:
    """AND over dimensions of ``value in list``; an empty list keeps all."""
    keep = F.lit(True)
    for name, values in filters.items():
        if values:
            keep = keep & F.col(name).isin(list(values))
    return keep


def cohort_equals(df: DataFrame, filters: Mapping[str, object]) -> Column:
    """AND of string equality. An unknown column reads as the empty string; truth
    values read ``True`` and ``False``, missing ones ``None``."""
    types = dict(df.dtypes)
    keep = F.lit(True)
    for name, wanted in filters.items():
        have = F.lit("")
        if name in types:
            text = F.col(name).cast("string")
            have = F.coalesce(F.initcap(text) if types[name] == "boolean" else text, F.lit("None"))
        keep = keep & (have == F.lit(str(wanted)))
    return keep


# --- persona text --------------------------------------------------------

# The sentences of the prompt texts, here and below.
def demographic_sentence() -> Column:
    children = F.when(F.col("has_children"), "with children").otherwise("without children")
    return F.concat(
        F.lit("A "), F.col("age_group"), F.lit(" year old "), F.col("employment_status"),
        F.lit(" person from a "), F.col("region"), F.lit(" area, living in a household of "),
        F.col("household_size"), F.lit(" "), children, F.lit(". Education: "),
        F.col("education_level"), F.lit(". Income level: "), F.col("income_group"), F.lit("."),
    )


def profile_sentence() -> Column:
    """Demographic clause of the persona prompt, with defaults for missing attributes."""
    def part(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    children = F.when(F.col("has_children"), " including children under 18").otherwise("")
    return F.concat(
        F.lit("You are a "), part("age_group", "25-34"), F.lit(" year old person from the "),
        part("region", "suburban"), F.lit(" United States. Your household has "),
        part("household_size", "2"), F.lit(" members"), children,
        F.lit(". Your education level is "), part("education_level", "bachelors"),
        F.lit(" and your household income is "), part("income_group", "middle"), F.lit("."),
    )


def question_prompt(text: LikeCol, options: LikeCol, context: LikeCol, prior: LikeCol) -> Column:
    """User prompt: question, then the optional clauses that apply."""
    def numbered(items: Column, mark: str, end: str) -> Column:
        return F.array_join(
            F.transform(
                items,
                lambda item, i: F.concat(
                    F.lit("  " + mark), (i + 1).cast("string"), F.lit(end + " "), item
                ),
            ),
            "\n",
        )

    opts, ctx, earlier = col(options), col(context), col(prior)
    # Clause headings of the prompt text.
    return F.concat(
        F.lit("Survey Question: "), col(text),
        F.when(
            F.size(opts) > 0, F.concat(F.lit("\n\nResponse Options:\n"), numbered(opts, "", "."))
        ).otherwise(""),
        F.when(
            F.coalesce(F.length(ctx), F.lit(0)) > 0, F.concat(F.lit("\n\nContext: "), ctx)
        ).otherwise(""),
        F.when(
            F.size(earlier) > 0,
            F.concat(
                F.lit("\n\nYour previous answers in this survey:\n"),
                numbered(earlier, "Q", ":"),
                F.lit(
                    "\n\nEnsure your answer is logically consistent with your previous responses."
                ),
            ),
        ).otherwise(""),
    )


# --- question type -------------------------------------------------------

# Keywords and default options per question type.
TYPE_KEYWORDS = [
    ("net_promoter", ["how likely", "recommend", "nps"]),
    ("likert_5", ["agree", "disagree", "important", "satisfied"]),
    ("ranking", ["rank", "order", "prioritize"]),
]
DEFAULT_OPTIONS = {
    "net_promoter": [str(i) for i in range(11)],
    "likert_5": ["Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree"],
    "ranking": [],
    "single_choice": [
        "Very likely", "Somewhat likely", "Neutral", "Somewhat unlikely", "Very unlikely",
    ],
}


def guess_question_type(text: LikeCol) -> Column:
    low = F.lower(col(text))
    out = F.lit(None).cast("string")
    for kind, words in TYPE_KEYWORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.coalesce(out, F.when(hit, kind))
    return F.coalesce(out, F.lit("single_choice"))


def default_options(kind: LikeCol) -> Column:
    table = F.create_map(
        *[
            x
            for name, options in DEFAULT_OPTIONS.items()
            for x in (
                F.lit(name),
                F.array(*[F.lit(o) for o in options]) if options else F.array().cast("array<string>"),
            )
        ]
    )
    return table[col(kind)]


def strip_fences(c: LikeCol) -> Column:
    """Drop a surrounding code fence and its first line."""
    return strip(F.regexp_replace(strip(c), r"^```(?:[^\n]*\n)?|```\z", ""))


def question_spec(spec_json: LikeCol, text: LikeCol) -> Column:
    """Type, options and category from a JSON spec, else from keywords.

    A spec that parses keeps its options (none when not a list) and gets
    ``single_choice`` for an unknown type.
    """
    cleaned = strip_fences(spec_json)
    fields = "question_type STRING, options ARRAY<STRING>, category STRING"
    spec = F.from_json(cleaned, fields)
    parsed = F.try_parse_json(cleaned).isNotNull() & cleaned.startswith("{")
    kind = guess_question_type(text)
    return F.when(
        parsed,
        F.struct(
            F.when(
                spec["question_type"].isin(schemas.QUESTION_TYPES), spec["question_type"]
            ).otherwise("single_choice").alias("question_type"),
            F.coalesce(spec["options"], F.array().cast("array<string>")).alias("options"),
            spec["category"].alias("category"),
        ),
    ).otherwise(
        F.struct(
            kind.alias("question_type"), default_options(kind).alias("options"),
            F.lit("general").alias("category"),
        )
    )
