"""Screening jobs over tables of questions, answers and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import patterns as P
from panelloom.functions import screens
from panelloom.functions.expr import norm, strip, strip_fences
from panelloom.session import n_rows


def screen_questions(questions: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Safe questions, and an audit row per blocked one."""
    judged = (
        questions.withColumn("__low", screens.fold(F.col(text)))
        .withColumn("flags", screens.question_flags(text, "__low"))
        .withColumn("risk_level", screens.risk("flags"))
    )
    safe = judged.filter(F.col("risk_level").isin("low", "medium")).select(*questions.columns)
    blocked = judged.filter(~F.col("risk_level").isin("low", "medium")).select(
        *[c for c in questions.columns if c != text],
        F.lit("prompt_injection_blocked").alias("flag"), "risk_level",
        F.col("flags").alias("detections"),
    )
    return safe, blocked


def sanitize_responses(responses: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers redacted, with ``security_flags``; other text stays as it is."""
    found = responses.withColumn("__pii", screens.pii_spans(answer))
    hit = F.size(F.coalesce(F.col("__pii.spans"), F.array())) > 0
    return found.withColumn(
        "security_flags",
        F.when(hit, F.array(F.lit("pii_redacted"))).otherwise(F.array().cast("array<string>")),
    ).withColumn(answer, F.coalesce("__pii.redacted", answer)).drop("__pii")


def validate_responses(
    responses: DataFrame, questions: DataFrame, answer: str = "answer"
) -> DataFrame:
    """Responses with ``validation_flags`` and ``is_valid``.

    ``questions`` has ``question_id, options, question_type``; an unknown question
    skips the option rule.
    """
    known = questions.select(
        "question_id", F.transform("options", norm).alias("__options"),
        F.col("question_type").alias("__type"),
    )
    joined = responses.drop("validation_flags", "is_valid").join(known, "question_id", "left")
    staged = screens.staged(joined, answer, "reasoning", "demographic_summary")
    flags = screens.validation_flags("confidence", "__options", "__type")
    return (
        staged.withColumn("validation_flags", flags)
        .withColumn("is_valid", F.size("validation_flags") == 0)
        .drop("__options", "__type", *screens.STAGED)
    )


def red_team(responses: DataFrame, answer: str = "answer", reasoning: str = "reasoning") -> DataFrame:
    """Adds red-team flags to the flags already there; flagged rows become invalid."""
    staged = responses.withColumn("__text", screens.combined(answer, reasoning)).withColumn(
        "__low", screens.fold(F.col("__text"))
    )
    flags = screens.red_team_flags("__text", "__low")
    before = (
        F.col("validation_flags") if "validation_flags" in responses.columns
        else F.array().cast("array<string>")
    )
    marked = staged.withColumn("red_team_flags", flags).drop("__text", "__low")
    return marked.withColumn("validation_flags", F.concat(before, F.col("red_team_flags"))).withColumn(
        "is_valid", F.size("validation_flags") == 0
    )


def rejection_report(judged: DataFrame, limit: float, invalid: Column | None = None) -> DataFrame:
    """Totals, rejected share, and whether it asks for new answers."""
    bad = invalid if invalid is not None else ~F.col("is_valid")
    rate = F.coalesce(F.avg(bad.cast("int")), F.lit(0.0))
    return judged.agg(
        n_rows().alias("screened"), F.count_if(bad).alias("rejected"),
        rate.alias("rejection_rate"), (rate > limit).alias("needs_regeneration"),
    )


def parse_answers(df: DataFrame, raw: str, options: str = "options") -> DataFrame:
    """Adds answer, reasoning, confidence and parse_method to raw model output.

    JSON object, then loose fields, then the only option mentioned, then the raw
    text. Never fails. Each step is a column of its own, so no text is cleaned or
    parsed twice.
    """
    found = df.withColumn("__text", strip_fences(raw))
    found = found.withColumn(
        "__json", F.when(F.startswith("__text", F.lit("{")), F.try_parse_json("__text"))
    ).withColumn(
        "__map",
        F.when(F.col("__json").isNotNull(), F.from_json("__text", "map<string,string>")),
    )
    low = F.lower("__text")
    none = F.array().cast("array<string>")
    mentioned = F.filter(
        F.coalesce(F.col(options), none), lambda o: F.contains(low, F.lower(o))
    )
    found = found.select(
        "*",
        F.coalesce(screens.python_text(F.col("__map"), F.col("__json"), "answer"), F.lit("")).alias(
            "__by_json"
        ),
        F.regexp_extract("__text", screens.ANSWER_FIELD, 1).alias("__by_field"),
        mentioned.alias("__mentioned"),
    )
    method = (
        F.when(strip("__by_json") != "", "json")
        .when(strip("__by_field") != "", "regex")
        .when(F.size("__mentioned") == 1, "option_scan")
        .otherwise("raw")
    )
    found = found.withColumn("parse_method", method)
    how = F.col("parse_method")

    def pick(by_json: Column, by_field: Column, by_scan: Column, by_raw: Column) -> Column:
        return (
            F.when(how == "json", by_json).when(how == "regex", by_field)
            .when(how == "option_scan", by_scan).otherwise(by_raw)
        )

    fallback = F.lit(screens.FALLBACK_CONFIDENCE)
    return found.select(
        *df.columns,
        pick(
            F.col("__by_json"), F.col("__by_field"), F.get("__mentioned", F.lit(0)),
            F.col("__text"),
        ).alias("answer"),
        pick(
            screens.python_text(F.col("__map"), F.col("__json"), "reasoning"),
            F.regexp_extract("__text", screens.REASONING_FIELD, 1),
            F.lit(screens.SCAN_NOTE), F.lit(screens.RAW_NOTE),
        ).alias("reasoning"),
        pick(
            screens.clamp_confidence(F.col("__map")["confidence"]),
            screens.clamp_confidence(F.regexp_extract("__text", screens.CONFIDENCE_FIELD, 1)),
            fallback, fallback,
        ).alias("confidence"),
        "parse_method",
    )


def _issue(cond: Column, field: Column | str, message: Column | str, received: Column) -> Column:
    f = F.lit(field) if isinstance(field, str) else field
    m = F.lit(message) if isinstance(message, str) else message
    return F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(
            f.alias("field"), m.alias("message"),
            received.cast("string").alias("received"),
        ),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """One row per issue of a request.

    Columns: ``request_id, questions ARRAY<STRING>, cohort_size STRING, model,
    client_name, filters MAP<STRING,STRING>, survey_name, contract_id``.
    """
    questions = F.col("questions")
    issue_type = "array<struct<field:string,message:string,received:string>>"

    def per_question(q: Column, i: Column) -> Column:
        field = F.concat(F.lit("questions["), i.cast("string"), F.lit("]"))
        blank = strip(q) == ""
        return F.array_compact(
            F.array(
                _issue(blank, field, "Question is empty", q),
                _issue(
                    ~blank & (F.length(q) > P.MAX_QUESTION_CHARS), field,
                    F.concat(F.lit("Question too long: "), F.length(q), F.lit(" characters")), q,
                ),
                _issue(
                    ~blank & screens.any_match(q, P.MARKUP), field,
                    "HTML/script content is not allowed", q,
                ),
                _issue(
                    ~blank & screens.any_match(q, P.SQL_INJECTION), field,
                    "SQL injection pattern detected", q,
                ),
            )
        )

    def per_filter(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        field = F.concat(F.lit("filters."), key)
        known = key.isin(P.DIMENSIONS)
        blank = value.isNull() | (strip(value) == "")
        return F.array_compact(
            F.array(
                _issue(
                    ~known, field,
                    F.concat(
                        F.lit("Unknown demographic dimension '"),
                        key, F.lit("'"),
                    ),
                    key,
                ),
                _issue(
                    known & blank, field, "Filter value must be a non-empty string",
                    F.coalesce(value, F.lit("None")),
                ),
                _issue(
                    known & ~blank & (F.length(value) > P.MAX_FILTER_CHARS), field,
                    F.concat(F.lit("Filter value too long: "), F.length(value), F.lit(" characters")),
                    value,
                ),
            )
        )

    n = F.col("cohort_size")
    whole = n.rlike("^-?[0-9]+$")
    low, high = P.COHORT_RANGE
    size = n.try_cast("decimal(38,0)")
    name = F.col("survey_name")
    bad_length = (F.length(name) == 0) | (F.length(name) > P.MAX_NAME_CHARS)
    single = F.array_compact(
        F.array(
            _issue(
                F.size(questions) > P.MAX_QUESTIONS, "questions",
                F.concat(F.lit("Too many questions: "), F.size(questions)), F.size(questions),
            ),
            _issue(~whole, "cohort_size", "Cohort size must be an integer", n),
            _issue(
                whole & ~F.coalesce(size.between(low, high), F.lit(False)), "cohort_size",
                F.concat(F.lit("Cohort size "), n, F.lit(" out of range")), n,
            ),
            _issue(
                ~F.col("model").isin(P.ALLOWED_MODELS), "model",
                F.concat(
                    F.lit("Model '"), F.col("model"),
                    F.lit("' is not allowed"),
                ),
                F.col("model"),
            ),
            _issue(
                ~F.col("client_name").isin(P.KNOWN_CLIENTS), "client_name",
                F.concat(
                    F.lit("Unknown client '"), F.col("client_name"),
                    F.lit("'"),
                ),
                F.col("client_name"),
            ),
            _issue(bad_length, "survey_name", "Survey name length out of range", name),
            _issue(
                ~bad_length & ~name.rlike(P.SURVEY_NAME), "survey_name",
                "Survey name contains invalid characters", name,
            ),
            _issue(
                ~F.col("contract_id").rlike(P.CONTRACT_ID), "contract_id",
                "Contract ID has invalid format", F.col("contract_id"),
            ),
        )
    ).cast(issue_type)
    each = F.flatten(F.transform(questions, per_question)).cast(issue_type)
    filters = F.flatten(F.transform(F.map_entries("filters"), per_filter)).cast(issue_type)
    return requests.select(
        "request_id", F.inline(F.concat(single, each, filters))
    )
