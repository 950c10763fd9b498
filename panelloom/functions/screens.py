"""Text screens as column expressions: flags, risk, redaction, parsing."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import patterns as P
from panelloom.functions import spans
from panelloom.functions.expr import LikeCol, col, strip


def fold(text: Column) -> Column:
    """Lower case that also folds look-alike letters, so needles miss nothing."""
    return F.lower(F.upper(text))


# A letter and a digit beyond 16 bits, both in the class already: Java's look-behind reads such characters
# whole only if its pattern holds one.
_WORD = "[\\p{L}\\p{N}_\U0001d400]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_CLASSES = {r"\b": (_BOUNDARY, r"\b"), r"\d": (r"\p{Nd}", "\\p{Nd}\U0001d7ce"), r"\s": (r"[\s\x1c-\x1f]", r"\s\x1c-\x1f")}


def as_python(pattern: str) -> str:
    """``pattern`` for Java with the words, digits and blanks that Python sees: Java's words also have
    marks and joiners but no superscripts, its blanks no separators of information."""
    out, inside = [], False
    for piece in re.findall(r"\\.|.", pattern, re.DOTALL):
        out.append(_CLASSES.get(piece, (piece, piece))[inside])
        inside = piece == "[" or inside and piece != "]"
    return "(?U)" + "".join(out)


@functools.cache
def _digits() -> tuple[str, str]:
    """The decimal digits of all scripts, and the same in ASCII."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def matches(text: LikeCol, rule: P.Rule, low: LikeCol | None = None) -> Column:
    """Substring test first, pattern only where it can match.

    ``low`` is the folded text if the caller already holds it as a column.
    """
    t = col(text)
    folded = fold(t) if low is None else col(low)
    near = F.lit(False)
    for needle in rule.needles:
        near = near | F.contains(folded, F.lit(needle))
    return near & t.rlike(("(?iU)" if rule.ignore_case else "(?U)") + rule.pattern)


def any_match(text: LikeCol, rules: Sequence[P.Rule], low: LikeCol | None = None) -> Column:
    hit = F.lit(False)
    for rule in rules:
        hit = hit | matches(text, rule, low)
    return hit


def flag_list(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def screen(
    text: LikeCol, rules: Sequence[P.Rule], prefix: str = "", low: LikeCol | None = None
) -> Column:
    """Flags of a rule table; users pass their own rules the same way."""
    return flag_list([(matches(text, r, low), f"{prefix}{r.name}") for r in rules])


# --- prompts ----------------------------------------------------------------

def injection_flags(text: LikeCol, low: LikeCol | None = None) -> Column:
    return screen(text, P.INJECTION, "injection_pattern:", low)


def _has_base64(text: Column) -> Column:
    def readable(run: Column) -> Column:
        whole = F.substr(run, F.lit(1), (F.length(run) - F.length(run) % 4).cast("int"))
        data = F.try_to_binary(whole, F.lit("base64"))
        plain = F.decode(data, "ISO-8859-1")
        return (F.octet_length(data) >= P.BASE64_MIN_BYTES) & plain.rlike(r"^[\x20-\x7e\t\n\r]+$")

    runs = F.regexp_extract_all(text, F.lit(P.BASE64_RUN), F.lit(0))
    return F.exists(runs, lambda r: F.coalesce(readable(r), F.lit(False)))


def encoding_flags(text: LikeCol) -> Column:
    t = col(text)
    beyond = F.length(F.regexp_replace(t, "[\u0000-\u00ff]", ""))
    flood = (F.length(t) >= P.UNICODE_MIN_CHARS) & (
        beyond / F.length(t) > P.NON_LATIN1_SHARE
    )
    return flag_list(
        [
            (_has_base64(t), "encoding:base64"),
            (t.rlike("(?U)" + P.HEX), "encoding:hex"),
            (t.rlike(P.INVISIBLE) | F.coalesce(flood, F.lit(False)), "encoding:unicode"),
        ]
    )


def length_flags(text: LikeCol, chars: int = P.PROMPT_CHARS, tokens: int = P.PROMPT_TOKENS) -> Column:
    n = F.length(col(text))
    return flag_list(
        [
            (n > chars, "length:exceeded"),
            (F.floor(n / P.CHARS_PER_TOKEN) > tokens, "length:token_budget"),
        ]
    )


def structure_flags(prompt: LikeCol) -> Column:
    p = col(prompt)
    whole = F.lit(True)
    for section in P.SECTIONS:
        whole = whole & F.contains(p, F.lit(section))
    marker = P.Rule("role", P.ROLE_MARKER, P.ROLE_NEEDLES)
    return flag_list(
        [(~whole, "structure:missing_section"), (matches(p, marker), "structure:role_marker")]
    )


def question_flags(text: LikeCol, low: LikeCol | None = None) -> Column:
    return F.concat(injection_flags(text, low), encoding_flags(text), length_flags(text))


def risk(flags: LikeCol) -> Column:
    """Highest risk among the flags, ``low`` without any."""
    known = {f"injection_pattern:{r.name}": r.risk for r in P.INJECTION} | P.FLAG_RISK
    level = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, P.LEVELS.index(v))])
    top = F.array_max(F.transform(col(flags), lambda f: F.coalesce(level[f], F.lit(1))))
    return F.element_at(F.array(*[F.lit(n) for n in P.LEVELS]), F.coalesce(top, F.lit(0)) + 1)


def is_safe(flags: LikeCol) -> Column:
    return risk(flags).isin("low", "medium")


def prompt_intact(prompt: LikeCol) -> Column:
    return F.size(F.concat(structure_flags(prompt), length_flags(prompt))) == 0


def sanitize(text: LikeCol, limit: int | None = None) -> Column:
    """NFKC, no invisible or control characters, braces doubled, backtick to ``'``; cut to ``limit``
    characters only if one is given.

    NFKC leaves plain ASCII alone, so only other texts visit Python.
    """
    t = col(text)
    wide = F.when(~t.rlike(r"^\p{ASCII}*$"), t)
    out = F.coalesce(spans.nfkc(wide), t)
    out = F.regexp_replace(out, P.INVISIBLE, "")
    out = F.regexp_replace(out, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    out = F.replace(F.replace(out, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    out = F.translate(out, "`", "'")
    return out if limit is None else F.left(out, F.lit(limit))


# --- personal data and content ------------------------------------------------

def pii_kinds(text: LikeCol) -> dict[str, Column]:
    """One condition per kind of personal data, before overlaps are resolved."""
    t = col(text)
    digit = t.rlike(r"(?U)\d")
    cards = F.regexp_extract_all(t, F.lit(as_python(P.CARD)), F.lit(0))
    separators = r"[ -]"
    card = t.rlike(as_python(P.CARD)) & F.exists(
        cards, lambda c: F.call_function("luhn_check", F.translate(F.regexp_replace(c, separators, ""), *_digits()))
    )
    low = fold(t)
    signed = F.lit(False)
    for word in ("regards", "sincerely", "thanks", "best"):
        signed = signed | F.contains(low, F.lit(word))
    name = (F.contains(low, F.lit("name")) & t.rlike(as_python(P.NAME_STATED))) | (
        signed & t.rlike(as_python(P.NAME_SIGNED))
    )
    return {
        "email": F.contains(t, F.lit("@")) & t.rlike(as_python(P.EMAIL)),
        "ssn": digit & F.contains(t, F.lit("-")) & t.rlike(as_python(P.SSN)),
        "credit_card": digit & card,
        # A cheap necessary form first: the full pattern starts with optional parts.
        "phone": digit & t.rlike(as_python(r"\d[-.\s]\d{4}\b|\+\d{10}")) & t.rlike(as_python(P.PHONE)),
        "address": digit & t.rlike(as_python(r"\d\s+[A-Za-z]")) & t.rlike(as_python(P.ADDRESS)),
        "name": name,
    }


def pii_flags(text: LikeCol) -> Column:
    return flag_list([(cond, kind) for kind, cond in pii_kinds(text).items()])


def has_pii(text: LikeCol) -> Column:
    hit = F.lit(False)
    for cond in pii_kinds(text).values():
        hit = hit | cond
    return hit


def pii_spans(text: LikeCol) -> Column:
    """Struct of exact spans and the redacted text; null where nothing was found."""
    t = col(text)
    return spans.spans_and_redaction(F.when(has_pii(t), t))


def redact(text: LikeCol) -> Column:
    return F.coalesce(pii_spans(text)["redacted"], col(text))


def harmful(text: LikeCol) -> Column:
    return any_match(text, P.HARMFUL)


def leakage(text: LikeCol, low: LikeCol | None = None) -> Column:
    """A leakage phrase, or a long block repeated verbatim."""
    t = col(text)
    long_enough = F.when(F.length(t) >= 2 * P.BLOCK_CHARS, t)
    return any_match(t, P.LEAKAGE, low) | spans.repeated_block(long_enough)


# --- generated answers ----------------------------------------------------------

def combined(answer: LikeCol, reasoning: LikeCol) -> Column:
    return F.concat(
        F.coalesce(col(answer), F.lit("")), F.lit(" "), F.coalesce(col(reasoning), F.lit(""))
    )


def coined_brand(text: LikeCol) -> Column:
    """A compound of capitalized parts that are all common brand parts."""
    parts_list = F.array(*[F.lit(p) for p in P.BRAND_PARTS])
    tokens = F.regexp_extract_all(col(text), F.lit("(?U)" + P.INTERCAP), F.lit(0))

    def coined(token: Column) -> Column:
        parts = F.regexp_extract_all(token, F.lit("[A-Z][a-z]+"), F.lit(0))
        return (F.size(parts) >= 2) & F.forall(
            parts, lambda p: F.array_contains(parts_list, F.lower(p))
        )

    return F.exists(tokens, coined)


def red_team_flags(text: LikeCol, low: LikeCol | None = None) -> Column:
    return flag_list(
        [
            (any_match(text, P.STEREOTYPE, low), "red_team:demographic_stereotyping"),
            (coined_brand(text), "red_team:brand_hallucination"),
            (any_match(text, P.TEMPORAL, low), "red_team:temporal_inconsistency"),
            (any_match(text, P.PROMPT_LEAK, low), "red_team:prompt_leakage"),
        ]
    )


def staged(df: DataFrame, answer: str, reasoning: str, demographics: str) -> DataFrame:
    """The texts validation looks at, each computed once per row."""
    empty = F.lit("")
    return (
        df.withColumn("__answer", strip(F.coalesce(col(answer), empty)))
        .withColumn("__why", F.lower(F.coalesce(col(reasoning), empty)))
        .withColumn("__demo", F.lower(F.coalesce(col(demographics), empty)))
        .withColumn("__text", combined(answer, reasoning))
        .withColumn("__short", F.lower("__answer"))
        .withColumn("__said", F.lower(F.concat_ws(" ", "__answer", "__why")))
        .withColumn("__low", fold(F.col("__text")))
    )


STAGED = ["__answer", "__why", "__demo", "__text", "__short", "__said", "__low"]


def validation_flags(confidence: LikeCol, options: LikeCol, question_type: LikeCol) -> Column:
    """Flags of one answer, over the columns of ``staged`` and normalized options; an
    empty answer gets that flag only."""
    a, why, demo, said = (F.col(c) for c in ("__answer", "__why", "__demo", "__said"))
    short = F.col("__short")
    phrases = F.lit(0)
    for phrase in P.HALLUCINATION_PHRASES:
        phrases = phrases + F.contains(said, F.lit(phrase)).cast("int")
    young = F.lit(False)
    for phrase in P.TODDLER_PHRASES:
        young = young | F.contains(why, F.lit(phrase))
    asked = F.coalesce(F.size(col(options)), F.lit(0)) > 0
    fits = F.exists(col(options), lambda o: F.contains(short, o) | F.contains(o, short))
    income = (
        F.contains(demo, F.lit("low"))
        & F.contains(why, F.lit("luxury"))
        & F.contains(why, F.lit("can easily afford"))
    )
    flags = flag_list(
        [
            (asked & ~fits, "invalid_option"),
            (F.coalesce(col(confidence), F.lit(0.5)) < P.MIN_CONFIDENCE, "very_low_confidence"),
            (phrases >= 2, "hallucination_detected"),
            (F.length(a) > P.MAX_ANSWER_CHARS, "response_too_long"),
            (
                (F.length(a) < P.MIN_ANSWER_CHARS) & (col(question_type) != "net_promoter"),
                "response_too_short",
            ),
            (F.contains(demo, F.lit("65+")) & young, "age_inconsistency"),
            (income, "income_inconsistency"),
            (has_pii("__text"), "security_check:pii_detected"),
            (leakage("__text", "__low"), "security_check:data_leakage"),
        ]
    )
    return F.when(a == "", F.array(F.lit("empty_response"))).otherwise(flags)


# --- parsing raw answers --------------------------------------------------------

# Field patterns and fallback settings.
ANSWER_FIELD = r'(?i)"answer"\s*:\s*"([^"]*)"'
REASONING_FIELD = r'(?i)"reasoning"\s*:\s*"([^"]*)"'
CONFIDENCE_FIELD = r'(?i)"confidence"\s*:\s*([0-9.]+)'
FALLBACK_CONFIDENCE = 0.3
SCAN_NOTE = "Option identified by scan of unstructured output"
RAW_NOTE = "Parsing fallback — raw model output used"


def clamp_confidence(value: Column) -> Column:
    number = value.try_cast("double")
    # ``least`` and ``greatest`` skip nulls, so a missing number is told apart first.
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))
    return F.when(number.isNull(), 0.5).otherwise(clipped)


def python_text(values: Column, variant: Column, field: str) -> Column:
    """JSON field as text the way Python prints it (``None``, ``True``)."""
    kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{field}", "variant"))
    value = values[field]
    return (
        F.when(values.isNull() | ~F.map_contains_key(values, field), "")
        .when(value.isNull(), "None")
        .when(value.isin("true", "false") & (kind == "BOOLEAN"), F.initcap(value))
        .otherwise(value)
    )
