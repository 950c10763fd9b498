"""Queries over text: personal data, prompts, answers, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalog.aggregates import catalog_of
from panelloom.catalog.base import query
from panelloom.catalog.scans import _NEAR
from panelloom.functions import patterns as P
from panelloom.functions import screens
from panelloom.operators import reports, text


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({column}, {_lit(('(?i)' if ignore_case else '') + pattern)})"


def _any(column: str, rules) -> str:
    return "(" + " OR ".join(_re(column, r.pattern, r.ignore_case) for r in rules) + ")"


def _flags(pairs) -> str:
    cells = ", ".join(f"CASE WHEN {cond} THEN {_lit(name)} END" for cond, name in pairs)
    return f"array_to_string(list_filter([{cells}], lambda f: f IS NOT NULL), ',')"


# RE2 has no look-around: the neighbours of a card are matched and the middle is taken.
_CARD_SQL = r"""(len(list_filter(regexp_extract_all(text, '(?:^|[^\d-])((?:\d[ -]?){12,18}\d)(?:[^\d-]|$)', 1),
  lambda c: list_sum(list_transform(list_reverse(string_split(regexp_replace(c, '[ -]', '', 'g'), '')),
  lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER) WHEN CAST(d AS INTEGER) * 2 > 9
  THEN CAST(d AS INTEGER) * 2 - 9 ELSE CAST(d AS INTEGER) * 2 END)) % 10 = 0)) > 0)"""
_PII = [
    (_re("text", P.EMAIL), "email"),
    (_re("text", P.SSN), "ssn"),
    (_CARD_SQL, "credit_card"),
    (_re("text", P.PHONE), "phone"),
    (_re("text", P.ADDRESS), "address"),
    (f"({_re('text', P.NAME_STATED)} OR {_re('text', P.NAME_SIGNED)})", "name"),
]


@query("o01_pii_flags", f"SELECT doc_id AS id, {_flags(_PII)} AS kinds FROM documents")
def _(t):
    return t.texts.select("id", F.array_join(screens.pii_flags("text"), ",").alias("kinds"))


_LUHN_SQL = """list_sum(list_transform(list_reverse(string_split(regexp_replace(found, '[ -]', '', 'g'), '')),
  lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER) WHEN CAST(d AS INTEGER) * 2 > 9
  THEN CAST(d AS INTEGER) * 2 - 9 ELSE CAST(d AS INTEGER) * 2 END)) % 10 = 0"""


def _spans_sql(source: str) -> str:
    """``spans(id, kind, start, stop)`` of ``source(id, text)``: every match is put between two marks,
    the text is cut there, and spans that overlap one kept before go, one span per step."""
    whole, group = r"chr(1) || '\0' || chr(2)", r"'\1' || chr(1) || '\2' || chr(2)"
    stated, name = P.NAME_STATED.split(")([A-Z]", 1)
    signed, twice = P.NAME_SIGNED.split(")([A-Z]", 1)
    kinds = [
        ("email", P.EMAIL, whole), ("ssn", P.SSN, whole),
        # RE2 has no look-around: each neighbour gets a mark behind it, so that two cards can share it.
        ("credit_card", "(^|[^\\d-])((?:\\d(?: \x03|-)?){12,18}\\d)([^\\d-]|$)", group + r" || '\3'"),
        ("phone", P.PHONE, whole), ("address", P.ADDRESS, whole),
        ("name", f"({stated}))([A-Z]{name}", group), ("name", f"({signed}))([A-Z]{twice}", group),
    ]
    shown = r"regexp_replace(text, '([^\d-])', '\1' || chr(3), 'g')"
    marked = " UNION ALL ".join(
        f"SELECT id, {_lit(kind)} AS kind, {rank} AS rank, string_split(replace(regexp_replace("
        f"{shown if kind == 'credit_card' else 'text'}, {_lit(pattern)}, {put}, 'g'), chr(3), ''), chr(1)) AS parts FROM t"
        for rank, (kind, pattern, put) in enumerate(kinds)
    )
    return f"""WITH RECURSIVE t AS ({source}), m AS ({marked}),
  s AS (SELECT id, kind, rank, split_part(parts[i], chr(2), 1) AS found, CAST(list_sum(list_transform(
    parts[1:i - 1], lambda x: length(replace(x, chr(2), '')))) AS BIGINT) AS start
    FROM m, unnest(range(2, len(parts) + 1)) AS u(i)),
  o AS (SELECT id, kind, start, start + length(found) AS stop, row_number() OVER (PARTITION BY id
    ORDER BY start, -length(found), rank) AS i FROM s WHERE kind <> 'credit_card' OR {_LUHN_SQL}),
  k AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS reach, CAST(NULL AS VARCHAR) AS kind,
    CAST(NULL AS BIGINT) AS start, false AS kept FROM o
    UNION ALL SELECT o.id, o.i, CASE WHEN o.start >= k.reach THEN o.stop ELSE k.reach END, o.kind, o.start,
    o.start >= k.reach FROM k JOIN o ON o.id = k.id AND o.i = k.i + 1),
  spans AS (SELECT id, kind, start, reach AS stop FROM k WHERE kept)"""


_LABELS_SQL = "CASE kind " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in P.REDACTION.items()) + " END"
#: Text before each span and its label, and the text after the last one.
_REDACTED_SQL = f""", pieces AS (SELECT id, string_agg(substr(text, before + 1, start - before) || {_LABELS_SQL}, ''
    ORDER BY start) AS head, max(stop) AS done FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY id
    ORDER BY start), 0) AS before FROM spans) JOIN t USING (id) GROUP BY id),
  redacted AS (SELECT id, coalesce(head || substr(text, done + 1), text) AS text, head IS NOT NULL AS hit
    FROM t LEFT JOIN pieces USING (id))"""
_DOCS = "SELECT doc_id AS id, text FROM documents"


@query(
    "o01_pii_spans",
    _spans_sql(_DOCS) + """ SELECT kind AS type, count(*) AS n, CAST(min(stop - start) AS INTEGER) AS shortest,
    CAST(max(stop - start) AS INTEGER) AS longest FROM spans GROUP BY kind""",
)
def _(t):
    found = t.texts.select("id", screens.pii_spans("text").alias("p")).filter("size(p.spans) > 0")
    return found.select("id", F.inline("p.spans")).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("end") - F.col("start")).alias("shortest"),
        F.max(F.col("end") - F.col("start")).alias("longest"),
    )


@query(
    "o02_redact_email",
    f"""SELECT doc_id AS id, CAST(length(regexp_replace(text, {_lit(P.EMAIL)}, '[EMAIL REDACTED]', 'g'))
    AS BIGINT) AS n FROM documents WHERE {_flags(_PII)} = 'email'""",
)
def _(t):
    # Texts whose only finding is mail addresses: the general redaction must equal
    # one pattern replacement there.
    only = t.texts.filter(F.array_join(screens.pii_flags("text"), ",") == "email")
    return only.select("id", F.length(screens.redact("text")).cast("bigint").alias("n"))


@query("o02_redact", f"{_spans_sql(_DOCS)}{_REDACTED_SQL} SELECT id, text FROM redacted")
def _(t):
    return t.texts.select("id", screens.redact("text").alias("text"))


@query("o03_harmful", f"SELECT doc_id AS id, {_any('text', P.HARMFUL)} AS harmful FROM documents")
def _(t):
    return t.texts.select("id", screens.harmful("text").alias("harmful"))


@query(
    "o04_leakage",
    f"""SELECT doc_id AS id, ({_any('text', P.LEAKAGE)} OR (length(text) >= 400 AND
    len(list_filter(range(0, length(text) - 200, 50), lambda o: strpos(substr(text,
    strpos(text, substr(text, o + 1, 200)) + 200), substr(text, o + 1, 200)) > 0)) > 0)) AS leaked
    FROM documents""",
)
def _(t):
    return t.texts.select("id", screens.leakage("text").alias("leaked"))


_INJ = [(_re("text", r.pattern, r.ignore_case), f"injection_pattern:{r.name}") for r in P.INJECTION]
_TURNS = "(SELECT conv_id || '-' || turn AS id, role, text FROM conversations)"


@query(
    "o05_injection_flags",
    f"""SELECT id, {_flags(_INJ)} AS flags FROM (SELECT id, text FROM {_TURNS} UNION ALL
    SELECT 'doc-' || doc_id, text FROM documents)""",
)
def _(t):
    both = t.turns.select("id", "text").unionByName(
        t.texts.select(F.concat(F.lit("doc-"), "id").alias("id"), "text")
    )
    return both.select("id", F.array_join(screens.injection_flags("text"), ",").alias("flags"))


_HEX_RUN = _re("text", P.HEX)
_LEN = [
    ("length(text) > 2000", "length:exceeded"),
    ("floor(length(text) / 4) > 4096", "length:token_budget"),
]


# A run counts if its whole quads decode to enough bytes of plain text (pairs of hex digits here).
_BASE64 = f"""(len(list_filter(regexp_extract_all(text, {_lit(P.BASE64_RUN)}), lambda r: coalesce(
  regexp_full_match(hex(try(from_base64(substr(r, 1, CAST(length(r) - length(r) % 4 AS INTEGER))))),
  '(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D){{{P.BASE64_MIN_BYTES},}}'), false))) > 0)"""
_OBFUSCATED = f"""({_re('text', P.INVISIBLE)} OR (length(text) >= 10
    AND length(regexp_replace(text, '[\\x00-\\xff]', '', 'g')) / CAST(length(text) AS DOUBLE) > 0.2))"""
_ENC = [(_BASE64, "encoding:base64"), (_HEX_RUN, "encoding:hex"), (_OBFUSCATED, "encoding:unicode")]
_SCREEN = [*_INJ, *_ENC, *_LEN]


def _level_sql() -> str:
    """Place of the highest risk among the flags of a text."""
    known = {f"injection_pattern:{r.name}": r.risk for r in P.INJECTION} | P.FLAG_RISK
    cells = ", ".join(f"CASE WHEN {c} THEN {P.LEVELS.index(known.get(n, 'medium'))} ELSE 0 END" for c, n in _SCREEN)
    return f"greatest({cells})"


_LEVELS_SQL = "[" + ", ".join(_lit(level) for level in P.LEVELS) + "]"
_COUNT_SQL = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in _SCREEN)


@query("o06_encoding_flags", f"SELECT doc_id AS id, {_flags(_ENC)} AS flags FROM documents")
def _(t):
    return t.texts.select("id", F.array_join(screens.encoding_flags("text"), ",").alias("flags"))


@query(
    "o06_hidden_text",
    f"""SELECT doc_id AS id, {_HEX_RUN} AS hex, ({_re('text', P.INVISIBLE)} OR (length(text) >= 10
    AND length(regexp_replace(text, '[\\x00-\\xff]', '', 'g')) / CAST(length(text) AS DOUBLE) > 0.2))
    AS obfuscated FROM documents""",
)
def _(t):
    judged = t.texts.select("id", screens.encoding_flags("text").alias("found"))
    return judged.select(
        "id", F.array_contains("found", "encoding:hex").alias("hex"),
        F.array_contains("found", "encoding:unicode").alias("obfuscated"),
    )


@query("o07_length_flags", f"SELECT doc_id AS id, {_flags(_LEN)} AS flags FROM documents")
def _(t):
    return t.texts.select("id", F.array_join(screens.length_flags("text"), ",").alias("flags"))


_ROLE = _re("text", P.ROLE_MARKER, True)


@query(
    "o08_structure_flags",
    f"""SELECT id, {_flags([
        ("NOT (contains(text, 'DEMOGRAPHIC PROFILE:') AND contains(text, 'BEHAVIORAL PROFILE:') "
         "AND contains(text, 'RESPONSE RULES:'))", "structure:missing_section"),
        (_ROLE, "structure:role_marker")])} AS flags FROM (SELECT id, CASE WHEN role = 'system' THEN text
    ELSE 'DEMOGRAPHIC PROFILE:' || chr(10) || 'BEHAVIORAL PROFILE:' || chr(10) || 'RESPONSE RULES:' ||
    chr(10) || text END AS text FROM {_TURNS})""",
)
def _(t):
    prompt = F.when(F.col("role") == "system", F.col("text")).otherwise(
        F.concat(
            F.lit("DEMOGRAPHIC PROFILE:\nBEHAVIORAL PROFILE:\nRESPONSE RULES:\n"), F.col("text")
        )
    )
    return t.turns.select(
        "id", F.array_join(screens.structure_flags(prompt), ",").alias("flags")
    )


@query(
    "o09_risk",
    f"""SELECT doc_id AS id, {_LEVELS_SQL}[{_level_sql()} + 1] AS risk, CAST({_COUNT_SQL} AS INTEGER) AS flags
    FROM documents""",
)
def _(t):
    judged = t.texts.select("id", screens.question_flags("text").alias("found"))
    return judged.select("id", screens.risk("found").alias("risk"), F.size("found").alias("flags"))


@query(
    "o09_sanitize",
    # DuckDB has NFC alone; the documents have no compatibility forms, for which NFKC differs.
    rf"""SELECT doc_id AS id, translate(replace(replace(regexp_replace(regexp_replace(nfc_normalize(text),
    {_lit(P.INVISIBLE)}, '', 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}]|\p{{Cf}}', '', 'g'),
    '{{', '{{{{'), '}}', '}}}}'), '`', chr(39)) AS text FROM documents""",
)
def _(t):
    return t.texts.select("id", screens.sanitize("text").alias("text"))


# Raw model output in four shapes, built from the answers.
_RAW_SQL = """CASE seq % 8 WHEN 1 THEN '{"answer": "' || answer || '", "reasoning": "r", "confidence": 0.9}'
  WHEN 3 THEN 'so: "answer": "' || answer || '", "confidence": 7.5 ...'
  WHEN 5 THEN 'I pick ' || lower(answer) ELSE 'either 1-urgent or 5-low, hard to say' END"""


def _raw(t):
    seq, a = F.col("seq"), F.col("answer")
    shaped = (
        F.when(
            seq % 8 == 1,
            F.concat(F.lit('```json\n{"answer": "'), a, F.lit('", "reasoning": "r", "confidence": 0.9}\n```')),
        )
        .when(seq % 8 == 3, F.concat(F.lit('so: "answer": "'), a, F.lit('", "confidence": 7.5 ...')))
        .when(seq % 8 == 5, F.concat(F.lit("I pick "), F.lower(a)))
        .otherwise("either 1-urgent or 5-low, hard to say")
    )
    joined = t.generated.join(catalog_of(t).select("question_id", "options"), "question_id")
    rows = joined.select("response_id", shaped.alias("raw"), "options")
    return text.parse_answers(rows, "raw").drop("raw", "options")


@query(
    "o10_parse_answers",
    f"""SELECT response_id, CASE seq % 8 WHEN 7 THEN {_RAW_SQL} ELSE answer END AS answer,
    CASE seq % 8 WHEN 1 THEN 'r' WHEN 3 THEN '' WHEN 5 THEN {_lit(screens.SCAN_NOTE)}
    ELSE {_lit(screens.RAW_NOTE)} END AS reasoning, CASE seq % 8 WHEN 1 THEN CAST(0.9 AS DOUBLE) WHEN 3
    THEN 1 ELSE CAST(0.3 AS DOUBLE) END AS confidence, CASE seq % 8 WHEN 1 THEN 'json' WHEN 3 THEN 'regex'
    WHEN 5 THEN 'option_scan' ELSE 'raw' END AS parse_method FROM generated""",
    ("generated",),
)
def _(t):
    return _raw(t)


@query(
    "d37_parse_rates",
    """SELECT CASE seq % 8 WHEN 1 THEN 'json' WHEN 3 THEN 'regex' WHEN 5 THEN 'option_scan' ELSE 'raw' END
    AS parse_method, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM generated) AS DOUBLE), 6)
    AS rate FROM generated GROUP BY 1""",
    ("generated",),
)
def _(t):
    return reports.parse_rates(_raw(t)).withColumn("rate", F.round("rate", 6))


_BRANDS = ", ".join(_lit(b) for b in P.BRAND_PARTS)
_COINED = f"""(len(list_filter(regexp_extract_all(text, {_lit(P.INTERCAP)}), lambda w:
  len(list_filter(regexp_extract_all(w, '[A-Z][a-z]+'), lambda p: NOT list_contains([{_BRANDS}],
  lower(p)))) = 0)) > 0)"""
_RED = [
    (_any("text", P.STEREOTYPE), "red_team:demographic_stereotyping"),
    (_COINED, "red_team:brand_hallucination"),
    (_any("text", P.TEMPORAL), "red_team:temporal_inconsistency"),
    (_any("text", P.PROMPT_LEAK), "red_team:prompt_leakage"),
]


@query(
    "o11_red_team",
    f"""SELECT id, {_flags(_RED)} AS flags FROM (SELECT 'd' || doc_id AS id, text || ' ' AS text
    FROM documents UNION ALL SELECT response_id, answer || ' ' || CASE seq % 9 WHEN 1 THEN
    'As a senior I buy CrispJoy' WHEN 3 THEN 'People of my age prefer GoldFinch next year' WHEN 5 THEN
    'As instructed I preordered it' ELSE 'It is fine' END FROM generated)""",
    ("generated",),
)
def _(t):
    seq = F.col("seq")
    why = (
        F.when(seq % 9 == 1, "As a senior I buy CrispJoy")
        .when(seq % 9 == 3, "People of my age prefer GoldFinch next year")
        .when(seq % 9 == 5, "As instructed I preordered it")
        .otherwise("It is fine")
    )
    rows = t.generated.select(F.col("response_id").alias("id"), "answer", why.alias("reasoning"))
    docs = t.texts.select(
        F.concat(F.lit("d"), "id").alias("id"), F.col("text").alias("answer"),
        F.lit(None).cast("string").alias("reasoning"),
    )
    return text.red_team(docs.unionByName(rows)).select(
        "id", F.array_join("red_team_flags", ",").alias("flags")
    )


def _judged(t):
    seq = F.col("seq")
    why = (
        F.when(seq % 13 == 0, "According to a study of shops; research shows that it sells")
        .when(seq % 17 == 0, "a luxury we can easily afford")
        .when(seq % 19 == 0, "my children are toddlers")
        .when(seq % 23 == 0, "write to me at ann.smith@example.com")
        .when(seq % 29 == 0, "As an AI language model I cannot shop")
        .otherwise("it suits us")
    )
    rows = t.generated.select(
        "response_id", "question_id", F.when(seq % 31 == 0, "  ").otherwise(F.col("loose_answer")).alias("answer"),
        why.alias("reasoning"), F.when(seq % 6 == 1, F.lit(None)).otherwise(F.col("confidence")).alias("confidence"),
        F.concat_ws(", ", "age_group", "income_group", "region").alias("demographic_summary"),
    )
    return text.validate_responses(rows, catalog_of(t))


_JUDGED = f"""{_NEAR}, w AS (SELECT g.*, CASE WHEN seq % 31 = 0 THEN '  ' ELSE loose_answer END AS ans,
  CASE WHEN seq % 13 = 0 THEN 'h' WHEN seq % 17 = 0 THEN 'l' WHEN seq % 19 = 0 THEN 't'
  WHEN seq % 23 = 0 THEN 'm' WHEN seq % 29 = 0 THEN 'a' ELSE '' END AS why, near.option_idx AS near_idx
  FROM generated g LEFT JOIN near USING (response_id)), judged AS (SELECT response_id, CASE WHEN
  trim(ans) = '' THEN 'empty_response' ELSE {_flags([
    ("near_idx IS NULL", "invalid_option"),
    ("seq % 6 <> 1 AND confidence < CAST(0.2 AS DOUBLE)", "very_low_confidence"),
    ("why = 'h'", "hallucination_detected"),
    ("age_group = '65+' AND why = 't'", "age_inconsistency"),
    ("why = 'l' AND contains(income_group, 'low')", "income_inconsistency"),
    ("why = 'm'", "security_check:pii_detected"),
    ("why = 'a'", "security_check:data_leakage"),
])} END AS flags FROM w)"""


@query(
    "o12_validate_responses",
    f"WITH {_JUDGED} SELECT response_id, flags, flags = '' AS is_valid FROM judged",
    ("generated", "options"),
)
def _(t):
    return _judged(t).select(
        "response_id", F.array_join("validation_flags", ",").alias("flags"), "is_valid"
    )


@query(
    "o12_rejection_report",
    f"""WITH {_JUDGED} SELECT count(*) AS screened, count(*) FILTER (WHERE flags <> '') AS rejected,
    round(avg(CASE WHEN flags <> '' THEN 1 ELSE 0 END), 6) AS rejection_rate,
    avg(CASE WHEN flags <> '' THEN 1 ELSE 0 END) > CAST(0.3 AS DOUBLE) AS needs_regeneration FROM judged""",
    ("generated", "options"),
)
def _(t):
    return text.rejection_report(_judged(t), P.VALIDATION_LIMIT).withColumn(
        "rejection_rate", F.round("rejection_rate", 6)
    )


@query(
    "o13_screen_questions",
    f"""SELECT id AS question_id, CASE WHEN level < 2 THEN 'safe' ELSE {_LEVELS_SQL}[level + 1] END AS outcome
    FROM (SELECT id, {_level_sql()} AS level FROM {_TURNS})""",
)
def _(t):
    rows = t.turns.select(F.col("id").alias("question_id"), "text")
    safe, blocked = text.screen_questions(rows)
    return safe.select("question_id", F.lit("safe").alias("outcome")).unionByName(
        blocked.select("question_id", F.col("risk_level").alias("outcome"))
    )


@query(
    "o13_sanitize_responses",
    f"""{_spans_sql(f"SELECT id, text FROM {_TURNS}")}{_REDACTED_SQL} SELECT id AS response_id, text AS answer,
    CASE WHEN hit THEN 'pii_redacted' ELSE '' END AS security_flags FROM redacted""",
)
def _(t):
    rows = t.turns.select(F.col("id").alias("response_id"), F.col("text").alias("answer"))
    return text.sanitize_responses(rows).select(
        "response_id", "answer", F.array_join("security_flags", ",").alias("security_flags")
    )


@query(
    "o14_validate_requests",
    f"""WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders),
    q AS (SELECT k, CASE k % 5 WHEN 0 THEN '<script>x</script>' WHEN 1 THEN ''' OR 1=1' WHEN 2 THEN ' '
    ELSE 'Do you like ' || p || '?' END AS q FROM r), x AS (
    SELECT k, 'questions[0]' AS field, CASE k % 5 WHEN 0 THEN 'HTML/script content is not allowed' WHEN 1
    THEN 'SQL injection pattern detected' ELSE 'Question is empty' END AS message, q AS received FROM q
    WHERE k % 5 < 3 UNION ALL
    SELECT k, 'questions', 'Too many questions: 21', '21' FROM r WHERE k % 7 = 0 UNION ALL
    SELECT k, 'cohort_size', 'Cohort size ' || (c * 10) || ' out of range', CAST(c * 10 AS VARCHAR) FROM r
    WHERE c * 10 NOT BETWEEN 1 AND 5000 UNION ALL
    SELECT k, 'model', 'Model ''' || p || ''' is not allowed', p FROM r WHERE k % 3 = 0 UNION ALL
    SELECT k, 'client_name', 'Unknown client ''Client ' || (k % 4) || '''', 'Client ' || (k % 4) FROM r
    WHERE k % 4 <> 0 UNION ALL
    SELECT k, 'filters.shoe_size', 'Unknown demographic dimension ''shoe_size''', 'shoe_size' FROM r
    WHERE k % 6 = 0 UNION ALL
    SELECT k, 'filters.region', 'Filter value must be a non-empty string', '' FROM r WHERE k % 6 = 1 UNION ALL
    SELECT k, 'survey_name', 'Survey name contains invalid characters', 'Wave #' || k FROM r
    WHERE k % 8 = 0 UNION ALL
    SELECT k, 'contract_id', 'Contract ID has invalid format', 'NIQ-UNI-2026-Q5-001' FROM r WHERE k % 9 = 0)
    SELECT CAST(k AS VARCHAR) AS request_id, field, message, received FROM x""",
)
def _(t):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    first = (
        F.when(k % 5 == 0, "<script>x</script>")
        .when(k % 5 == 1, "' OR 1=1")
        .when(k % 5 == 2, " ")
        .otherwise(F.concat(F.lit("Do you like "), p, F.lit("?")))
    )
    many = F.when(k % 7 == 0, F.array_repeat(F.lit("And why?"), 20)).otherwise(
        F.array().cast("array<string>")
    )
    rows = t.raw("orders").select(
        k.cast("string").alias("request_id"),
        F.concat(F.array(first), many).alias("questions"),
        (F.col("o_custkey") * 10).cast("string").alias("cohort_size"),
        F.when(k % 3 == 0, p).otherwise("gpt-4o").alias("model"),
        F.when(k % 4 == 0, "Danone").otherwise(
            F.concat(F.lit("Client "), (k % 4).cast("string"))
        ).alias("client_name"),
        F.when(k % 6 == 0, F.create_map(F.lit("shoe_size"), F.lit("42")))
        .when(k % 6 == 1, F.create_map(F.lit("region"), F.lit("")))
        .otherwise(F.create_map(F.lit("region"), F.lit("south"))).alias("filters"),
        F.when(k % 8 == 0, F.concat(F.lit("Wave #"), k.cast("string"))).otherwise("Wave 1").alias(
            "survey_name"
        ),
        F.when(k % 9 == 0, "NIQ-UNI-2026-Q5-001").otherwise("NIQ-UNI-2026-Q3-001").alias(
            "contract_id"
        ),
    )
    return text.validate_requests(rows)


@query(
    "l02_custom_screen",
    """SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN regexp_matches(text,
    '(?i)\\blicen[cs]e\\b') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)https?://')
    THEN 'link' END], lambda f: f IS NOT NULL), ',') AS flags FROM documents""",
)
def _(t):
    rules = [
        P.Rule("licence", r"\blicen[cs]e\b", ("licen",)),
        P.Rule("link", r"https?://", ("http",)),
    ]
    return t.texts.select("id", F.array_join(screens.screen("text", rules), ",").alias("flags"))


