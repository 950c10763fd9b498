r"""Rule tables of the text screens.

The patterns, word lists and labels below are fixed values: results must agree
with them exactly. They are written in the dialect both Java and Python read.
``needles`` are lower-case fragments, one of which occurs in every match; they let
a cheap substring test skip the pattern on most texts.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    pattern: str
    needles: tuple[str, ...]
    risk: str = "medium"
    ignore_case: bool = True


LEVELS = ["low", "medium", "high", "critical"]

# Prompt-injection patterns and their risk.
ROLE_MARKER = (
    r"<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|<<SYS>>"
    r"|(?:^|\n)\s*###\s*(?:system|instruction)"
    r"|(?:^|\n)\s*(?:system|assistant)\s*:"
)
ROLE_NEEDLES = ("im_start", "im_end", "inst]", "<<sys>>", "system", "instruction", "assistant")
INJECTION = [
    Rule(
        "ignore_previous",
        r"\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|above|earlier)\s+"
        r"(?:instructions?|prompts?|directions?|messages?|rules|context|commands?)\b",
        ("ignore",), "high",
    ),
    Rule(
        "disregard_instructions",
        r"\bdisregard\s+(?:all\s+|any\s+)?(?:previous|prior|your|the)\s+"
        r"(?:instructions?|prompts?|directions?|messages?|rules|guidelines)\b",
        ("disregard",), "high",
    ),
    Rule("disregard_mild", r"\bdisregard\s+(?:this|that|everything)\b", ("disregard",), "medium"),
    Rule(
        "system_prompt_reference",
        r"\bsystem\s+prompts?\s*:|\breveal\s+(?:your|the)\s+system\s+prompt\b",
        ("system",), "critical",
    ),
    Rule("you_are_now", r"\byou\s+are\s+now\s+\w+", ("you",), "high"),
    Rule(
        "forget_instructions",
        r"\bforget\s+(?:your|all|the)\s+(?:instructions?|training|rules|guidelines)\b",
        ("forget",), "high",
    ),
    Rule("do_anything_now", r"\bdo\s+anything\s+now\b", ("anything",), "high"),
    Rule("jailbreak", r"\bjail\s?break(?:\s+mode)?\b", ("jail",), "high"),
    Rule(
        "override_instructions",
        r"\boverride\s+(?:your|the|all)\s+"
        r"(?:instructions?|programming|rules|guidelines|training|directives?|safety)\b",
        ("override",), "high",
    ),
    Rule(
        "bypass_safety",
        r"\bbypass\s+(?:your|the|all|any)?\s*"
        r"(?:safety|security|filters?|restrictions?|guidelines|rules)\b",
        ("bypass",), "high",
    ),
    Rule(
        "pretend_you_are", r"\bpretend\s+(?:you\s+are|you're|to\s+be)\b", ("pretend",), "medium"
    ),
    Rule("act_as_if", r"\bact\s+as\s+(?:if|though)\s+you\b", ("act",), "medium"),
    Rule("new_instructions", r"\bnew\s+instructions?\s*:", ("instruction",), "high"),
    Rule("role_switch", r"\byou\s+are\s+a\s+helpful\s+assistant\b", ("helpful",), "critical"),
    Rule("chat_role_marker", ROLE_MARKER, ROLE_NEEDLES, "critical"),
]
FLAG_RISK = {
    "encoding:base64": "high",
    "encoding:hex": "high",
    "encoding:unicode": "high",
    "length:exceeded": "high",
    "length:token_budget": "high",
    "structure:missing_section": "critical",
    "structure:role_marker": "critical",
}

# Encoded or hidden payloads.
BASE64_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
BASE64_MIN_BYTES = 16
HEX = r"(?:\\x[0-9a-fA-F]{2}){8,}|\b[0-9a-fA-F]{32,}\b"
INVISIBLE = "[\u200b\u200c\u200d\u2060\ufeff\u00ad\u202a-\u202e\u2066-\u2069]"
NON_LATIN1_SHARE = 0.20
UNICODE_MIN_CHARS = 10

# Length budgets and required headings.
PROMPT_CHARS = 2000
PROMPT_TOKENS = 4096
CHARS_PER_TOKEN = 4
SECTIONS = ["DEMOGRAPHIC PROFILE:", "BEHAVIORAL PROFILE:", "RESPONSE RULES:"]

# Personal data, in order of precedence, and the redaction labels.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"
PHONE = (
    r"(?:\+\d{1,3}[-.\s]?)?(?:\(\d{3}\)[-.\s]?|\b\d{3}[-.\s])\d{3}[-.\s]\d{4}\b|\+\d{10,14}\b"
)
ADDRESS = (
    r"\b\d{1,5}\s+(?:[A-Za-z]+\s+){1,3}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|"
    r"Court|Ct|Way|Place|Pl|Terrace|Ter|Circle|Cir)\b\.?"
)
NAME_STATED = r"(?i:\bmy\s+name\s+is\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
NAME_SIGNED = r"(?i:\b(?:regards|sincerely|thanks|best),?\s*\n\s*)([A-Z][a-z]+\s+[A-Z][a-z]+)"
REDACTION = {
    "email": "[EMAIL REDACTED]",
    "ssn": "[SSN REDACTED]",
    "credit_card": "[CARD REDACTED]",
    "phone": "[PHONE REDACTED]",
    "address": "[ADDRESS REDACTED]",
    "name": "[NAME REDACTED]",
}

# Harmful content.
HARMFUL = [
    Rule(
        "violence",
        r"\b(?:kill|hurt|attack|eliminate)\s+(?:all\s+|those\s+)?"
        r"(?:people|women|men|foreigners|immigrants|minorit\w+)\b",
        ("kill", "hurt", "attack", "eliminate"),
    ),
    Rule("death", r"\bdeserve(?:s)?\s+to\s+die\b", ("deserve",)),
    Rule("expulsion", r"\bgo\s+back\s+to\s+(?:your|their)\s+country\b", ("country",)),
    Rule(
        "dehumanizing",
        r"\b(?:all|those)\s+(?:women|men|foreigners|immigrants|minorit\w+)\s+"
        r"are\s+(?:stupid|criminals?|inferior|subhuman)\b",
        ("stupid", "criminal", "inferior", "subhuman"),
    ),
]

# Memorized model output.
LEAKAGE = [
    Rule("assistant", r"\bas an ai(?: language)? model\b", ("as an ai",)),
    Rule("training", r"\bi (?:was|am|have been) trained (?:by|on)\b", ("trained",)),
    Rule("long_url", r"https?://\S{40,}", ("http",), ignore_case=False),
    Rule("copyright", r"(?:©|\(c\)|copyright)\s*\d{4}", ("©", "(c)", "copyright")),
    Rule("rights", r"\ball rights reserved\b", ("reserved",)),
]
BLOCK_CHARS = 200
BLOCK_STRIDE = 50

# Adversarial screens of generated answers.
STEREOTYPE = [
    Rule(
        "as_a", r"\bas a (?:woman|man|female|male|senior|elderly person|young person)\b", ("as a ",)
    ),
    Rule(
        "people_of",
        r"\bpeople (?:of my|from my) (?:age|gender|background|ethnicity)\b",
        ("people",),
    ),
    Rule(
        "groups",
        r"\b(?:women|men|seniors|young people|poor people|rich people) "
        r"(?:always|never|all|typically) (?:buy|prefer|choose|want)\b",
        ("buy", "prefer", "choose", "want"),
    ),
    Rule(
        "typical", r"\btypical for (?:my|our) (?:age|gender|income|demographic)\b", ("typical for",)
    ),
    Rule("because", r"\bbecause of my (?:gender|ethnicity|race|age group)\b", ("because of my",)),
]
TEMPORAL = [
    Rule("next_year", r"\bnext year'?s?\b", ("next year",)),
    Rule("upcoming", r"\bupcoming (?:launch|release|product)\b", ("upcoming",)),
    Rule("will_be", r"\bwill be (?:launched|released) (?:next|later this)\b", ("will be",)),
    Rule("preorder", r"\bpre-?order(?:ed|ing)?\b", ("order",)),
    Rule("when_it", r"\bwhen it (?:comes out|launches|releases)\b", ("when it",)),
]
PROMPT_LEAK = [
    Rule("you_are", r"\byou are a\b", ("you are a",)),
    Rule("respond_as", r"\brespond as\b", ("respond as",)),
    Rule("my_persona", r"\bmy persona\b", ("my persona",)),
    Rule("as_instructed", r"\bas instructed\b", ("as instructed",)),
    Rule(
        "the_prompt", r"\bthe (?:persona|instruction|prompt) (?:says|describes|tells)\b", ("the ",)
    ),
    Rule(
        "told_to",
        r"\bi (?:was|am) (?:told|asked|instructed) to (?:answer|respond|act)\b",
        ("told to", "asked to", "instructed to"),
    ),
    Rule("instrument", r"\bsurvey instrument\b", ("survey instrument",)),
    Rule(
        "conditioning", r"\bconditioning (?:context|profile|vector)\b", ("conditioning",)
    ),
    Rule("embedding", r"\bbehavioural embedding\b", ("behavioural embedding",)),
]
INTERCAP = r"\b(?:[A-Z][a-z]+){2,}\b"
BRAND_PARTS = [
    "crisp", "snack", "fresh", "gold", "joy", "pure", "sun", "farm",
    "nutri", "vita", "glow", "wave", "bite", "brew", "dairy", "green",
    "silk", "spark", "cream", "oven", "polar", "frost", "quick", "meadow",
]
RED_TEAM_LIMIT = 0.05

# Response validation.
HALLUCINATION_PHRASES = [
    "according to a study", "research shows that", "statistics indicate",
    "a recent report", "surveys have shown", "data suggests that",
]
MIN_CONFIDENCE = 0.2
MAX_ANSWER_CHARS = 2000
MIN_ANSWER_CHARS = 2
VALIDATION_LIMIT = 0.3
TODDLER_PHRASES = ["my children are toddlers", "just graduated from college"]

# Request validation.
MARKUP = [
    Rule("script", r"<\s*script\b", ("script",)),
    Rule("img", r"<\s*img\b", ("img",)),
    Rule("iframe", r"<\s*iframe\b", ("iframe",)),
    Rule("javascript", r"javascript\s*:", ("javascript",)),
    Rule("handler", r"\bon(?:error|load|click|mouseover)\s*=", ("=",)),
]
SQL_INJECTION = [
    Rule("drop", r";\s*drop\s+(?:table|database)\b", ("drop",)),
    Rule("union", r"\bunion\s+(?:all\s+)?select\b", ("union",)),
    Rule("comment", r"'\s*--", ("--",), ignore_case=False),
    Rule("tautology", r"'\s*(?:or|and)\s*'?\d*'?\s*=\s*'?\d*'?", ("'",)),
]
MAX_QUESTIONS = 20
MAX_QUESTION_CHARS = 500
COHORT_RANGE = (1, 5000)
DIMENSIONS = [
    "age_group", "behavioral_archetype", "education", "household_size", "income_bracket",
    "income_group", "region", "urbanicity",
]
MAX_FILTER_CHARS = 100
MAX_NAME_CHARS = 200
SURVEY_NAME = r"^[A-Za-z0-9][A-Za-z0-9 .\-]*$"
CONTRACT_ID = r"^NIQ-[A-Z]{3}-[0-9]{4}-Q[1-4]-[0-9]{3}$"
ALLOWED_MODELS = ["claude-sonnet-4-6", "gpt-4o", "claude-haiku-4-5", "ollama/llama3.1"]
KNOWN_CLIENTS = [
    "Unilever", "Procter & Gamble", "Nestlé", "PepsiCo", "Coca-Cola", "Kraft Heinz", "Mondelez",
    "Danone",
]
