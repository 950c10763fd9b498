"""Query registry: each entry pairs a Spark query with its check SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelloom.session import checkpoint_root
from panelloom.sources.derive import PanelTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ANSWER = """
SELECT CAST(first_key AS VARCHAR) AS response_id, CAST(o.o_custkey AS VARCHAR) AS panelist_id,
  'q_' || o.o_orderstatus AS question_id,
  'How satisfied are you with q_' || o.o_orderstatus || '?' AS question_text,
  'likert_5' AS question_type,
  o.o_orderpriority AS answer, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) - 1 AS answer_index,
  CAST(o.o_orderdate AS DATE) AS response_date, o.o_orderkey AS seq,
  p.age_group, p.income_group, p.region, p.behavioral_archetype, p.expansion_factor
FROM orders o JOIN (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_key FROM orders
  {where} GROUP BY o_custkey, o_orderstatus) f ON o.o_orderkey = f.first_key
JOIN panelists p ON p.panelist_id = CAST(o.o_custkey AS VARCHAR)
"""

CTES = {
    "panelists": """
SELECT CAST(c_custkey AS VARCHAR) AS panelist_id,
  ['18-24','25-34','35-44','45-54','55-64','65+'][c_custkey % 6 + 1] AS age_group,
  ['low','lower_middle','middle','upper_middle','high'][
    least(4, greatest(0, CAST(floor((c_acctbal + 1000) / 2200) AS INTEGER))) + 1] AS income_group,
  r_name AS region, ['1','2','3-4','5+'][c_custkey % 4 + 1] AS household_size,
  ['high_school','some_college','bachelors','masters','doctorate'][c_nationkey % 5 + 1]
    AS education_level,
  ['employed','unemployed','retired','student'][c_custkey % 4 + 1] AS employment_status,
  c_custkey % 3 = 0 AS has_children, c_mktsegment AS behavioral_archetype,
  1 + abs(c_acctbal) / 1000 AS expansion_factor
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "purchases": """
SELECT CAST(o_custkey AS VARCHAR) AS panelist_id, CAST(l_shipdate AS DATE) AS transaction_date,
  p_type AS product_category, p_brand AS brand, CAST(l_quantity AS INTEGER) AS quantity,
  CAST(p_size AS DOUBLE) / 2 AS unit_price,
  floor(l_extendedprice * (1 - l_discount) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS total_value,
  CASE WHEN l_returnflag = 'R' THEN 'online' WHEN l_returnflag = 'A' THEN 'convenience'
    ELSE 'supermarket' END AS store_type,
  l_discount >= CAST(0.05 AS DOUBLE) AS is_promotion,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_ref
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
""",
    "responses": _ANSWER.format(where=""),
    "empirical": _ANSWER.format(where="WHERE o_orderkey % 2 = 0"),
    "generated": f"""
SELECT g.*, CASE WHEN seq % 11 = 0 THEN 'no idea' WHEN seq % 7 = 0 THEN substr(answer, 3)
    WHEN seq % 4 = 0 THEN 'I would say: ' || answer
    WHEN seq % 4 = 1 THEN '  ' || lower(answer) || ' ' ELSE answer END AS loose_answer,
  (seq % 97) / CAST(97 AS DOUBLE) AS confidence,
  CASE WHEN seq % 5 = 0 THEN NULL ELSE (seq % 89) / CAST(80 AS DOUBLE) END AS uncertainty,
  list_filter([CASE WHEN seq % 50 = 1 THEN 'hallucination_detected' END,
    CASE WHEN seq % 40 = 3 THEN 'age_inconsistency' END,
    CASE WHEN seq % 60 = 7 THEN 'invalid_option' END], lambda f: f IS NOT NULL)
    AS validation_flags,
  NOT (seq % 50 = 1 OR seq % 40 = 3 OR seq % 60 = 7) AS is_valid,
  CAST(seq % 700 AS INTEGER) AS token_count, (seq % 700) * CAST(0.0001 AS DOUBLE) AS cost_usd,
  CAST(seq % 1300 AS DOUBLE) AS generation_time_ms,
  'model_' || CAST(seq % 3 AS VARCHAR) AS model_used
FROM ({_ANSWER.format(where="WHERE o_orderkey % 2 = 1")}) g
""",
    "calls": """
SELECT event_id, ts AS event_time, CAST(user_id AS VARCHAR) AS key, event_type AS label, value,
  event_type = 'error' AS failed FROM events
""",
    "options": """
SELECT DISTINCT question_id, answer_index AS option_idx, answer AS option FROM responses
""",
}
_NEEDS = {
    "responses": ["panelists"], "empirical": ["panelists"], "generated": ["panelists"],
    "options": ["panelists", "responses"],
}


def ctes(*names: str) -> str:
    """``WITH`` clause for the named entities, dependencies first."""
    order: list[str] = []
    for name in names:
        for item in [*_NEEDS.get(name, []), name]:
            if item not in order:
                order.append(item)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order)


def folder(t: PanelTables, name: str) -> str:
    """A new folder of its own in the shared space for one run of a query."""
    return f"{checkpoint_root(t.spark)}/queries/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable:
    """Register ``fn(tables) -> DataFrame``; ``sql`` may refer to the entities in ``needs``."""

    def register(fn: Callable[[PanelTables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(PanelTables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if needs and body.upper().startswith("WITH "):
                body = ctes(*needs) + ",\n" + body[5:]
            elif needs:
                body = ctes(*needs) + "\n" + body
            SQL[name] = body
        return fn

    return register
