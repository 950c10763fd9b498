"""Panel entities derived from the given star schema.

The one module that knows the input column names; operators see panel entities
only. Each entity has a Spark form here and an equal SQL form in
``panelloom.catalog.base`` for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions.ranking import first_rows
from panelloom.operators.distributions import question_catalog
from panelloom.session import materialize, spread


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class PanelTables:
    """Lazily built entities over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def panelists(self) -> DataFrame:
        key = F.col("c_custkey")
        band = F.least(
            F.lit(4), F.greatest(F.lit(0), F.floor((F.col("c_acctbal") + 1000.0) / 2200.0))
        )
        nations = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.raw("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.cast("string").alias("panelist_id"),
                _pick(schemas.AGE_GROUPS, key % 6).alias("age_group"),
                _pick(schemas.INCOME_GROUPS, band).alias("income_group"),
                F.col("r_name").alias("region"),
                _pick(schemas.HOUSEHOLD_SIZES, key % 4).alias("household_size"),
                _pick(schemas.EDUCATION_LEVELS, F.col("c_nationkey") % 5).alias("education_level"),
                _pick(schemas.EMPLOYMENT, key % 4).alias("employment_status"),
                (key % 3 == 0).alias("has_children"),
                F.col("c_mktsegment").alias("behavioral_archetype"),
                (1.0 + F.abs("c_acctbal") / 1000.0).alias("expansion_factor"),
            )
        )

    @cached_property
    def purchases(self) -> DataFrame:
        value = F.col("l_extendedprice") * (1.0 - F.col("l_discount"))
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").cast("string").alias("panelist_id"),
                F.to_date("l_shipdate").alias("transaction_date"),
                F.col("p_type").alias("product_category"),
                F.col("p_brand").alias("brand"),
                F.col("l_quantity").cast("int").alias("quantity"),
                (F.col("p_size") * F.lit(0.5)).alias("unit_price"),
                (F.floor(value * 100.0 + 0.5) / 100.0).alias("total_value"),
                F.when(F.col("l_returnflag") == "R", "online")
                .when(F.col("l_returnflag") == "A", "convenience")
                .otherwise("supermarket")
                .alias("store_type"),
                (F.col("l_discount") >= 0.05).alias("is_promotion"),
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
                    "line_ref"
                ),
            )
        )

    def _answers(self, keep: Column) -> DataFrame:
        """One answer per (panelist, question): the lowest order key in ``keep``."""
        question = F.concat(F.lit("q_"), F.col("o_orderstatus"))
        picked = first_rows(
            self.raw("orders")
            .filter(keep)
            .select(
                "o_custkey", question.alias("question_id"), "o_orderkey", "o_orderpriority",
                "o_orderdate", "o_totalprice",
            ),
            ["o_custkey", "question_id"],
            ["o_orderkey"],
        )
        return picked.select(
            F.col("o_orderkey").cast("string").alias("response_id"),
            F.col("o_custkey").cast("string").alias("panelist_id"),
            "question_id",
            F.concat(F.lit("How satisfied are you with "), F.col("question_id"), F.lit("?")).alias(
                "question_text"
            ),
            F.lit("likert_5").alias("question_type"),
            F.col("o_orderpriority").alias("answer"),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("answer_index"),
            F.to_date("o_orderdate").alias("response_date"),
            F.col("o_orderkey").alias("seq"),
        )

    def _with_panel(self, answers: DataFrame) -> DataFrame:
        attributes = self.panelists.select(
            "panelist_id", "age_group", "income_group", "region", "behavioral_archetype",
            "expansion_factor",
        )
        return answers.join(attributes, "panelist_id")

    @cached_property
    def responses(self) -> DataFrame:
        """All historical answers with the respondent's attributes."""
        return self._with_panel(self._answers(F.lit(True)))

    @cached_property
    def catalog(self) -> DataFrame:
        """Question catalog, stored once: a row per question that many steps join."""
        return materialize(question_catalog(self._answers(F.lit(True))), "catalog")

    @cached_property
    def empirical(self) -> DataFrame:
        return self._with_panel(self._answers(F.col("o_orderkey") % 2 == 0))

    @cached_property
    def generated(self) -> DataFrame:
        """Answers to be judged: loosely worded, with confidence and flags."""
        seq = F.col("seq")
        word = F.col("answer")
        loose = (
            F.when(seq % 11 == 0, "no idea")
            .when(seq % 7 == 0, F.substring(word, 3, 20))
            .when(seq % 4 == 0, F.concat(F.lit("I would say: "), word))
            .when(seq % 4 == 1, F.concat(F.lit("  "), F.lower(word), F.lit(" ")))
            .otherwise(word)
        )
        flags = F.array_compact(
            F.array(
                F.when(seq % 50 == 1, "hallucination_detected"),
                F.when(seq % 40 == 3, "age_inconsistency"),
                F.when(seq % 60 == 7, "invalid_option"),
            )
        )
        return (
            self._with_panel(self._answers(F.col("o_orderkey") % 2 == 1))
            .withColumn("loose_answer", loose)
            .withColumn("confidence", (seq % 97) / F.lit(97.0))
            .withColumn(
                "uncertainty", F.when(seq % 5 == 0, F.lit(None)).otherwise((seq % 89) / F.lit(80.0))
            )
            .withColumn("validation_flags", flags)
            .withColumn("is_valid", F.size(flags) == 0)
            .withColumn("token_count", (seq % 700).cast("int"))
            .withColumn("cost_usd", (seq % 700) * 0.0001)
            .withColumn("generation_time_ms", (seq % 1300).cast("double"))
            .withColumn("model_used", F.concat(F.lit("model_"), (seq % 3).cast("string")))
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Service calls as an event log."""
        return self.raw("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("event_time"),
            F.col("user_id").cast("string").alias("key"),
            F.col("event_type").alias("label"),
            "value",
            (F.col("event_type") == "error").alias("failed"),
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("embedding").cast("array<double>").alias("vector"),
            "label",
        )

    @cached_property
    def texts(self) -> DataFrame:
        return spread(self.raw("documents").select(F.col("doc_id").alias("id"), "text"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text"
        )
