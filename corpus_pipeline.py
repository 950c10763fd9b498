"""From documents to token ids: five stages, each of them an operator of ``panelloom.llm``.

Every stage is a function of (spark, docs, sf_dir) that judges all rows of ``docs``. Its result
is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import jaccard, pieces, suffixes, toxicity
from panelloom.llm.common import Steps, table
from panelloom.llm.mixing import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stages depend on trained models and on hashes of sets, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go.

    It learns from the labels of folds 1 to 4 of 5; without labels of both kinds all stay.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    model = toxicity.learn(docs.select("doc_id", "text"), labels.filter(fold != 0))
    return toxicity.toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Rows that repeat an id count once (the smallest text); rows without an id all stay, and so
    do documents without words.
    """
    found = jaccard.similar_documents(docs.select("doc_id", "text"))
    verdict = (
        found.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("component_id").alias("component_id"), F.count("*").alias("copies"))
        .filter("component_id <> doc_id or copies > 1")
    )
    kept = (
        docs.select(*COLUMNS)
        .join(verdict, "doc_id", "left")
        .filter("component_id is null or component_id = doc_id")
    )
    once = kept.filter("copies is null").select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    first = F.min(F.struct(F.coalesce("text", F.lit("")).alias("order"), "text", *rest)).alias("row")
    again = kept.filter("copies > 1").groupBy("doc_id").agg(first).select(
        "doc_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS[1:]]
    )
    return once.unionByName(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller document has too are cut out of the text;
    a document of which nothing is left stays, with an empty text."""
    kept = suffixes.remove_repeats(docs.select(*COLUMNS), keep_text=True)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to equal weights per level, nine tenths of all tokens; a document that
    several epochs draw comes several times."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return pieces.encode(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    steps = Steps(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = steps.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
