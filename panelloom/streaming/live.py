"""Live jobs: drift, response distributions and screening on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelloom.operators import distributions as dist
from panelloom.operators import stats, text
from panelloom.session import materialize, n_rows


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema of the files already there.

    ``path`` may be a folder or one file: a stream takes a single file only as a
    pattern, so the last character becomes a one-letter class.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def write_in_turn(df: DataFrame, path: str, parts: int, order: Column) -> str:
    """``df`` as ``parts`` files, written one after the other in ranges of ``order``: what a stream
    that takes one file per trigger reads as so many micro-batches."""
    dealt = materialize(
        df.repartitionByRange(parts, order).withColumn("__turn", F.spark_partition_id()), "turns"
    )
    for turn in range(parts):
        dealt.filter(F.col("__turn") == turn).drop("__turn").coalesce(1).write.mode("append").parquet(path)
    return path


def run_available(
    frame: DataFrame, path: str, mode: str = "append", counts: dict[str, int] | None = None
) -> DataFrame:
    """Process what is there and return the written rows.

    Each micro-batch goes to a folder of its own, replaced on a retry, so a
    restart neither loses nor doubles rows. ``counts`` gets the micro-batches with rows and the
    rows that came behind the watermark (``late``).
    """
    schema = T.StructType([*frame.schema.fields, T.StructField("batch", T.IntegerType())])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (
        frame.writeStream.outputMode(mode).foreachBatch(put)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if counts is not None:
        progress = query.recentProgress
        counts["batches"] = sum(p.numInputRows > 0 for p in progress)
        counts["late"] = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    return frame.sparkSession.read.schema(schema).parquet(f"{path}/rows")


# --- drift --------------------------------------------------------------------

def drift_stream(
    purchases: DataFrame, path: str, k: int = 3, k_sigma: float = 3.0, lateness: str = "31 days",
    period: str = "30 days",
) -> StreamingQuery:
    """Each closed period adds its category counts; the decision follows.

    Counts of a period leave the aggregation once the watermark passes it and are
    stored outside the stream state, so the baseline (the first ``k`` closed
    periods) is frozen there.
    """
    spark = purchases.sparkSession
    timed = purchases.withColumn(
        "event_time", F.col("transaction_date").cast("timestamp")
    ).withWatermark("event_time", lateness)
    start = F.window("event_time", period)
    closed = timed.groupBy(start.alias("window"), F.col("product_category").alias("category")).agg(
        n_rows().alias("n")
    ).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("period"), "category", "n"
    )

    def decide(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        counts = read_counts(spark, path)
        if counts.select("period").distinct().count() <= k:
            return
        series = stats.drift_from_counts(counts, k, stats.SMOOTHING * k)
        series.write.mode("overwrite").parquet(f"{path}/series/batch={number}")
        decision = stats.drift_decision(series, k_sigma)
        decision.write.mode("overwrite").parquet(f"{path}/decision/batch={number}")

    return (
        closed.writeStream.outputMode("append").foreachBatch(decide)
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/counts").groupBy("period", "category").agg(
        F.sum("n").alias("n")
    )


def latest(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The newest stored series or decision."""
    rows = spark.read.parquet(f"{path}/{part}")
    newest = rows.agg(F.max("batch").alias("b")).scalar()
    return rows.filter(F.col("batch") == newest).drop("batch")


# --- distributions and screening -----------------------------------------------

def live_distribution(
    responses: DataFrame, catalog: DataFrame, time: str, lateness: str = "1 day"
) -> DataFrame:
    """Counts per option, each response id counted once within the watermark."""
    unique = responses.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["response_id"])
    options = dist.option_table(catalog)
    return unique.join(
        options, (unique["question_id"] == options["question_id"]) & (unique["answer"] == options["option"])
    ).groupBy(options["question_id"], "option_idx", "option").agg(n_rows().alias("count"))


def screen_stream(responses: DataFrame, answer: str = "answer", reasoning: str = "reasoning") -> DataFrame:
    """The red-team screen is made of column expressions, so a stream needs nothing else."""
    return text.red_team(responses, answer, reasoning)
