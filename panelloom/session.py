"""Session helpers: durable lineage cuts and one-row scalars."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "panelloom", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialized steps.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own; elsewhere a missing setting is an
    error, because executors could not read each other's local disks.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="panelloom-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is read in fewer parts than cores.

    For work that costs far more than moving the rows, such as pattern screens; a
    table of many parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage durably (a lost executor re-reads files), fixes
    partition-dependent columns, and keeps later reads columnar.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/panelloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` stored and that nothing reads any more."""
    context = stored.sparkSession.sparkContext
    root = checkpoint_root(stored.sparkSession).rpartition(":")[2].lstrip("/")
    for folder in {name.rpartition("/")[0] for name in stored.inputFiles()}:
        if f"/{root}/panelloom/" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, label: str, rows: int = 100_000, size: int = 8 << 20) -> DataFrame:
    """A stored table, sent to every task if it has at most ``rows`` rows and its files at most
    ``size`` bytes; a larger one is left to Spark's own choice of join."""
    stored = materialize(df, label)
    held = int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(stored) if held <= size and stored.count() <= rows else stored


def small_table(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A constant table of a few rows, planned without a Python stage."""
    cells = [
        F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))


def n_rows() -> Column:
    """Row count aggregate."""
    return F.count(F.lit(1)).cast("bigint")


def one(df: DataFrame, value: Column) -> Column:
    """The single value of an ungrouped aggregate, as a scalar subquery.

    Replaces a cross join with a one-row frame: Spark runs the aggregate once and
    hands the value to every task.
    """
    return df.agg(value.alias("value")).scalar()
