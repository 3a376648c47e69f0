"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# UTC keeps epoch arithmetic on TIMESTAMP_NTZ columns well defined; AQE sizes
# shuffle partitions, splits skewed joins and drops branches that turn out empty.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when no frame refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lagledger")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither the session nor its context names one (tests, one
    machine) a fresh temporary folder is made, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            return named.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in :func:`shared_folder`; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer files than cores dealt out evenly, for work that is heavy per row.

    A table of many files is read in parallel as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def tasks_for(spark: SparkSession, rows: int, per_task: int = 1_000_000) -> int | None:
    """Tasks for a shuffle of so many rows; None where the session's number leaves no more than ``per_task`` to each."""
    tasks = -(-rows // per_task)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast hint only after counting that there are at most ``rows`` rows; a larger side is shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
