"""Session helpers: sane defaults for tests, and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: str = "8", app: str = "outlane", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench.  A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a local session may go without: a folder of the driver's machine is
    not seen by executors elsewhere.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result out and cut its lineage.

    Used where a costly result has more than one reader.  ``checkpoint`` lands
    in the shared folder, so a lost executor costs a re-read, not a re-run.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
