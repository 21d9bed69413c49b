"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "corpus_spark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over them.

    Shuffle partition counts stay with the cluster: AQE merges small partitions and splits skewed
    join partitions, so the only thing fixed here is what results depend on.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Batches to Python are bounded by size as well as by rows, for tables of long texts.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        # Staged rows go when the frame that reads them does.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Plans are built by library code; recording the Python line of every expression is slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names, which all executors share.

    A local session without one gets a temporary folder of this machine (tests); on a cluster that
    is an error, because executors do not see each other's disks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus_spark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The frame written to the scratch folder and read back from there.

    Row placement and generated ids are then facts on shared storage: a lost executor re-reads
    them, it cannot recompute them differently.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
