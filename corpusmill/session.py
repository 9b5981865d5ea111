"""Sessions and lineage: a local session for tests and the bench, and cuts that survive a lost executor."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session, as the tests and the bench use it, with settings for one machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("corpusmill")
    settings = {
        "spark.sql.shuffle.partitions": os.environ.get("CORPUSMILL_PARTITIONS", "8"),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("CORPUSMILL_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # single-file tables are dealt over the cores (see `tables`)
        "spark.corpusmill.deal": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut.

    The folder is the one the session names in spark.checkpoint.dir. Where none is named, a local session, as in
    tests on one machine, gets a temporary one; on a cluster that is an error, for the executors share no such folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusmill-checkpoint-"))
    return df.checkpoint()
