"""Spark session for stand-alone runs and tests; a cluster's own session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings every plan of the library relies on or profits from.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "brindle", **conf: str) -> SparkSession:
    """A local session; ``conf`` adds settings (dots written as ``__``)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("BRINDLE_DRIVER_MEMORY", "8g"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``; in local mode, where it is unset (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if folder:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(folder)
        return folder
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def spread(df):
    """``df`` over all cores where it comes in fewer partitions than there are (a small table in few files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df):
    """``df`` written once to the shared folder, so that what follows reads one and the same copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
