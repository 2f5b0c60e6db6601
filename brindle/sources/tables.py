"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; only ``columns`` are read if any are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def kept_folder(df: DataFrame, name: str) -> str:
    """Folder for something made from ``df``'s files, in the shared folder; another one as soon as any of the files changes."""
    files = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    state = files.agg(F.count(F.lit(1)), F.bit_xor("h")).first()
    return f"{checkpoint_dir(df.sparkSession)}/{name}-{state[0]}-{(state[1] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def is_kept(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to the folder to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
