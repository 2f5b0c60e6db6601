"""Structured Streaming: running totals, sessions, debounced changes, rate-limited alerts, and an index kept up to date.

A table is read as a stream and worked off until nothing is left; results go to Parquet in the shared folder, keyed by
batch, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import words
from brindle.operators.snapshots import latest
from brindle.session import checkpoint_dir
from brindle.sources.sinks import current_version, read_version, write_version


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def work_off(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "update", folder: str | None = None) -> None:
    """Runs a stream until its source has nothing left, handing each batch to ``each``."""
    folder = folder or f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4()}"
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def collect_updates(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The last row of each key that a stream puts out."""
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4()}"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    work_off(stream, each, mode, folder)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    return latest(rows, keys, F.col("batch")).drop("batch")


def daily_totals(events: DataFrame, time: str, group: str, value: str, late: str = "1 day") -> DataFrame:
    """Rows (group, day, events, total), updated as events come; those later than ``late`` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.col(group), F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(group, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "events", "total")


def sessions(events: DataFrame, time: str, entity: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows (entity, start, end, events) by session windows; put out once complete, or as a whole in complete mode."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.col(entity), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def debounced(changes: DataFrame, time: str, path: str, action: str, quiet: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Rows (path, at, action): the last of a burst of changes to a path, bursts being ``quiet`` apart."""
    timed = changes.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    bursts = timed.groupBy(F.col(path), F.session_window(time, quiet).alias("w")).agg(F.max(time).alias("at"), F.max_by(action, time).alias("action"))
    return bursts.select(path, "at", "action")


def rate_limited(alerts: DataFrame, time: str, category: str, seconds: int = 300, late: str = "1 day") -> DataFrame:
    """Rows (category, at): alerts that come ``seconds`` or more after the last one sent of their category.

    Alerts are made distinct times of a burst first; a burst ends with a gap of ``seconds``, after which the next alert
    is sent whatever was sent before. So each burst, put out once the watermark has passed it, is decided by itself, no
    state outlives it, and the alerts of a busy category are spread over its bursts. Alerts that are later than ``late``
    are left out.
    """

    @F.pandas_udf("array<bigint>")
    def sent(bursts: pd.Series) -> pd.Series:
        def choose(times) -> list[int]:
            out: list[int] = []
            for t in sorted(times):
                if not out or t - out[-1] >= seconds * 1_000_000:
                    out.append(int(t))
            return out

        return bursts.map(choose)

    timed = alerts.where(F.col(category).isNotNull() & F.col(time).isNotNull()).select(F.col(category).cast("string").alias("category"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    bursts = timed.groupBy("category", F.session_window("time", f"{seconds} seconds")).agg(F.collect_set(F.unix_micros("time")).alias("times"))
    return bursts.select("category", F.explode(sent("times")).alias("at"))


#: Folders of a kept index, by the hash of the document.
BUCKETS = 32


def keep_index(changes: DataFrame, folder: str, doc_id: str, text: str, deleted: str) -> None:
    """Works changes of documents into the postings (doc_id, term, tf, bucket) kept in ``folder``.

    Postings lie in buckets by hash of the document; each has its own versions behind a pointer, so a batch rewrites the
    buckets of the documents it touches and no others. Of several changes to a document in a batch the one that
    ``changes`` numbers highest in ``seq`` counts. A batch that is repeated gives the same postings.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest(batch.select(doc_id, text, deleted, "seq"), [doc_id], F.col("seq")).withColumn("bucket", F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")).persist()
        posted = last.where(~F.coalesce(F.col(deleted), F.lit(False))).select(doc_id, "bucket", F.explode(words(text)).alias("term")).groupBy("bucket", doc_id, "term").agg(F.count(F.lit(1)).alias("tf")).persist()
        for b in sorted(r.bucket for r in last.select("bucket").distinct().collect()):  # at most BUCKETS
            place, new = f"{folder}/bucket-{b}", posted.where(F.col("bucket") == b).select(doc_id, "term", "tf")
            if current_version(spark, place) is not None:
                new = read_version(spark, place).join(last.where(F.col("bucket") == b).select(doc_id), doc_id, "left_anti").unionByName(new)
            write_version(new, place)
        posted.unpersist()
        last.unpersist()

    work_off(changes, each, "append")


def kept_postings(spark: SparkSession, folder: str) -> DataFrame | None:
    """The postings (doc_id, term, tf) as the last batch left them; None where nothing was written."""
    out = None
    for b in range(BUCKETS):
        if current_version(spark, f"{folder}/bucket-{b}") is not None:
            part = read_version(spark, f"{folder}/bucket-{b}")
            out = part if out is None else out.unionByName(part)
    return out
