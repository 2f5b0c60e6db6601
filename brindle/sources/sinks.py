"""Writing: versions of a table behind a pointer, mirrored paths, exports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def current_version(spark: SparkSession, folder: str) -> int | None:
    """Number of the version that the folder's pointer names; None if there is none."""
    fs, _, jvm = _fs(spark, folder)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    if not fs.exists(pointer):
        return None
    return int(spark.read.text(f"{folder}/CURRENT").first()[0])


def write_version(df: DataFrame, folder: str, *partition: str) -> int:
    """Writes ``df`` beside the present version and then turns the pointer; readers see the one or the other."""
    spark = df.sparkSession
    number = (current_version(spark, folder) or 0) + 1
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{folder}/v{number}")
    fs, _, jvm = _fs(spark, folder)
    draft, pointer = jvm.org.apache.hadoop.fs.Path(f"{folder}/.CURRENT.{number}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    stream = fs.create(draft, True)
    stream.write(bytearray(f"{number}\n".encode()))
    stream.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, pointer, _overwrite(spark))
    return number


def _overwrite(spark: SparkSession):
    """The option by which a rename replaces its target in one step."""
    gateway = spark.sparkContext._gateway
    options = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = gateway.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    return options


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder}/v{number or current_version(spark, folder)}")


def output_paths(files: DataFrame, path: str) -> DataFrame:
    """Adds ``output_path``: the path with .md; later ones of the same output, case aside, get _1, _2 ... by their order."""
    base = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    place = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy(path)) - 1
    return files.withColumn("output_path", F.concat(base, F.when(place > 0, F.concat(F.lit("_"), place.cast("string"))).otherwise(""), F.lit(".md")))


def result_summary(hits: DataFrame, score: str, source: str) -> DataFrame:
    """One row: hits, mean score, and the three sources with most hits."""
    per = hits.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"))
    top = per.orderBy(F.desc("n"), source).limit(3).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(source).alias("source")))).alias("l")).select(F.transform("l", lambda x: x["source"]).alias("top_sources"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), (F.sum("s") / F.sum("n")).alias("mean_score")).join(top)


def export(df: DataFrame, folder: str, kind: str) -> None:
    """Writes results as 'json', 'csv' or 'markdown' lines."""
    if kind == "markdown":
        cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\n]", " ") for c in df.columns]
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(folder)
    else:
        df.write.mode("overwrite").option("header", "true").format(kind).save(folder)
