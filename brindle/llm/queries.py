"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.clean import key_form, log_time
from brindle.llm import bpe, leakage, ocr_repair, pairs, pii, quantiles, toxicity
from brindle.plans.registry import key_sql, time_sql
from brindle.session import cut_lineage
from brindle.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _free_texts(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "search_logs", "id", "query", "answer")
    two = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("query", "answer")]))
    pairs_ = logs.select(F.lit("search_logs").alias("src"), F.col("id").alias("row_id"), two.alias("x")).select("src", "row_id", "x.field", "x.text")
    scans = table(spark, d, "ocr_results", "result_id", "text").select(F.lit("ocr_results").alias("src"), F.col("result_id").alias("row_id"), F.lit("text").alias("field"), "text")
    return pairs_.unionByName(scans).where("text is not null and row_id is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of personal information each text field names."""
    return pii.list_mentions(_free_texts(spark, d)).select("src", "row_id", "field", "kind").distinct()


def p2_masked_logs(spark: SparkSession, d: str) -> DataFrame:
    """Queries and answers with placeholders for personal information."""
    return pii.redact(table(spark, d, "search_logs", "id", "query", "answer"), "query", "answer")


def p2_masked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts with placeholders for personal information."""
    return pii.redact(table(spark, d, "ocr_results", "result_id", "text"), "text")


def _repaired(spark: SparkSession, d: str) -> ocr_repair.Repair:
    pages = table(spark, d, "ocr_results", "result_id", "file_id", "page_no", "pages", "text")
    return ocr_repair.repair_pages(pages, ocr_repair.clean_words(F.col("text"), table(spark, d, "documents", "text").where("text is not null")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces of the printed page in each scanned text."""
    return _repaired(spark, d).noise()


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts as continuous paragraphs."""
    return _repaired(spark, d).paragraphs()


def _durations(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "search_logs", "search_mode", "model", "created_at", "processing_time")
    return logs.select("search_mode", key_form("model").alias("model"), F.to_date(log_time("created_at")).alias("day"), F.when(F.col("processing_time") >= 0, F.col("processing_time")).alias("seconds"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of processing_time per mode, model and day, and per mode and model over all days (day null, level 'all')."""
    daily = quantiles.log_sketch(_durations(spark, d), ["search_mode", "model", "day"], F.col("seconds"))
    of_day = quantiles.sketch_percentiles(daily, ["search_mode", "model", "day"]).withColumn("level", F.lit("day"))
    overall = quantiles.sketch_percentiles(quantiles.merge_sketches(daily, ["search_mode", "model"]), ["search_mode", "model"])
    return of_day.unionByName(overall.select("search_mode", "model", F.lit(None).cast("date").alias("day"), *overall.columns[2:], F.lit("all").alias("level"))).select(
        "search_mode", "model", F.date_format("day", "yyyy-MM-dd").alias("day"), "level", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p95", "p99")]
    )


def p4_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The daily bucket counts from which percentiles of any days can be had."""
    return quantiles.log_sketch(_durations(spark, d), ["search_mode", "model", "day"], F.col("seconds")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose answer is unfit, with the defect."""
    return pairs.find_defects(table(spark, d, "search_logs", "id", "query", "answer"), F.col("id"), F.col("query"), F.col("answer"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents", "doc_id", "text"), F.col("doc_id"), F.col("text"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "lang", "passage")
    return leakage.find_leaks(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("passage"), F.col("lang"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items that they contain."""
    return _leaks(spark, d).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that hold no test passage."""
    return leakage.clean_corpus(table(spark, d, "documents", "doc_id"), "doc_id", _leaks(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return toxicity.score_documents(docs, F.col("doc_id"), F.col("text"), toxicity.fit(docs, F.col("text")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scored(spark, d).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document."""
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, toxic ones, and their share."""
    scored = cut_lineage(_scored(spark, d).select("doc_id", "score"))
    return toxicity.source_rates(table(spark, d, "documents", "doc_id", "source").join(scored, "doc_id"), "source")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (p2_found, p2_masked_logs, p2_masked_pages, p3_found, p3_paragraphs, p4_percentiles, p4_sketch, p5_found, p8_ids, p9_found, p9_clean, p10_found, p10_scores, p10_rates)
}

_SKETCH = f"""
WITH m AS (
  SELECT search_mode, {key_sql("model")} AS model, processing_time AS v, strftime({time_sql("created_at")}, '%Y-%m-%d') AS day
  FROM search_logs WHERE processing_time >= 0 AND NOT isnan(processing_time) AND NOT isinf(processing_time)),
sketch AS (
  SELECT search_mode, model, day, CASE WHEN v = 0 THEN 0 ELSE 1 END AS sign,
         CASE WHEN v = 0 THEN 0 ELSE CAST(ceil(ln(v) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INT) END AS exp, count(*) AS n
  FROM m GROUP BY ALL)"""
_PERCENTILES = f"""{_SKETCH},
levels AS (
  SELECT search_mode, model, day, 'day' AS level, sign, exp, n FROM sketch
  UNION ALL SELECT search_mode, model, NULL, 'all', sign, exp, CAST(sum(n) AS BIGINT) FROM sketch GROUP BY search_mode, model, sign, exp),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY search_mode, model, day, level ORDER BY sign, exp ROWS UNBOUNDED PRECEDING) AS below,
         sum(n) OVER (PARTITION BY search_mode, model, day, level) AS every,
         CASE WHEN sign = 0 THEN 0.0::DOUBLE ELSE pow(1.01::DOUBLE / 0.99::DOUBLE, exp) * (2 / (1.01::DOUBLE / 0.99::DOUBLE + 1)) END AS v
  FROM levels)
SELECT search_mode, model, day, level, CAST(max(every) AS BIGINT) AS n,
       round(min(CASE WHEN below >= ceil(0.5::DOUBLE * every) THEN v END), 6) AS p50, round(min(CASE WHEN below >= ceil(0.9::DOUBLE * every) THEN v END), 6) AS p90,
       round(min(CASE WHEN below >= ceil(0.95::DOUBLE * every) THEN v END), 6) AS p95, round(min(CASE WHEN below >= ceil(0.99::DOUBLE * every) THEN v END), 6) AS p99
FROM run GROUP BY search_mode, model, day, level"""
_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, coalesce(lang, '') AS lang, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE lang <> 'zh')),
ds AS (SELECT doc_id, array_to_string(w, '') AS s FROM d),
dc AS (SELECT doc_id, substr(s, k, 20) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 18)) AS k FROM ds WHERE length(s) >= 20)),
js AS (SELECT item_id, array_to_string(w, '') AS s FROM i WHERE lang = 'zh'),
ic AS (SELECT DISTINCT item_id, substr(s, k, 20) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 18)) AS k FROM js WHERE length(s) >= 20))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g) UNION SELECT DISTINCT doc_id, item_id FROM dc JOIN ic USING (g)"""

ORACLE: dict[str, str] = {
    "p4_sketch": f"{_SKETCH} SELECT * FROM sketch",
    "p4_percentiles": _PERCENTILES,
    "p9_found": _LEAKS,
    "p9_clean": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_LEAKS}))",
}
