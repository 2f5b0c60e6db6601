"""Queries that put results together: context under a limit, merged variants, recall, best runs, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import masking
from brindle.functions import text as T
from brindle.functions.clean import key_form
from brindle.functions.conditions import conditions
from brindle.operators import index, recall
from brindle.plans.base import Registry
from brindle.plans.retrieval import ALL_FIELDS, _index, _terms, bm25_sql
from brindle.plans.sql import key_sql
from brindle.sources.tables import table

register = Registry()


@register(
    bm25_sql(ALL_FIELDS, "").rstrip()
    + """,
s1 AS (SELECT query_id, rank, doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END AS piece FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10 AND text IS NOT NULL),
s2 AS (SELECT *, sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM s1)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, md5(piece) AS piece_md5, CAST(upto AS BIGINT) AS upto FROM s2 WHERE upto <= 1500"""
)
def context_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Heads of each query's ten best documents, as many as fit into 1,500 characters."""
    best = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d))
    pieces = best.join(table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.snippet("text", 300).alias("piece")), "doc_id")
    upto = F.sum(F.length("piece").cast("bigint")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("upto", upto).where("upto <= 1500").select("query_id", "rank", "doc_id", F.md5("piece").alias("piece_md5"), "upto")


@register(
    bm25_sql(ALL_FIELDS, "").rstrip()
    + """,
v AS (SELECT coalesce(category, '') AS category, doc_id, max(score) AS score, count(DISTINCT query_id) AS variants FROM ranked JOIN eval_items e ON e.item_id = query_id WHERE rank <= 5 GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, doc_id) AS place FROM v)
SELECT category, CAST(place AS INT) AS place, doc_id, score, variants FROM z WHERE place <= 25"""
)
def merged_variants(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all queries of a category made into one list: each document once, by its best score."""
    best = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), k=5)
    groups = table(spark, d, "eval_items", "item_id", "category").select(F.col("item_id").alias("query_id"), F.coalesce("category", F.lit("")).alias("category"))
    merged = best.join(groups, "query_id").groupBy("category", "doc_id").agg(F.max("score").alias("score"), F.countDistinct("query_id").alias("variants"))
    placed = merged.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "doc_id"))).where("place <= 25")
    return placed.select("category", "place", "doc_id", "score", "variants")


@register(
    """WITH l AS (SELECT lower(trim(query)) AS question, max(id) AS id FROM search_logs WHERE success = 1 AND query IS NOT NULL AND answer IS NOT NULL GROUP BY 1),
e AS (SELECT item_id, lower(trim(query)) AS asked FROM eval_items WHERE query IS NOT NULL),
m AS (SELECT item_id, id, CASE WHEN question = asked THEN 1 WHEN contains(question, substr(asked, 1, 20)) THEN 2 WHEN contains(question, substr(asked, 1, 4)) THEN 3 ELSE 4 END AS class FROM e JOIN l ON contains(question, substr(asked, 1, 2)) WHERE asked <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY class, id DESC) AS place FROM m)
SELECT item_id, CAST(place AS INT) AS place, id, CAST(class AS INT) AS class FROM r WHERE place <= 3"""
)
def recalled_questions(spark: SparkSession, d: str) -> DataFrame:
    """For each query the three best questions of the log: the same one first, then those that hold its first 20, 4 or 2 characters anywhere, newest first."""
    logs = table(spark, d, "search_logs", "id", "query", "answer", "success").where("success = 1 and query is not null and answer is not null")
    known = logs.groupBy(F.lower(F.trim("query")).alias("question")).agg(F.max("id").alias("id"))
    asked = table(spark, d, "eval_items", "item_id", "query").where("query is not null").select("item_id", F.lower(F.trim("query")).alias("asked"))
    return recall.recalled(asked, known, "item_id", "asked", "question", "id", (20, 4, 2), 3).select("item_id", "place", "id", "class")


@register(
    f"""WITH e AS (SELECT {key_sql('token_id')} AS token_id, CAST(created_at AS DATE) AS day, id, endpoint, row_number() OVER (PARTITION BY {key_sql('token_id')}, CAST(created_at AS DATE) ORDER BY created_at DESC, id DESC) AS place FROM auth_log WHERE created_at IS NOT NULL)
SELECT token_id, strftime(day, '%Y-%m-%d') AS day, CAST(place AS INT) AS place, id, endpoint FROM e WHERE place <= 10 AND token_id IS NOT NULL"""
)
def last_requests(spark: SparkSession, d: str) -> DataFrame:
    """The last ten requests of each token and day."""
    log = table(spark, d, "auth_log", "id", "token_id", "endpoint", "created_at").where("created_at is not null")
    keyed = log.select(key_form("token_id").alias("token_id"), F.date_format("created_at", "yyyy-MM-dd").alias("day"), "id", "endpoint", "created_at").where("token_id is not null")
    place = F.row_number().over(Window.partitionBy("token_id", "day").orderBy(F.desc("created_at"), F.desc("id")))
    return keyed.withColumn("place", place).where("place <= 10").select("token_id", "day", "place", "id", "endpoint")


@register(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_no ORDER BY coalesce(confidence, -1) DESC, length(text) DESC, result_id DESC) AS place FROM ocr_results WHERE success AND text IS NOT NULL AND NOT isnan(coalesce(confidence, -1)))
SELECT file_id, page_no, result_id, confidence FROM r WHERE place = 1"""
)
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    """Of the runs over a page the one with the highest confidence, then the longest text, then the newest."""
    runs = table(spark, d, "ocr_results", "file_id", "page_no", "result_id", "confidence", "text", "success").where("success and text is not null and not isnan(coalesce(confidence, -1))")
    order = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("a"), F.length("text").alias("b"), F.col("result_id").alias("c"))
    return runs.groupBy("file_id", "page_no").agg(F.max_by(F.struct("result_id", "confidence"), order).alias("r")).select("file_id", "page_no", "r.result_id", "r.confidence")


@register("SELECT id, CAST(json_extract_string(metadata_json, '$.pages') AS INT) AS pages, len(CAST(json_extract(metadata_json, '$.headings') AS JSON[])) AS headings, json_extract_string(metadata_json, '$.headings[0].text') AS first_heading FROM convert_files WHERE json_valid(metadata_json) AND json_type(metadata_json) = 'OBJECT'")
def catalogue_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Pages and headings from the catalogue's JSON."""
    files = table(spark, d, "convert_files", "id", "metadata_json").where(F.json_object_keys("metadata_json").isNotNull())
    parsed = files.select("id", F.from_json("metadata_json", "pages int, headings array<struct<level:int,text:string>>").alias("m"))
    return parsed.select("id", "m.pages", F.size("m.headings").alias("headings"), F.try_element_at("m.headings", F.lit(1))["text"].alias("first_heading")).withColumn("headings", F.when(F.col("headings") >= 0, F.col("headings")))


@register("SELECT id FROM convert_files WHERE lower(extension) IN ('.pdf', '.docx') AND starts_with(lower(relative_path), 'hr/') AND file_size >= 1000000 AND coalesce(last_error, '') = ''")
def condition_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files by conditions that are given as data."""
    files = table(spark, d, "convert_files", "id", "extension", "relative_path", "file_size", "last_error")
    listed = [("extension", "in", [".pdf", ".docx"]), ("relative_path", "start with", "HR/"), ("file_size", ">=", "1000000"), ("last_error", "empty", None)]
    return files.where(conditions({c: F.col(c) for c in files.columns}, listed)).select("id")


@register(f"SELECT id, md5(regexp_replace(answer, '{masking.PATTERNS['EMAIL']}', '[EMAIL]', 'g')) AS masked_md5, CAST(len(regexp_extract_all(answer, '{masking.PATTERNS['EMAIL']}')) AS INT) AS masks FROM search_logs WHERE answer IS NOT NULL")
def masked_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their e-mail addresses masked for good, by their hash, and how many were."""
    hidden = masking.mask_only(F.col("answer"), {"EMAIL": masking.PATTERNS["EMAIL"]})
    logs = table(spark, d, "search_logs", "id", "answer").where("answer is not null")
    return logs.select("id", F.md5(hidden).alias("masked_md5"), F.regexp_count("answer", F.lit(masking.PATTERNS["EMAIL"])).alias("masks"))


@register("SELECT id, md5(answer) AS restored_md5 FROM search_logs WHERE answer IS NOT NULL")
def masks_taken_off(spark: SparkSession, d: str) -> DataFrame:
    """Answers masked with numbered placeholders and restored from them, by their hash."""
    logs = table(spark, d, "search_logs", "id", "answer").where("answer is not null").select("id", masking.masked(F.col("answer"), words=("deductible", "免赔额")).alias("m"))
    return logs.select("id", F.md5(masking.unmasked(F.col("m.text"), F.col("m.mapping"))).alias("restored_md5"))


@register(
    """WITH a AS (SELECT index_path, id, lag(id) OVER w AS before, list_distinct(regexp_extract_all(search_hits_json, '"doc_id": ?"([0-9a-f]{16})"', 1)) AS hits, lag(list_distinct(regexp_extract_all(search_hits_json, '"doc_id": ?"([0-9a-f]{16})"', 1))) OVER w AS earlier
FROM search_logs WHERE session_id IS NOT NULL AND search_hits_json IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY id))
SELECT id, before, len(list_intersect(hits, earlier)) AS shared, len(hits) AS found FROM a WHERE before IS NOT NULL"""
)
def repeated_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many hits of a search its session's search before had found already."""
    logs = table(spark, d, "search_logs", "id", "session_id", "search_hits_json").where("session_id is not null and search_hits_json is not null")
    line = Window.partitionBy("session_id").orderBy("id")
    hits = logs.select("id", "session_id", F.array_distinct(F.regexp_extract_all("search_hits_json", F.lit('"doc_id": ?"([0-9a-f]{16})"'), F.lit(1))).alias("hits"))
    both = hits.withColumn("before", F.lag("id").over(line)).withColumn("earlier", F.lag("hits").over(line)).where("before is not null")
    return both.select("id", "before", F.size(F.array_intersect("hits", "earlier")).cast("bigint").alias("shared"), F.size("hits").cast("bigint").alias("found"))
