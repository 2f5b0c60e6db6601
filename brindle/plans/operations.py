"""Statistics over the catalogue and the logs, snapshots and merges, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.clean import key_form, log_time
from brindle.operators import nested, ranks, snapshots
from brindle.plans.base import Registry
from brindle.plans.sql import key_sql, time_sql
from brindle.sources.tables import table

register = Registry()

GOOD_TIME = "processing_time >= 0 AND NOT isnan(processing_time)"


def _good_time():
    return F.when((F.col("processing_time") >= 0) & ~F.isnan("processing_time"), F.col("processing_time"))


@register("SELECT coalesce(search_mode, CASE WHEN grouping(search_mode) = 1 THEN '(all)' ELSE '(none)' END) AS search_mode, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens, count(*) AS searches FROM search_logs GROUP BY ROLLUP(search_mode)")
def usage_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per mode, with the grand total."""
    logs = table(spark, d, "search_logs", "search_mode", "tokens_used")
    out = logs.rollup("search_mode").agg(F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("searches"), F.grouping("search_mode").alias("g"))
    return out.select(F.coalesce("search_mode", F.when(F.col("g") == 1, "(all)").otherwise("(none)")).alias("search_mode"), "tokens", "searches")


@register(f"SELECT strftime({time_sql('created_at')}, '%Y-%m-%d') AS day, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens, count(*) AS searches FROM search_logs GROUP BY 1")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per day."""
    logs = table(spark, d, "search_logs", "created_at", "tokens_used")
    return logs.groupBy(F.date_format(log_time("created_at"), "yyyy-MM-dd").alias("day")).agg(F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("searches"))


@register(f"SELECT {key_sql('model')} AS model, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens, count(*) AS searches, round(avg(tokens_used), 6) AS mean_tokens FROM search_logs GROUP BY 1")
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per model, spelling aside."""
    logs = table(spark, d, "search_logs", "model", "tokens_used")
    return logs.groupBy(key_form("model").alias("model")).agg(F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("searches"), F.round(F.avg("tokens_used"), 6).alias("mean_tokens"))


@register(
    """SELECT 'summary' AS section, 'all' AS item, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens, count(*) AS searches FROM search_logs
UNION ALL SELECT 'mode', coalesce(search_mode, ''), CAST(sum(coalesce(tokens_used, 0)) AS BIGINT), count(*) FROM search_logs GROUP BY 2
UNION ALL SELECT 'source', coalesce(source, ''), CAST(sum(coalesce(tokens_used, 0)) AS BIGINT), count(*) FROM search_logs GROUP BY 2"""
)
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a usage report in one table, from one pass over the log."""
    logs = table(spark, d, "search_logs", "search_mode", "source", "tokens_used")
    item = F.explode(F.array(F.struct(F.lit("summary").alias("section"), F.lit("all").alias("item")), F.struct(F.lit("mode").alias("section"), F.coalesce("search_mode", F.lit("")).alias("item")), F.struct(F.lit("source").alias("section"), F.coalesce("source", F.lit("")).alias("item"))))
    return logs.select(item.alias("i"), "tokens_used").groupBy("i.section", "i.item").agg(F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("searches"))


@register("SELECT coalesce(extension, '') AS extension, count(*) FILTER (WHERE status = 'converted') AS converted, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) AS files FROM convert_files GROUP BY 1")
def status_by_extension(spark: SparkSession, d: str) -> DataFrame:
    """Files of the catalogue by extension and status."""
    files = table(spark, d, "convert_files", "extension", "status")
    return files.groupBy(F.coalesce("extension", F.lit("")).alias("extension")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("converted", "failed", "pending", "skipped")], F.count(F.lit(1)).alias("files"))


@register("SELECT coalesce(status, '') AS status, count(*) AS files, CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS bytes, count(*) FILTER (WHERE ocr_used = 1) AS by_ocr, CAST(sum(coalesce(ocr_total_tokens, 0)) AS BIGINT) AS ocr_tokens, round(avg(CASE WHEN NOT isnan(convert_time) THEN convert_time END), 6) AS mean_seconds FROM convert_files GROUP BY 1")
def catalogue_stats(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue by status."""
    files = table(spark, d, "convert_files", "status", "file_size", "ocr_used", "ocr_total_tokens", "convert_time")
    return files.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"), F.count_if(F.col("ocr_used") == 1).alias("by_ocr"), F.sum(F.coalesce("ocr_total_tokens", F.lit(0))).alias("ocr_tokens"),
        F.round(F.avg(F.when(~F.isnan("convert_time"), F.col("convert_time"))), 6).alias("mean_seconds"),
    )


@register(
    """WITH a AS (SELECT regexp_replace(relative_path, '/[^/]*$', '') AS directory, extension, file_size FROM convert_files WHERE relative_path LIKE '%/%')
SELECT directory, count(*) AS files, CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS bytes, array_to_string(list_sort(list_distinct(list(extension) FILTER (WHERE extension IS NOT NULL))), ', ') AS extensions FROM a GROUP BY 1"""
)
def directory_index(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes and kinds of each directory."""
    files = table(spark, d, "convert_files", "relative_path", "extension", "file_size").where(F.contains("relative_path", F.lit("/")))
    return files.groupBy(F.regexp_replace("relative_path", "/[^/]*$", "").alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"), F.array_join(F.sort_array(F.collect_set("extension")), ", ").alias("extensions"))


@register(
    """WITH a AS (SELECT split_part(relative_path, '/', 1) AS parent, split_part(relative_path, '/', 2) AS child, file_size FROM convert_files WHERE relative_path LIKE '%/%/%')
SELECT parent, coalesce(child, '(all)') AS child, count(*) AS files, CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS bytes FROM a GROUP BY ROLLUP(parent, child) HAVING parent IS NOT NULL"""
)
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    """Totals of directories and of their subdirectories."""
    files = table(spark, d, "convert_files", "relative_path", "file_size").where(F.col("relative_path").like("%/%/%"))
    parts = files.select(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("parent"), F.split_part("relative_path", F.lit("/"), F.lit(2)).alias("child"), "file_size")
    return parts.rollup("parent", "child").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes")).where("parent is not null").select("parent", F.coalesce("child", F.lit("(all)")).alias("child"), "files", "bytes")


@register(
    f"""SELECT coalesce(difficulty, '') AS difficulty, count(*) AS searches, round(100.0::DOUBLE * count(*) FILTER (WHERE success = 1) / count(*), 6) AS success_percent,
round(avg(CASE WHEN {GOOD_TIME} THEN processing_time END), 6) AS mean_seconds, round(avg(tool_calls_count), 6) AS mean_calls FROM search_logs GROUP BY 1"""
)
def diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    """Success, duration and calls by difficulty."""
    logs = table(spark, d, "search_logs", "difficulty", "success", "processing_time", "tool_calls_count")
    return logs.groupBy(F.coalesce("difficulty", F.lit("")).alias("difficulty")).agg(
        F.count(F.lit(1)).alias("searches"), F.round(F.lit(100.0) * F.count_if(F.col("success") == 1) / F.count(F.lit(1)), 6).alias("success_percent"), F.round(F.avg(_good_time()), 6).alias("mean_seconds"), F.round(F.avg("tool_calls_count"), 6).alias("mean_calls")
    )


@register(
    f"""WITH v AS (SELECT coalesce(search_mode, '') AS search_mode, processing_time AS v, row_number() OVER (PARTITION BY coalesce(search_mode, '') ORDER BY processing_time) - 1 AS k, count(*) OVER (PARTITION BY coalesce(search_mode, '')) AS n FROM search_logs WHERE {GOOD_TIME})
SELECT search_mode, max(n) AS n, round(avg(v), 6) AS mean, max(CASE WHEN k = floor(0.5::DOUBLE * n) THEN v END) AS p50_pick, max(CASE WHEN k = floor(0.9::DOUBLE * n) THEN v END) AS p90_pick, max(v) AS max FROM v GROUP BY 1"""
)
def duration_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Durations by mode: mean, the values at half and nine tenths of the sorted list, the longest."""
    logs = table(spark, d, "search_logs", "search_mode", "processing_time").select(F.coalesce("search_mode", F.lit("")).alias("search_mode"), _good_time().alias("t"))
    return ranks.picks(logs, ["search_mode"], F.col("t"), {"p50_pick": 0.5, "p90_pick": 0.9}).withColumn("mean", F.round("mean", 6))


@register(f"SELECT id, search_mode, processing_time FROM search_logs WHERE processing_time >= 30 AND NOT isnan(processing_time) ORDER BY processing_time DESC, id LIMIT 20")
def slow_queries(spark: SparkSession, d: str) -> DataFrame:
    """The twenty slowest searches of half a minute or more (a report)."""
    logs = table(spark, d, "search_logs", "id", "search_mode", "processing_time").where((F.col("processing_time") >= 30) & ~F.isnan("processing_time"))
    return logs.orderBy(F.desc("processing_time"), "id").limit(20)


_CALLS = """WITH a AS (SELECT id, search_mode, CASE WHEN json_valid(tool_calls_json) THEN tool_calls_json::JSON END AS c FROM search_logs),
b AS (SELECT id, search_mode, CASE WHEN json_type(c) = 'VARCHAR' THEN CASE WHEN json_valid(c->>'$') THEN (c->>'$')::JSON END ELSE c END AS c FROM a),
l AS (SELECT id, search_mode, CASE json_type(c) WHEN 'OBJECT' THEN CASE WHEN list_contains(json_keys(c), 'calls') THEN c->'calls' ELSE json_array(c) END ELSE c END AS c FROM b),
calls AS (SELECT id, search_mode, json_extract(c, '$[' || k || ']') AS call FROM (SELECT id, search_mode, c, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS k FROM l WHERE json_type(c) = 'ARRAY')),
ok AS (SELECT id, search_mode, call->>'tool' AS tool, call->>'success' = 'true' AS success FROM calls WHERE json_type(call) = 'OBJECT')"""


@register(f"{_CALLS} SELECT coalesce(search_mode, '') AS search_mode, coalesce(tool, '') AS tool, count(*) AS calls, count(DISTINCT id) AS searches, count(*) FILTER (WHERE success) AS successes FROM ok GROUP BY 1, 2")
def call_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls joined with their searches: calls, searches and successes by mode and tool."""
    logs = table(spark, d, "search_logs", "id", "search_mode", "tool_calls_json")
    calls = nested.flatten_calls(logs, F.col("id"), F.col("tool_calls_json"))
    per_search = calls.groupBy("id", F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("success").alias("successes"))
    joined = per_search.join(logs.select("id", F.coalesce("search_mode", F.lit("")).alias("search_mode")), "id")
    return joined.groupBy("search_mode", "tool").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("searches"), F.sum("successes").alias("successes"))


@register("SELECT count(*) AS n, round(avg(rating), 6) AS mean, count(*) FILTER (WHERE rating >= 4) AS good, count(*) FILTER (WHERE rating <= 2) AS bad, coalesce(comment, '') AS comment FROM answer_feedback WHERE rating BETWEEN 1 AND 5 GROUP BY comment")
def rating_stats(spark: SparkSession, d: str) -> DataFrame:
    """Valid ratings by comment."""
    ratings = table(spark, d, "answer_feedback", "rating", "comment").where("rating between 1 and 5")
    return ratings.groupBy("comment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean"), F.count_if(F.col("rating") >= 4).alias("good"), F.count_if(F.col("rating") <= 2).alias("bad")).withColumn("comment", F.coalesce("comment", F.lit("")))


@register(
    """WITH s AS (SELECT session_id, max_by(search_mode, id) AS search_mode FROM search_logs WHERE session_id IS NOT NULL GROUP BY 1)
SELECT coalesce(search_mode, '') AS search_mode, count(*) AS ratings, round(avg(rating), 6) AS mean FROM answer_feedback JOIN s USING (session_id) WHERE rating BETWEEN 1 AND 5 GROUP BY 1"""
)
def feedback_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Ratings joined with the searches that they judge; a search logged twice counts once."""
    logs = table(spark, d, "search_logs", "id", "session_id", "search_mode").where("session_id is not null")
    ratings = table(spark, d, "answer_feedback", "session_id", "rating").where("rating between 1 and 5")
    joined = ratings.join(snapshots.latest(logs, ["session_id"], F.col("id")), "session_id")
    return joined.groupBy(F.coalesce("search_mode", F.lit("")).alias("search_mode")).agg(F.count(F.lit(1)).alias("ratings"), F.round(F.avg("rating"), 6).alias("mean"))


@register("SELECT id FROM answer_feedback WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM search_logs WHERE session_id IS NOT NULL)")
def orphaned_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of sessions that the log doesn't know."""
    return table(spark, d, "answer_feedback", "id", "session_id").join(table(spark, d, "search_logs", "session_id"), "session_id", "left_anti").select("id")


@register("SELECT session_id, max(id) AS id, max_by(query, id) AS query, count(*) AS logged FROM search_logs WHERE session_id IS NOT NULL AND query IS NOT NULL GROUP BY session_id")
def latest_per_session(spark: SparkSession, d: str) -> DataFrame:
    """The last log row of each session, and how often it was logged."""
    logs = table(spark, d, "search_logs", "id", "session_id", "query").where("session_id is not null and query is not null")
    return logs.groupBy("session_id").agg(F.max("id").alias("id"), F.max_by("query", "id").alias("query"), F.count(F.lit(1)).alias("logged"))


@register("SELECT lower(trim(query)) AS question, max(id) AS id, max_by(md5(answer), id) AS answer_md5, count(*) AS asked FROM search_logs WHERE success = 1 AND query IS NOT NULL AND answer IS NOT NULL GROUP BY 1")
def recalled_answers(spark: SparkSession, d: str) -> DataFrame:
    """The newest successful answer to each question that was asked before."""
    logs = table(spark, d, "search_logs", "id", "query", "answer", "success").where("success = 1 and query is not null and answer is not null")
    return logs.groupBy(F.lower(F.trim("query")).alias("question")).agg(F.max("id").alias("id"), F.max_by(F.md5("answer"), "id").alias("answer_md5"), F.count(F.lit(1)).alias("asked"))


@register("SELECT id, search_mode, source FROM search_logs WHERE success = 1 AND search_mode IN ('agent', 'hybrid') AND list_contains(list_transform(string_split(coalesce(tags, ''), ','), lambda t: trim(t)), 'hr')")
def filtered_logs(spark: SparkSession, d: str) -> DataFrame:
    """Successful searches of two modes with a tag."""
    logs = table(spark, d, "search_logs", "id", "search_mode", "source", "success", "tags")
    return logs.where((F.col("success") == 1) & F.col("search_mode").isin("agent", "hybrid") & F.array_contains(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), F.trim), "hr")).select("id", "search_mode", "source")


@register(f"SELECT {key_sql('token_id')} AS token_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS requests, count(DISTINCT endpoint) AS endpoints, count(*) FILTER (WHERE status_code >= 400) AS errors FROM auth_log WHERE created_at IS NOT NULL GROUP BY 1, 2")
def requests_daily(spark: SparkSession, d: str) -> DataFrame:
    """Requests, endpoints and errors of each token and day."""
    log = table(spark, d, "auth_log", "token_id", "created_at", "endpoint", "status_code").where("created_at is not null")
    return log.groupBy(key_form("token_id").alias("token_id"), F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("endpoint").alias("endpoints"), F.count_if(F.col("status_code") >= 400).alias("errors"))


@register(
    f"""WITH e AS (SELECT {key_sql('token_id')} AS token_id, CAST(created_at AS DATE) AS day, endpoint, created_at, id FROM auth_log WHERE created_at IS NOT NULL),
r AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR endpoint IS DISTINCT FROM lag(endpoint) OVER w THEN 1 ELSE 0 END AS starts FROM e WHERE token_id IS NOT NULL WINDOW w AS (PARTITION BY token_id, day ORDER BY created_at, id)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY token_id, day ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run_no FROM r)
SELECT token_id, strftime(day, '%Y-%m-%d') AS day, CAST(run_no AS BIGINT) AS run_no, endpoint, count(*) AS rows, min(id) AS first, max(id) AS last FROM n GROUP BY ALL"""
)
def endpoint_runs(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the same endpoint that follow each other within a token's day."""
    log = table(spark, d, "auth_log", "token_id", "created_at", "endpoint", "id").where("created_at is not null")
    keyed = log.select(key_form("token_id").alias("token_id"), F.date_format("created_at", "yyyy-MM-dd").alias("day"), "endpoint", "created_at", "id").where("token_id is not null")
    return snapshots.runs(keyed, ["token_id", "day"], ["endpoint"], "created_at", "id")


@register("SELECT token_id, endpoint, epoch_us(created_at) AS at_us, count(*) AS copies, min(id) AS first_id FROM auth_log WHERE created_at IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def repeated_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that were recorded more than once."""
    log = table(spark, d, "auth_log", "token_id", "endpoint", "created_at", "id").where("created_at is not null")
    return log.groupBy("token_id", "endpoint", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at_us")).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


@register("SELECT file_id, count(*) AS runs, count(*) FILTER (WHERE success) AS successes, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS pages, round(avg(confidence), 6) AS confidence, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, coalesce(sum(length(trim(coalesce(text, '')))) < 50 * greatest(sum(coalesce(pages, 0)), 1), false) AS mostly_empty FROM ocr_results GROUP BY file_id")
def scan_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recognition runs by file, and whether a file has fewer than 50 characters a page."""
    runs = table(spark, d, "ocr_results", "file_id", "success", "pages", "confidence", "text")
    return runs.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.round(F.avg("confidence"), 6).alias("confidence"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
        (F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))) < 50 * F.greatest(F.sum(F.coalesce("pages", F.lit(0))), F.lit(1))).alias("mostly_empty"),
    )


@register("SELECT c.id, c.status, r.runs FROM convert_files c JOIN (SELECT file_id, count(*) AS runs FROM ocr_results WHERE success GROUP BY 1) r ON r.file_id = c.id WHERE coalesce(c.ocr_used, 0) = 0")
def unmarked_scans(spark: SparkSession, d: str) -> DataFrame:
    """Files with recognition runs that the catalogue doesn't mark as scanned."""
    runs = table(spark, d, "ocr_results", "file_id", "success").where("success").groupBy("file_id").agg(F.count(F.lit(1)).alias("runs"))
    files = table(spark, d, "convert_files", "id", "status", "ocr_used").where(F.coalesce("ocr_used", F.lit(0)) == 0)
    return files.join(runs, files.id == runs.file_id).select("id", "status", "runs")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the catalogue: files left out, put in, changed and moved by a rule on their ids."""
    files = table(spark, d, "convert_files", "id", "relative_path", "source_hash").where("relative_path is not null")
    base = files.where("id % 10 <> 0").select(F.col("relative_path").alias("path"), F.col("source_hash").alias("hash"))
    moved = F.when(F.col("id") % 10 == 2, F.concat(F.lit("moved/"), F.col("relative_path"))).otherwise(F.col("relative_path"))
    changed = F.when(F.col("id") % 7 == 0, F.concat(F.col("source_hash"), F.lit("x"))).otherwise(F.col("source_hash"))
    return base, files.where("id % 10 <> 1").select(moved.alias("path"), changed.alias("hash"))


_DIFF = """WITH f AS (SELECT id, relative_path AS path, source_hash AS hash FROM convert_files WHERE relative_path IS NOT NULL),
b AS (SELECT path, hash FROM f WHERE id % 10 <> 0),
c AS (SELECT CASE WHEN id % 10 = 2 THEN 'moved/' || path ELSE path END AS path, CASE WHEN id % 7 = 0 THEN hash || 'x' ELSE hash END AS hash FROM f WHERE id % 10 <> 1),
h AS (SELECT hash, max(path) AS origin FROM b WHERE hash <> '' GROUP BY hash),
d AS (SELECT coalesce(b.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN b.path IS NOT NULL THEN CASE WHEN b.hash IS NOT DISTINCT FROM c.hash THEN 'unchanged' ELSE 'changed' END WHEN origin IS NOT NULL THEN 'moved' ELSE 'added' END AS status,
  CASE WHEN b.path IS NULL THEN origin END AS moved_from FROM b FULL OUTER JOIN c ON b.path = c.path LEFT JOIN h ON h.hash = c.hash)"""


@register(f"{_DIFF} SELECT path, status, moved_from FROM d")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """What became of each file between two states of the catalogue."""
    return snapshots.diff(*_snapshots(spark, d))


@register(f"{_DIFF} SELECT status, count(*) AS files FROM d GROUP BY status")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files by what became of them."""
    return snapshots.diff(*_snapshots(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


_MERGED = f"{_DIFF} SELECT coalesce(c.path, b.path) AS path, coalesce(c.hash, b.hash) AS hash FROM b FULL OUTER JOIN c ON b.path = c.path"


@register(_MERGED)
def merged_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The first state with the second put in by path."""
    base, compare = _snapshots(spark, d)
    return snapshots.merge(base, compare, ["path"])


@register("SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN doc_id % 7 = 0 THEN title ELSE text END), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE doc_id % 11 <> 0) GROUP BY ALL) GROUP BY term")
def index_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Term statistics of an index in which some documents were replaced and some deleted: merged, not built anew."""
    docs = table(spark, d, "documents", "doc_id", "title", "text")

    def posted(x: DataFrame, c: str) -> DataFrame:
        return x.select("doc_id", F.explode(T.words(c)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))

    current = posted(docs, "text")
    touched = docs.where("doc_id % 7 = 0 or doc_id % 11 = 0")
    kept = current.join(touched.select("doc_id"), "doc_id", "left_anti")
    new = posted(touched.where("doc_id % 11 <> 0"), "title")
    return kept.unionByName(new).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("tf"))


@register(
    f"""SELECT coalesce(search_mode, '') AS mode, count(*) AS runs, round(avg(success::DOUBLE), 6) AS success_rate, round(avg(CASE WHEN success = 1 AND {GOOD_TIME} THEN processing_time END), 6) AS mean_seconds, round(avg(CASE WHEN success = 1 THEN sources_count END), 6) AS mean_sources FROM search_logs GROUP BY 1"""
)
def benchmark_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Modes compared: success over all runs, means over successful ones."""
    logs = table(spark, d, "search_logs", "search_mode", "success", "processing_time", "sources_count")
    ok = F.col("success") == 1
    return logs.groupBy(F.coalesce("search_mode", F.lit("")).alias("mode")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(ok, _good_time())), 6).alias("mean_seconds"), F.round(F.avg(F.when(ok, F.col("sources_count"))), 6).alias("mean_sources")
    )


_ARMS = f"SELECT {key_sql('model')} AS arm, success::DOUBLE AS s, CASE WHEN {GOOD_TIME} THEN processing_time END AS t FROM search_logs"


@register(f"SELECT arm, count(*) AS n, round(avg(s), 6) AS accuracy, round(coalesce(stddev_samp(s), 0), 6) AS accuracy_sd, round(avg(t), 6) AS seconds, round(coalesce(stddev_samp(t), 0), 6) AS seconds_sd FROM ({_ARMS}) WHERE arm IS NOT NULL GROUP BY arm")
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Models as arms of a comparison: means and standard deviations."""
    logs = table(spark, d, "search_logs", "model", "success", "processing_time").select(key_form("model").alias("arm"), F.col("success").cast("double").alias("s"), _good_time().alias("t")).where("arm is not null")
    sd = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6)
    return logs.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("accuracy"), sd("s").alias("accuracy_sd"), F.round(F.avg("t"), 6).alias("seconds"), sd("t").alias("seconds_sd"))


@register(
    f"""WITH a AS (SELECT arm, count(*) AS n, avg(s) AS p, count(t) AS m, avg(t) AS mean, var_samp(t) AS var FROM ({_ARMS}) WHERE arm IS NOT NULL GROUP BY arm),
p AS (SELECT x.arm AS arm_a, y.arm AS arm_b, (x.p - y.p) / nullif(sqrt((x.p * x.n + y.p * y.n) / (x.n + y.n) * (1 - (x.p * x.n + y.p * y.n) / (x.n + y.n)) * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)), 0) AS z_accuracy,
  (x.mean - y.mean) / nullif(sqrt(x.var / x.m + y.var / y.m), 0) AS z_seconds, (x.mean - y.mean) / nullif(sqrt((x.var + y.var) / 2), 0) AS effect FROM a x JOIN a y ON x.arm < y.arm WHERE x.n >= 10 AND y.n >= 10 AND x.m >= 5 AND y.m >= 5)
SELECT arm_a, arm_b, round(z_accuracy, 6) AS z_accuracy, round(z_seconds, 6) AS z_seconds, round(effect, 6) AS effect, abs(z_seconds) > 1.959964 AS differs FROM p"""
)
def arm_significance(spark: SparkSession, d: str) -> DataFrame:
    """Each two models compared by z-tests on success and duration; a model is one row here."""
    logs = table(spark, d, "search_logs", "model", "success", "processing_time").select(key_form("model").alias("arm"), F.col("success").cast("double").alias("s"), _good_time().alias("t")).where("arm is not null")
    arms = logs.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("p"), F.count("t").alias("m"), F.avg("t").alias("mean"), F.var_samp("t").alias("var")).where("n >= 10 and m >= 5")
    x, y = arms.alias("x"), arms.alias("y")
    c = F.col
    share = (c("x.p") * c("x.n") + c("y.p") * c("y.n")) / (c("x.n") + c("y.n"))
    z_accuracy = (c("x.p") - c("y.p")) / F.nullif(F.sqrt(share * (1 - share) * (1 / c("x.n") + 1 / c("y.n"))), F.lit(0.0))
    z_seconds = (c("x.mean") - c("y.mean")) / F.nullif(F.sqrt(c("x.var") / c("x.m") + c("y.var") / c("y.m")), F.lit(0.0))
    effect = (c("x.mean") - c("y.mean")) / F.nullif(F.sqrt((c("x.var") + c("y.var")) / 2), F.lit(0.0))
    both = x.join(y, c("x.arm") < c("y.arm"))
    return both.select(c("x.arm").alias("arm_a"), c("y.arm").alias("arm_b"), F.round(z_accuracy, 6).alias("z_accuracy"), F.round(z_seconds, 6).alias("z_seconds"), F.round(effect, 6).alias("effect"), (F.abs(z_seconds) > 1.959964).alias("differs"))


_HITS = """WITH a AS (SELECT id, search_mode, query, CASE WHEN json_valid(search_hits_json) THEN search_hits_json::JSON END AS h FROM search_logs),
b AS (SELECT id, search_mode, query, CASE WHEN json_type(h) = 'VARCHAR' THEN CASE WHEN json_valid(h->>'$') THEN (h->>'$')::JSON END ELSE h END AS h FROM a),
l AS (SELECT id, search_mode, query, CASE json_type(h) WHEN 'OBJECT' THEN CASE WHEN list_contains(json_keys(h), 'results') THEN h->'results' ELSE json_array(h) END ELSE h END AS h FROM b),
v AS (SELECT id, search_mode, query, CAST(k AS INT) AS hit_no, json_extract(h, '$[' || k || ']') AS hit FROM (SELECT id, search_mode, query, h, unnest(range(CAST(json_array_length(h) AS BIGINT))) AS k FROM l WHERE json_type(h) = 'ARRAY')),
w AS (SELECT id, search_mode, query, hit_no, hit->>'doc_id' AS doc_id, hit->>'title' AS title FROM v WHERE json_type(hit) = 'OBJECT')"""


@register(
    f"""{_HITS}, r AS (SELECT id, search_mode, hit_no, CASE WHEN contains(lower(query), lower(title)) THEN 1 ELSE 0 END AS good FROM w WHERE query IS NOT NULL AND title IS NOT NULL AND title <> ''),
q AS (SELECT id, search_mode, max(good) AS hit, max(good / (hit_no + 1.0::DOUBLE)) AS rr FROM r GROUP BY ALL)
SELECT coalesce(search_mode, '') AS mode, count(*) AS searches, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM q GROUP BY 1"""
)
def relevance_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate and mean reciprocal rank of the logged hits, a hit being good if the query names its title."""
    logs = table(spark, d, "search_logs", "id", "search_mode", "query", "search_hits_json")
    hits = nested.flatten_hits(logs, F.col("id"), F.lit(None).cast("string"), F.col("search_hits_json")).where("title <> ''")
    judged = hits.join(logs.where("query is not null").select("id", "search_mode", "query"), "id").select("id", "search_mode", "hit_no", F.contains(F.lower("query"), F.lower("title")).cast("int").alias("good"))
    per_search = judged.groupBy("id", "search_mode").agg(F.max("good").alias("hit"), F.max(F.col("good") / (F.col("hit_no") + 1.0)).alias("rr"))
    return per_search.groupBy(F.coalesce("search_mode", F.lit("")).alias("mode")).agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


@register(f"{_HITS} SELECT c.id AS file_id, count(*) AS hits, count(DISTINCT w.id) AS searches FROM w JOIN convert_files c ON w.doc_id = substr(sha256(c.relative_path), 1, 16) GROUP BY 1")
def hits_by_file(spark: SparkSession, d: str) -> DataFrame:
    """How often each file of the catalogue was found."""
    logs = table(spark, d, "search_logs", "id", "search_hits_json")
    links = nested.flatten_links(logs, F.col("id"), F.lit(None).cast("string"), F.col("search_hits_json")).where("doc_id <> ''")
    per_doc = links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("id").alias("searches"))
    files = table(spark, d, "convert_files", "id", "relative_path").where("relative_path is not null")
    return files.select(F.col("id").alias("file_id"), T.path_id("relative_path").alias("doc_id")).join(per_doc, "doc_id").select("file_id", "hits", "searches")


@register(
    f"""{_HITS}, n AS (SELECT id, count(*) AS in_json FROM w GROUP BY 1)
SELECT s.id, s.sources_count, coalesce(n.in_json, 0) AS in_json FROM search_logs s LEFT JOIN n USING (id) WHERE s.sources_count IS NOT NULL AND s.sources_count <> coalesce(n.in_json, 0)"""
)
def wrong_counters(spark: SparkSession, d: str) -> DataFrame:
    """Log rows whose counter of sources disagrees with their hits."""
    logs = table(spark, d, "search_logs", "id", "sources_count", "search_hits_json")
    n = nested.flatten_links(logs, F.col("id"), F.lit(None).cast("string"), F.col("search_hits_json")).groupBy("id").agg(F.count(F.lit(1)).alias("in_json"))
    joined = logs.select("id", "sources_count").join(n, "id", "left").withColumn("in_json", F.coalesce("in_json", F.lit(0)))
    return joined.where("sources_count is not null and sources_count <> in_json")


@register("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest_k FROM events GROUP BY 1, 2")
def events_daily(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind and day."""
    events = table(spark, d, "events")
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"), F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("largest_k"))


@register(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, n"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events by session windows, which end half an hour after their last event."""
    events = table(spark, d, "events", "user_id", "ts")
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("w.end").cast("timestamp")).alias("end_us"), "events")
