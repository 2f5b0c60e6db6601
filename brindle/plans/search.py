"""Queries taken apart, wildcards that rank, one list over many indexes, routing judged by the files expected, pages of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import queries
from brindle.functions.clean import log_time
from brindle.operators import fusion, index, nested
from brindle.plans.base import Registry
from brindle.plans.operations import _CALLS
from brindle.plans.retrieval import _INDEXED, ALL_FIELDS, TOK, _index, _terms, bm25_sql
from brindle.plans.sql import time_sql
from brindle.sources.tables import table

register = Registry()

_STOP = ", ".join(f"'{w}'" for w in queries.STOP)
_PHRASE = queries.PHRASE.replace("'", "''")


@register(
    f"""WITH a AS (SELECT id, query, regexp_replace(query, '{_PHRASE}', ' ', 'g') AS bare FROM search_logs WHERE query IS NOT NULL),
b AS (SELECT *, regexp_replace(bare, '{queries.FIELD}', ' ', 'g') AS rest FROM a)
SELECT id, 'phrase' AS kind, '' AS field, unnest(regexp_extract_all(query, '{_PHRASE}', 1)) AS value FROM a
UNION ALL SELECT id, 'field', lower(split_part(x, ':', 1)), regexp_replace(x, '^[^:]*:', '') FROM (SELECT id, unnest(regexp_extract_all(bare, '{queries.FIELD}')) AS x FROM a)
UNION ALL SELECT id, 'wildcard', '', '' FROM b WHERE regexp_matches(rest, '[*?]')
UNION ALL SELECT id, 'term', '', term FROM (SELECT DISTINCT id, unnest({TOK.format("rest")}) AS term FROM b) WHERE term NOT IN ({_STOP})"""
)
def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every logged query taken apart: its phrases, fields, terms without stop words, and whether it has a wildcard."""
    parsed = table(spark, d, "search_logs", "id", "query").where("query is not null").select("id", queries.parts("query").alias("p"))
    row = lambda kind, field, value: F.struct(F.lit(kind).alias("kind"), field.alias("field"), value.alias("value"))
    none = F.lit("")
    rows = F.concat(
        F.transform("p.phrases", lambda x: row("phrase", none, x)), F.transform("p.fields", lambda x: row("field", x["field"], x["value"])),
        F.filter(F.array(row("wildcard", none, none)), lambda x: F.col("p.wildcard")), F.transform("p.terms", lambda x: row("term", none, x)),
    )
    return parsed.select("id", F.explode(rows).alias("r")).select("id", "r.kind", "r.field", "r.value")


_STEM = "regexp_extract(lower(query), '[a-z]{6,}', 0)"


@register(
    bm25_sql(ALL_FIELDS, "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score, matched FROM ranked WHERE rank <= 10").replace(
        f"q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('query')}) AS term FROM eval_items)",
        f"v AS (SELECT DISTINCT unnest(terms) AS term FROM f), q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, substr({_STEM}, 1, 5) AS stem FROM eval_items WHERE {_STEM} <> '') JOIN v ON term LIKE stem || '%')",
    )
)
def bm25_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """Documents ranked by all terms that begin like each query's first long word (the word's first five letters and a star)."""
    kept = _index(spark, d)
    stem = F.substring(F.regexp_extract(F.lower("query"), "[a-z]{6,}", 0), 1, 5)
    asked = table(spark, d, "eval_items", "item_id", "query").where("query is not null").select(F.col("item_id").alias("query_id"), F.concat(stem, F.lit("*")).alias("pattern")).where("pattern <> '*'")
    terms = index.wildcard_terms(kept.postings(), asked.select("pattern").distinct()).join(asked, "pattern").select("query_id", "term").distinct()
    return index.bm25(kept, ALL_FIELDS, terms)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    every = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), k=None)
    sources = table(spark, d, "documents", "doc_id", "source").where("source is not null").select("doc_id", F.split_part("source", F.lit("/"), F.lit(1)).alias("index_name"))
    return fusion.rank_within(every.drop("rank").join(sources, "doc_id"), ["query_id", "index_name"], "score", "doc_id").where("rank <= 20")


@register(_INDEXED + ", m AS (SELECT query_id, index_name, doc_id, round(CASE WHEN high = low THEN 1.0 ELSE (score - low) / (high - low) END, 4) AS normalized, round(1.0::DOUBLE / (60 + own_rank), 8) AS rrf_score FROM t), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, normalized DESC, index_name, doc_id) AS place FROM m) SELECT query_id, CAST(place AS INT) AS place, index_name, doc_id, normalized, rrf_score FROM z WHERE place > 10 AND place <= 20")
def multi_index_merged(spark: SparkSession, d: str) -> DataFrame:
    """One list over all indexes for each query, by fusion scores, then by the score normalised within the index: its second page of ten."""
    scaled = fusion.min_max(_placed(spark, d), ["query_id", "index_name"], "score").select("query_id", "index_name", "doc_id", F.round("normalized", 4).alias("normalized"), F.round(F.lit(1.0) / (fusion.RRF + F.col("rank")), 8).alias("rrf_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.desc("normalized"), "index_name", "doc_id"))
    return scaled.withColumn("place", place).where("place > 10 and place <= 20").select("query_id", "place", "index_name", "doc_id", "normalized", "rrf_score")


@register(_INDEXED + ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM t) SELECT query_id, CAST(place AS INT) AS place, index_name, doc_id, score FROM z WHERE place <= 10")
def multi_index_by_score(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best of each index put into one list by their raw scores; its ten best."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return _placed(spark, d).withColumn("place", place).where("place <= 10").select("query_id", "place", "index_name", "doc_id", "score")


@register(
    _INDEXED + """, b AS (SELECT query_id, index_name, max(score) AS best FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, index_name) AS place FROM b),
e AS (SELECT DISTINCT item_id AS query_id, split_part(unnest(expected_files), '/', 1) AS index_name FROM eval_items),
fr AS (SELECT query_id, min(place) AS place FROM e LEFT JOIN n USING (query_id, index_name) GROUP BY ALL)
SELECT coalesce(category, '') AS category, count(*) AS queries, round(avg(CASE WHEN place <= 3 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM fr JOIN eval_items ON item_id = query_id GROUP BY 1"""
)
def routed_relevance(spark: SparkSession, d: str) -> DataFrame:
    """How well queries are routed, by category: whether an index of the files expected is among the three best, and the mean reciprocal place of the first."""
    best = _placed(spark, d).groupBy("query_id", "index_name").agg(F.max("score").alias("best"))
    placed = fusion.rank_within(best, ["query_id"], "best", "index_name").select("query_id", "index_name", F.col("rank").alias("place"))
    items = table(spark, d, "eval_items", "item_id", "category", "expected_files").withColumnRenamed("item_id", "query_id")
    expected = items.select("query_id", F.explode("expected_files").alias("file")).select("query_id", F.split_part("file", F.lit("/"), F.lit(1)).alias("index_name")).distinct()
    first = expected.join(placed, ["query_id", "index_name"], "left").groupBy("query_id").agg(F.min("place").alias("place"))
    return first.join(items.select("query_id", "category"), "query_id").groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(F.col("place") <= 3, 1).otherwise(0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr")
    )


@register(f"SELECT id, epoch_us(t) AS at_us, search_mode FROM (SELECT id, search_mode, {time_sql('created_at')} AS t FROM search_logs) WHERE t IS NOT NULL ORDER BY t DESC, id DESC LIMIT 50 OFFSET 50")
def newest_logs(spark: SparkSession, d: str) -> DataFrame:
    """The second page of fifty searches, newest first (a report)."""
    logs = table(spark, d, "search_logs", "id", "search_mode", "created_at").select("id", F.unix_micros(log_time("created_at")).alias("at_us"), "search_mode").where("at_us is not null")
    return logs.orderBy(F.desc("at_us"), F.desc("id")).offset(50).limit(50)


@register("SELECT id, relative_path, file_size FROM convert_files WHERE status IS NOT NULL AND file_size IS NOT NULL ORDER BY file_size DESC, id LIMIT 25 OFFSET 25")
def catalogue_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty-five files of the catalogue, the largest first (a report)."""
    files = table(spark, d, "convert_files", "id", "relative_path", "file_size", "status").where("status is not null and file_size is not null")
    return files.orderBy(F.desc("file_size"), "id").offset(25).limit(25).select("id", "relative_path", "file_size")


@register("SELECT directory_id, arg_max(id, (file_size, id)) AS largest, max(file_size) AS file_size, count(*) AS files FROM convert_files WHERE directory_id IS NOT NULL AND file_size IS NOT NULL GROUP BY 1")
def largest_files(spark: SparkSession, d: str) -> DataFrame:
    """The largest file of each directory."""
    files = table(spark, d, "convert_files", "id", "directory_id", "file_size").where("directory_id is not null and file_size is not null")
    return files.groupBy("directory_id").agg(F.max_by("id", F.struct("file_size", "id")).alias("largest"), F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("files"))


@register(
    _CALLS.replace("SELECT id, search_mode, json_extract(c, '$[' || k || ']') AS call", "SELECT id, search_mode, k, json_extract(c, '$[' || k || ']') AS call").replace("SELECT id, search_mode, call->>'tool'", "SELECT id, k, call->>'tool'")
    + " SELECT ok.id, CAST(k AS INT) AS call_no, tool, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ok.id, k) AS INT) AS number FROM ok JOIN search_logs s ON s.id = ok.id WHERE session_id IS NOT NULL"
)
def numbered_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls with their running number within the session."""
    logs = table(spark, d, "search_logs", "id", "session_id", "tool_calls_json").where("session_id is not null")
    calls = nested.flatten_calls(logs, F.col("id"), F.col("tool_calls_json")).join(logs.select("id", "session_id"), "id")
    return calls.select("id", "call_no", "tool", F.row_number().over(Window.partitionBy("session_id").orderBy("id", "call_no")).alias("number"))


_MODES = "SELECT coalesce(search_mode, '') AS mode, avg(CASE WHEN success = 1 AND processing_time >= 0 AND NOT isnan(processing_time) THEN processing_time END) AS seconds, avg(success::DOUBLE) AS rate FROM search_logs GROUP BY 1"


@register(f"SELECT arg_min(mode, (round(seconds, 6), mode)) AS fastest, round(min(seconds), 6) AS seconds, arg_max(mode, (round(rate, 6), mode)) AS surest, round(max(rate), 6) AS rate FROM ({_MODES}) WHERE seconds IS NOT NULL")
def benchmark_conclusion(spark: SparkSession, d: str) -> DataFrame:
    """The fastest mode and the one that succeeds most often."""
    logs = table(spark, d, "search_logs", "search_mode", "success", "processing_time")
    good = (F.col("success") == 1) & (F.col("processing_time") >= 0) & ~F.isnan("processing_time")
    modes = logs.groupBy(F.coalesce("search_mode", F.lit("")).alias("mode")).agg(F.round(F.avg(F.when(good, F.col("processing_time"))), 6).alias("seconds"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate")).where("seconds is not null")
    return modes.agg(F.min_by("mode", F.struct("seconds", "mode")).alias("fastest"), F.min("seconds").alias("seconds"), F.max_by("mode", F.struct("rate", "mode")).alias("surest"), F.max("rate").alias("rate"))
