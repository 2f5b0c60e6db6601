"""Registered queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.clean import key_form, log_time
from brindle.operators import nested, rolling, sessions
from brindle.plans import assembly, operations, retrieval, search, streams, texts
from brindle.plans.sql import key_sql, time_sql
from brindle.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _rolled(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "search_logs", "model", "created_at", "tokens_used")
    return rolling.rolling_totals(logs, key_form("model"), log_time("created_at"), F.col("tokens_used"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Days of a model without a search, within 7 days of one."""
    return rolling.silent_days(_rolled(spark, d)).select(F.col("entity").alias("model"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each model over the last 7 and 30 days, for every day."""
    r = _rolled(spark, d)
    rounded = [F.round(c, 6).alias(c) for c in ("avg_7", "avg_row_7", "avg_30", "avg_row_30")]
    return r.select(F.col("entity").alias("model"), F.date_format("day", "yyyy-MM-dd").alias("day"), "rows", "total", "rows_7", "total_7", "rows_30", "total_30", *rounded)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "auth_log", "id", "token_id", "created_at")
    return sessions.sessionize(log, key_form("token_id"), F.col("created_at"), F.col("id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last request of each token's sessions."""
    return _sessions(spark, d).select(F.col("entity").alias("token_id"), "first_id", "last_id")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each token's sessions with start, end, duration and number of requests."""
    s = _sessions(spark, d)
    return s.select(F.col("entity").alias("token_id"), "session_no", "first_id", "last_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.round("duration_s", 6).alias("duration_s"), "rows")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Calls and hits of each log row, with their places."""
    logs = table(spark, d, "search_logs", "id", "tool_calls_json", "search_hits_json")
    return nested.flatten_links(logs, F.col("id"), F.col("tool_calls_json"), F.col("search_hits_json"))


def p7_calls(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of tool calls."""
    return nested.flatten_calls(table(spark, d, "search_logs", "id", "tool_calls_json"), F.col("id"), F.col("tool_calls_json"))


def p7_hits(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of hits, within calls and of the search itself."""
    logs = table(spark, d, "search_logs", "id", "tool_calls_json", "search_hits_json")
    return nested.flatten_hits(logs, F.col("id"), F.col("tool_calls_json"), F.col("search_hits_json"))


_ROLLED = f"""
WITH x AS (SELECT {key_sql("model")} AS model, CAST({time_sql("created_at")} AS DATE) AS day, tokens_used AS v FROM search_logs),
daily AS (SELECT model, day, coalesce(sum(v), 0) AS total, count(*) AS n, count(v) AS valued FROM x WHERE model IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
cal AS (SELECT model, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY model),
rolled AS (
  SELECT c.model, c.day, coalesce(sum(n) FILTER (WHERE d.day = c.day), 0) AS rows, coalesce(sum(total) FILTER (WHERE d.day = c.day), 0) AS total,
         coalesce(sum(n) FILTER (WHERE d.day > c.day - 7), 0) AS rows_7, coalesce(sum(total) FILTER (WHERE d.day > c.day - 7), 0) AS total_7, coalesce(sum(valued) FILTER (WHERE d.day > c.day - 7), 0) AS valued_7,
         coalesce(sum(n), 0) AS rows_30, coalesce(sum(total), 0) AS total_30, coalesce(sum(valued), 0) AS valued_30
  FROM cal c LEFT JOIN daily d ON d.model = c.model AND d.day <= c.day AND d.day > c.day - 30 GROUP BY c.model, c.day)"""
_SESSIONS = f"""
WITH e AS (SELECT {key_sql("token_id")} AS token_id, created_at, id FROM auth_log),
o AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM e
      WHERE token_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY token_id ORDER BY created_at, id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY token_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session_no FROM o),
g AS (SELECT token_id, CAST(session_no AS BIGINT) AS session_no, first(id ORDER BY created_at, id) AS first_id, last(id ORDER BY created_at, id) AS last_id,
             epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) AS end_us, count(*) AS rows FROM s GROUP BY ALL)"""
_LIST = """CASE json_type({c}) WHEN 'OBJECT' THEN CASE WHEN list_contains(json_keys({c}), '{key}') THEN
  CASE json_type({c}->'{key}') WHEN 'VARCHAR' THEN TRY_CAST(({c}->>'{key}') AS JSON) ELSE {c}->'{key}' END ELSE json_array({c}) END ELSE {c} END"""
_LINKS = f"""
WITH a AS (SELECT id, CASE WHEN json_valid(tool_calls_json) THEN tool_calls_json::JSON END AS c, CASE WHEN json_valid(search_hits_json) THEN search_hits_json::JSON END AS h FROM search_logs),
b AS (SELECT id, CASE WHEN json_type(c) = 'VARCHAR' THEN CASE WHEN json_valid(c->>'$') THEN (c->>'$')::JSON END ELSE c END AS c, CASE WHEN json_type(h) = 'VARCHAR' THEN CASE WHEN json_valid(h->>'$') THEN (h->>'$')::JSON END ELSE h END AS h FROM a),
l AS (SELECT id, {_LIST.format(c="c", key="calls")} AS c, {_LIST.format(c="h", key="results")} AS h FROM b),
calls AS (SELECT id, CAST(k AS INT) AS call_no, json_extract(c, '$[' || k || ']') AS call FROM (SELECT id, c, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS k FROM l WHERE json_type(c) = 'ARRAY')),
ok AS (SELECT * FROM calls WHERE json_type(call) = 'OBJECT'),
t AS (SELECT id, call_no, CASE json_type(call->'content') WHEN 'VARCHAR' THEN CASE WHEN json_valid(call->>'content') THEN (call->>'content')::JSON END ELSE call->'content' END AS x FROM ok),
u AS (SELECT id, call_no, {_LIST.format(c="x", key="results")} AS x FROM t),
hits AS (SELECT id, call_no, x FROM u UNION ALL SELECT id, -1, h FROM l),
v AS (SELECT id, call_no, CAST(k AS INT) AS hit_no, json_extract(x, '$[' || k || ']') AS hit FROM (SELECT id, call_no, x, unnest(range(CAST(json_array_length(x) AS BIGINT))) AS k FROM hits WHERE json_type(x) = 'ARRAY'))
SELECT id, call_no, -1 AS hit_no, '' AS doc_id FROM ok UNION ALL SELECT id, call_no, hit_no, coalesce(hit->>'doc_id', '') FROM v WHERE json_type(hit) = 'OBJECT'"""

QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_totals, p6_found, p6_sessions, p7_found, p7_calls, p7_hits)} | retrieval.register.queries | texts.register.queries | operations.register.queries | streams.register.queries | assembly.register.queries | search.register.queries
ORACLE: dict[str, str] = {
    "p1_found": f"{_ROLLED} SELECT model, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE rows = 0 AND rows_7 > 0",
    "p1_totals": f"""{_ROLLED} SELECT model, strftime(day, '%Y-%m-%d') AS day, CAST(rows AS BIGINT) AS rows, CAST(total AS BIGINT) AS total, CAST(rows_7 AS BIGINT) AS rows_7, CAST(total_7 AS BIGINT) AS total_7,
  CAST(rows_30 AS BIGINT) AS rows_30, CAST(total_30 AS BIGINT) AS total_30, round(total_7 / 7.0::DOUBLE, 6) AS avg_7, round(CASE WHEN valued_7 > 0 THEN total_7::DOUBLE / valued_7 END, 6) AS avg_row_7,
  round(total_30 / 30.0::DOUBLE, 6) AS avg_30, round(CASE WHEN valued_30 > 0 THEN total_30::DOUBLE / valued_30 END, 6) AS avg_row_30 FROM rolled""",
    "p6_found": f"{_SESSIONS} SELECT token_id, first_id, last_id FROM g",
    "p6_sessions": f"{_SESSIONS} SELECT token_id, session_no, first_id, last_id, start_us, end_us, round((end_us - start_us) / 1e6, 6) AS duration_s, rows FROM g",
    "p7_found": _LINKS,
    "p7_calls": _LINKS.rsplit("SELECT id, call_no, -1 AS hit_no", 1)[0] + """SELECT id, call_no, call->>'tool' AS tool, call->>'arguments' AS arguments, TRY_CAST(call->>'success' AS BOOLEAN) AS success, TRY_CAST(call->>'timestamp' AS DOUBLE) AS timestamp, call->>'content' AS content FROM ok""",
    "p7_hits": _LINKS.rsplit("SELECT id, call_no, -1 AS hit_no", 1)[0] + """SELECT id, call_no, hit_no, hit->>'doc_id' AS doc_id, hit->>'title' AS title, TRY_CAST(hit->>'score' AS DOUBLE) AS score, hit->>'snippet' AS snippet, hit->>'source_path' AS source_path FROM v WHERE json_type(hit) = 'OBJECT'""",
} | retrieval.register.oracle | texts.register.oracle | operations.register.oracle | streams.register.oracle | assembly.register.oracle | search.register.oracle
