"""Ranking, phrases, patterns and fusion over the documents, for the queries of ``eval_items`` or a stated few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import fusion, grep, index
from brindle.plans.base import Registry
from brindle.sources.tables import is_kept, kept_folder, table

register = Registry()

TOK = (
    "list_concat(regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '[\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), "
    "flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"
)
KEYWORDS = "array_to_string(keywords, ' ')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "title", "text", "keywords", "filename", "source")


def _index(spark: SparkSession, d: str) -> index.Index:
    """The index of the documents, kept in the shared folder: built once for a state of their files, then read."""
    docs = _docs(spark, d)
    fields = {"title": F.col("title"), "text": F.col("text"), "keywords": F.array_join("keywords", " "), "filename": F.col("filename")}
    folder = kept_folder(docs, "index-of-terms")
    if not is_kept(spark, folder):
        index.save(index.build(docs, "doc_id", fields), folder)
    return index.load(spark, folder)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return index.query_terms(table(spark, d, "eval_items", "item_id", "query"), "item_id", F.col("query"))


def bm25_sql(fields: dict[str, float], tail: str, ctes: str = "") -> str:
    """SQL of ``index.bm25``; ``tail`` selects from ``ranked`` (query_id, doc_id, score, matched, rank)."""
    source = {"title": "title", "text": "text", "keywords": KEYWORDS, "filename": "filename"}
    parts = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {b}::DOUBLE AS boost, {TOK.format(source[f])} AS terms FROM documents" for f, b in fields.items())
    return f"""
WITH f AS ({parts}),
stats AS (SELECT field, count(*) AS n, avg(len(terms)) AS mean FROM f GROUP BY field),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format("query")}) AS term FROM eval_items),
p AS (SELECT doc_id, field, boost, length, term, count(*) AS tf FROM (SELECT doc_id, field, boost, len(terms) AS length, unnest(terms) AS term FROM f) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, field, count(*) AS df FROM p GROUP BY ALL),
w AS (SELECT term, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) * boost) AS part FROM p JOIN df USING (term, field) JOIN stats USING (field) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(part), 6) AS score, count(*) AS matched FROM q JOIN w USING (term) GROUP BY ALL),
{ctes}ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
{tail}"""


ALL_FIELDS = {"title": 1.0, "text": 1.0, "keywords": 1.0, "filename": 1.0}
TOP = "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score, matched FROM {0} WHERE rank <= 10"


@register(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS documents, CAST(sum(len(t)) AS BIGINT) AS terms, round(avg(len(t)), 4) AS mean_length FROM (SELECT {TOK.format(c)} AS t FROM documents)" for f, c in (("title", "title"), ("text", "text"), ("keywords", KEYWORDS), ("filename", "filename"))))
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, terms and mean length of each field."""
    return _index(spark, d).statistics().withColumn("mean_length", F.round("mean_length", 4))


@register(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the texts with its documents and occurrences."""
    return _index(spark, d).postings("text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@register(f"SELECT item_id AS query_id, term FROM (SELECT DISTINCT item_id, unnest({TOK.format('query')}) AS term FROM eval_items)")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct terms of each query."""
    return _terms(spark, d)


@register(bm25_sql(ALL_FIELDS, TOP.format("ranked")))
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each query over all fields."""
    return index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d))


@register(bm25_sql(ALL_FIELDS | {"title": 3.0}, TOP.format("ranked")))
def bm25_title_boost(spark: SparkSession, d: str) -> DataFrame:
    """The same with titles counting three times."""
    return index.bm25(_index(spark, d), ALL_FIELDS | {"title": 3.0}, _terms(spark, d))


@register(bm25_sql({"title": 1.0}, TOP.format("ranked")))
def bm25_field(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by title alone."""
    return index.bm25(_index(spark, d), {"title": 1.0}, _terms(spark, d))


@register(bm25_sql(ALL_FIELDS, "SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score, matched FROM ranked WHERE rank > 10 AND rank <= 20"))
def bm25_paged(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten."""
    return index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), k=10, offset=10)


@register(
    bm25_sql(
        ALL_FIELDS, TOP.format("(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kept)"),
        "c AS (SELECT query_id, count(*) AS n FROM q GROUP BY ALL), best AS (SELECT query_id, max(matched) AS best FROM s GROUP BY ALL), kept AS (SELECT s.* FROM s JOIN c USING (query_id) JOIN best USING (query_id) WHERE best < n OR matched = n), ",
    )
)
def bm25_all_then_any(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all terms of the query where there are any, else with some of them."""
    return index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), all_then_any=True)


@register(bm25_sql(ALL_FIELDS, "SELECT query_id, count(*) AS documents, max(matched) AS most_matched, max(score) AS best FROM s GROUP BY query_id"))
def match_count(spark: SparkSession, d: str) -> DataFrame:
    """How many documents match each query, and how well."""
    every = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), k=None)
    return every.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.max("matched").alias("most_matched"), F.max("score").alias("best"))


@register(bm25_sql(ALL_FIELDS, "SELECT DISTINCT query_id, title FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10 AND title IS NOT NULL"))
def suggest_titles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct titles of each query's best documents."""
    best = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d))
    return best.join(table(spark, d, "documents", "doc_id", "title"), "doc_id").where("title is not null").select("query_id", "title").distinct()


def _per_field(spark: SparkSession, d: str, how: str) -> DataFrame:
    terms = _terms(spark, d)
    by = {f: index.bm25(_index(spark, d), {f: 1.0}, terms, k=None).select("query_id", "doc_id", F.col("score").alias(f)) for f in ("title", "text")}
    both = by["title"].join(by["text"], ["query_id", "doc_id"], how)
    scored = both.select("query_id", "doc_id", F.round(F.coalesce("title", F.lit(0.0)) + F.coalesce("text", F.lit(0.0)), 6).alias("score"))
    ranked = fusion.rank_within(scored, ["query_id"], "score", "doc_id").where("rank <= 10")
    return ranked.select("query_id", "rank", "doc_id", "score")


def _per_field_sql(how: str) -> str:
    one = lambda f: f"SELECT query_id, doc_id, score FROM ({bm25_sql({f: 1.0}, 'SELECT * FROM ranked')})"
    return f"""SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(coalesce(a.score, 0) + coalesce(b.score, 0), 6) AS score FROM ({one("title")}) a {how} JOIN ({one("text")}) b USING (query_id, doc_id))) WHERE rank <= 10"""


@register(_per_field_sql("INNER"))
def bm25_multi_field_and(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title and text both match, by the sum of both scores."""
    return _per_field(spark, d, "inner")


@register(_per_field_sql("FULL OUTER"))
def bm25_multi_field_or(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title or text matches, by the sum of both scores."""
    return _per_field(spark, d, "full_outer")


WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


@register(
    f"""WITH p AS (SELECT DISTINCT title AS phrase_id FROM documents WHERE title IS NOT NULL),
pt AS (SELECT phrase_id, unnest(w) AS term, unnest(range(len(w))) AS k, len(w) AS n FROM (SELECT phrase_id, {WORDS.format("phrase_id")} AS w FROM p)),
dt AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS spot FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents)),
s AS (SELECT phrase_id, doc_id, spot - k AS start, count(*) AS hit, max(n) AS n FROM dt JOIN pt USING (term) GROUP BY ALL)
SELECT phrase_id, doc_id, count(*) AS occurrences FROM s WHERE hit = n GROUP BY ALL"""
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text contains a title of the corpus as a phrase."""
    docs = table(spark, d, "documents", "doc_id", "title", "text")
    phrases = docs.where("title is not null").select(F.col("title").alias("phrase_id"), F.col("title").alias("phrase")).distinct()
    return index.phrase_matches(docs, "doc_id", F.col("text"), phrases)


PATTERNS = ("reimburs*", "treat*t", "p?rcent", "versicher*", "20?4")


@register(
    f"SELECT pattern, term, df FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term) JOIN (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) v(pattern) ON term LIKE replace(replace(pattern, '*', '%'), '?', '_')"
)
def wildcard_search(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the texts that match patterns with * and ?."""
    return index.wildcard_terms(_index(spark, d).postings("text"), spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))


MONEY = "(EUR|USD|CNY) [0-9,]+"
_LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no, l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents)"


@register(f"SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM ({_LINES}) WHERE regexp_matches(line, '(?i){MONEY}')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line that states an amount."""
    return grep.grep_lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", F.col("text"), MONEY)


@register(f"SELECT doc_id, CAST(line_no AS INT) AS line_no, line, coalesce(array_to_string(l[greatest(line_no - 2, 1):line_no - 1], chr(10)), '') AS before, coalesce(array_to_string(l[line_no + 1:line_no + 2], chr(10)), '') AS after FROM ({_LINES}) WHERE regexp_matches(line, 'appeal|objection')")
def grep_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines on objections with two lines before and after."""
    return grep.grep_lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", F.col("text"), "appeal|objection", ignore_case=False, context=2)


@register(f"SELECT doc_id, count(*) AS matches, substr(min_by(line, line_no), 1, 200) AS first_line, round(ln(1 + count(*)) / ln(51), 6) AS score FROM ({_LINES}) WHERE regexp_matches(line, '(?i){MONEY}') GROUP BY doc_id")
def grep_by_doc(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the number of lines that state an amount."""
    return grep.grep_documents(table(spark, d, "documents", "doc_id", "text"), "doc_id", F.col("text"), MONEY)


@register(
    bm25_sql(ALL_FIELDS, "").rstrip()
    + f""",
l AS (SELECT doc_id, line_no, unnest(list_distinct({TOK.format("line")})) AS term FROM ({_LINES})),
g AS (SELECT query_id, doc_id, count(DISTINCT line_no) AS matches FROM l JOIN q USING (term) GROUP BY ALL),
gr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank FROM g),
z AS (SELECT query_id, doc_id, round(sum(part), 8) AS rrf_score, count(*) AS sources FROM (SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) AS part FROM ranked UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) FROM gr) GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM z)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, rrf_score, sources FROM y WHERE rank <= 10"""
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """For each query, ranking by terms and ranking by the number of lines that hold any of them made into one; its ten best documents."""
    terms = _terms(spark, d)
    by_term = index.bm25(_index(spark, d), ALL_FIELDS, terms, k=None).select("query_id", "doc_id", "rank")
    matches = grep.count_lines(_docs(spark, d), "doc_id", F.col("text"), terms)
    by_line = fusion.rank_within(matches, ["query_id"], "matches", "doc_id").select("query_id", "doc_id", "rank")
    fused = fusion.reciprocal_rank_fusion([(by_term, 0.6), (by_line, 0.4)], ["query_id"], "doc_id")
    return fusion.rank_within(fused, ["query_id"], "rrf_score", "doc_id").where("rank <= 10").select("query_id", "rank", "doc_id", "rrf_score", "sources")


_INDEXED = bm25_sql(ALL_FIELDS, "").rstrip() + """,
i AS (SELECT query_id, doc_id, score, split_part(source, '/', 1) AS index_name FROM s JOIN documents USING (doc_id) WHERE source IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, index_name ORDER BY score DESC, doc_id) AS own_rank FROM i),
t AS (SELECT *, min(score) OVER (PARTITION BY query_id, index_name) AS low, max(score) OVER (PARTITION BY query_id, index_name) AS high FROM r WHERE own_rank <= 20)
"""


@register(_INDEXED + "SELECT query_id, index_name, doc_id, CAST(own_rank AS INT) AS rank, round(CASE WHEN high = low THEN 1.0 ELSE (score - low) / (high - low) END, 4) AS normalized, round(1.0::DOUBLE / (60 + own_rank), 8) AS rrf_score FROM t")
def multi_index_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best of each index (the first part of the source), normalised within it, with their fusion scores."""
    every = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), k=None)
    placed = every.drop("rank").join(table(spark, d, "documents", "doc_id", "source").where("source is not null"), "doc_id").withColumn("index_name", F.split_part("source", F.lit("/"), F.lit(1)))
    best = fusion.rank_within(placed, ["query_id", "index_name"], "score", "doc_id").where("rank <= 20")
    scaled = fusion.min_max(best, ["query_id", "index_name"], "score")
    return scaled.select("query_id", "index_name", "doc_id", "rank", F.round("normalized", 4).alias("normalized"), F.round(F.lit(1.0) / (fusion.RRF + F.col("rank")), 8).alias("rrf_score"))


@register(_INDEXED + "SELECT query_id, index_name, count(*) AS hits, max(score) AS best FROM t GROUP BY ALL")
def route_by_results(spark: SparkSession, d: str) -> DataFrame:
    """How well each index serves each query, by its twenty best documents."""
    every = index.bm25(_index(spark, d), ALL_FIELDS, _terms(spark, d), k=None)
    placed = every.drop("rank").join(table(spark, d, "documents", "doc_id", "source").where("source is not null"), "doc_id").withColumn("index_name", F.split_part("source", F.lit("/"), F.lit(1)))
    best = fusion.rank_within(placed, ["query_id", "index_name"], "score", "doc_id").where("rank <= 20")
    return best.groupBy("query_id", "index_name").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))


@register(
    """WITH k AS (SELECT DISTINCT split_part(source, '/', 1) AS index_name, lower(unnest(keywords)) AS tag FROM documents WHERE source IS NOT NULL),
n AS (SELECT index_name, tag FROM k WHERE tag IS NOT NULL)
SELECT item_id AS query_id, index_name, count(*) AS tags FROM eval_items JOIN n ON contains(lower(query), tag) GROUP BY ALL"""
)
def route_by_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each index (its documents' keywords) that a query contains; queries and distinct tags are both small."""
    tags = table(spark, d, "documents", "source", "keywords").where("source is not null").select(F.split_part("source", F.lit("/"), F.lit(1)).alias("index_name"), F.explode(F.transform("keywords", F.lower)).alias("tag")).where("tag is not null").distinct()
    asked = table(spark, d, "eval_items", "item_id", "query").select(F.col("item_id").alias("query_id"), F.lower("query").alias("low"))
    return tags.join(asked, F.contains("low", "tag")).groupBy("query_id", "index_name").agg(F.count(F.lit(1)).alias("tags"))


@register("SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(keywords) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY ALL")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with their uses."""
    tags = table(spark, d, "documents", "doc_id", "keywords").select("doc_id", F.explode(F.transform("keywords", F.lower)).alias("tag")).where("tag is not null")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@register("SELECT doc_id FROM documents WHERE len(list_intersect(list_transform(keywords, lambda k: lower(k)), ['waiting period', '年假'])) > 0")
def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one of some tags, in whatever case."""
    wanted = F.array(F.lit("waiting period"), F.lit("年假"))
    return table(spark, d, "documents", "doc_id", "keywords").where(F.arrays_overlap(F.transform("keywords", F.lower), wanted)).select("doc_id")


@register("SELECT doc_id, source FROM documents WHERE lower(source) LIKE '%handbook%' AND n_chars > 500 AND modified_time >= TIMESTAMP '2023-01-01' AND NOT (lang IS NULL OR lower(lang) LIKE 'zh%')")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents by conditions on their metadata, pushed down to the scan as far as they go."""
    docs = table(spark, d, "documents", "doc_id", "source", "n_chars", "modified_time", "lang")
    return docs.where((F.col("n_chars") > 500) & (F.col("modified_time") >= F.lit("2023-01-01").cast("timestamp")) & F.lower("source").contains("handbook") & ~F.coalesce(F.lower("lang").startswith("zh"), F.lit(True))).select("doc_id", "source")


@register(
    """SELECT doc_id, array_to_string(l[1:20], chr(10)) AS page, CAST(len(l) AS INT) AS lines, len(l) > 20 AS truncated
FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n?', ''), '\\r\\n|\\n|\\r') AS l FROM documents WHERE text IS NOT NULL)"""
)
def read_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of twenty lines of each document, without its front matter."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.lines(T.strip_front_matter("text")).alias("l"))
    return docs.select("doc_id", F.array_join(F.slice("l", 1, 20), "\n").alias("page"), F.size("l").alias("lines"), (F.size("l") > 20).alias("truncated"))


@register("SELECT doc_id, CAST(len(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS INT) AS lines, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS INT) AS words, CAST(length(text) AS INT) AS chars, CAST(strlen(text) AS INT) AS bytes FROM documents WHERE text IS NOT NULL")
def count_words(spark: SparkSession, d: str) -> DataFrame:
    """Lines, words, characters and bytes of each text."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.size(T.lines("text")).alias("lines"), F.size(T.words("text")).alias("words"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
