"""Text transforms over the documents, the logs and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.plans.base import Registry
from brindle.sources.tables import table

register = Registry()

FM = "(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n?"


@register("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS snippet FROM documents WHERE text IS NOT NULL")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 200 characters."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.snippet("text").alias("snippet"))


@register(
    """WITH a AS (SELECT doc_id, text, title, strpos(lower(text), lower(title)) AS spot FROM documents WHERE text IS NOT NULL AND title IS NOT NULL),
b AS (SELECT *, greatest(spot - 50, 1) AS start, least(spot + length(title) + 49, length(text)) AS stop FROM a)
SELECT doc_id, CASE WHEN spot > 0 THEN CASE WHEN start > 1 THEN '...' ELSE '' END || substr(text, start, stop - start + 1) || CASE WHEN stop < length(text) THEN '...' ELSE '' END ELSE substr(text, 1, 200) END AS excerpt FROM b"""
)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Surroundings of the title's first occurrence in the text."""
    docs = table(spark, d, "documents", "doc_id", "text", "title").where("text is not null and title is not null")
    return docs.select("doc_id", T.excerpt("text", F.col("title")).alias("excerpt"))


@register("SELECT doc_id, list_filter(keywords, lambda k: contains(lower(text), lower(k)))[1:5] AS found FROM documents WHERE text IS NOT NULL AND keywords IS NOT NULL AND len(list_filter(keywords, lambda k: k IS NULL)) = 0")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    """Up to five keywords that the text contains."""
    docs = table(spark, d, "documents", "doc_id", "text", "keywords").where("text is not null and keywords is not null and not exists(keywords, k -> k is null)")
    return docs.select("doc_id", T.contained("text", F.col("keywords")).alias("found"))


@register("SELECT doc_id, regexp_replace(substr(text, 1, 200), '(?i)(treatment|period|年假)', '**\\1**', 'g') AS marked FROM documents WHERE text IS NOT NULL")
def emphasised(spark: SparkSession, d: str) -> DataFrame:
    """Heads of the texts with some words in double stars."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.emphasise("text", "treatment|period|年假").alias("marked"))


@register(
    f"""SELECT doc_id, regexp_matches(text, '{FM}') AS has, nullif(regexp_replace(regexp_extract(regexp_extract(text, '{FM}', 1), '(?m)^title:[ \\t]*(.*?)[ \\t]*\\r?$', 1), '^["'']|["'']$', '', 'g'), '') AS title,
md5(regexp_replace(text, '{FM}', '')) AS body_md5 FROM documents WHERE text IS NOT NULL"""
)
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text has front matter, its title field, and the body's hash."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", T.has_front_matter("text").alias("has"), T.front_matter_field("text", "title").alias("title"), F.md5(T.strip_front_matter("text")).alias("body_md5"))


@register(
    f"""SELECT doc_id, md5('---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || '---' || chr(10) || regexp_replace(text, '{FM}', '')) AS written_md5
FROM documents WHERE text IS NOT NULL"""
)
def front_matter_written(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the texts with new front matter."""
    docs = table(spark, d, "documents", "doc_id", "text", "title", "source").where("text is not null")
    return docs.select("doc_id", F.md5(T.add_front_matter("text", title=F.coalesce("title", F.lit("")), source=F.coalesce("source", F.lit("")))).alias("written_md5"))


@register(
    """WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS x FROM documents)),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS fence FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM f WHERE fence = 0 AND regexp_matches(line, '^#{1,6}\\s+\\S'))
SELECT doc_id, CAST(length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS INT) AS level, trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) AS heading, CAST(n AS INT) AS line FROM h WHERE k <= 30"""
)
def headings(spark: SparkSession, d: str) -> DataFrame:
    """Markdown headings outside of fences."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text like '%#%'")
    found = docs.select("doc_id", F.explode(T.headings("text")).alias("h"))
    return found.select("doc_id", "h.level", F.col("h.text").alias("heading"), "h.line")


@register(
    """SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 800) || '[...]' || substr(text, CAST(trunc(length(text) / 2 - 200) AS INT) + 1, 400) || '[...]' || substr(text, length(text) - 399, 400) ELSE text END) AS sampled_md5
FROM documents WHERE text IS NOT NULL"""
)
def sampled_content(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of head, middle and tail of long texts, and of shorter ones as they are."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.md5(T.sample_text("text", 2000, 800, 400, 400, "[...]")).alias("sampled_md5"))


@register("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, substr(sha256(source || '/' || filename), 1, 16) AS path_id FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the texts and ids of their paths."""
    docs = table(spark, d, "documents", "doc_id", "text", "source", "filename").where("text is not null")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), T.path_id(F.concat(F.col("source"), F.lit("/"), F.col("filename"))).alias("path_id"))


@register("SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once, by their hash."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@register("SELECT result_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS cleaned_md5 FROM ocr_results WHERE text IS NOT NULL")
def clean_scans(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of scanned texts with their control characters and line ends put right."""
    return table(spark, d, "ocr_results", "result_id", "text").where("text is not null").select("result_id", F.md5(T.clean_scan("text")).alias("cleaned_md5"))


@register(
    """SELECT id, CASE WHEN length(answer) <= 120 THEN answer WHEN length(regexp_extract(substr(answer, 1, 120), '(?s)^.*[.!?。！？]', 0)) >= 120 * 0.7 THEN regexp_extract(substr(answer, 1, 120), '(?s)^.*[.!?。！？]', 0) ELSE substr(answer, 1, 120) END AS short
FROM search_logs WHERE answer IS NOT NULL"""
)
def truncated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut at a sentence's end within 120 characters where that keeps enough of them."""
    return table(spark, d, "search_logs", "id", "answer").where("answer is not null").select("id", T.truncate_at_sentence("answer", 120).alias("short"))


_PAIRS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END"


@register(
    f"""WITH b AS (SELECT id, regexp_replace(coalesce(query, ''), '\\s+', '', 'g') AS q, regexp_replace(coalesce(answer, ''), '\\s+', '', 'g') AS a FROM search_logs),
s AS (SELECT id, {_PAIRS.format("q")} AS x, {_PAIRS.format("a")} AS y FROM b)
SELECT id, round(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM s"""
)
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of question and answer by pairs of characters."""
    return table(spark, d, "search_logs", "id", "query", "answer").select("id", F.round(T.bigram_overlap("query", "answer"), 6).alias("overlap"))


@register(
    """WITH a AS (SELECT id, trim(answer, ' ' || chr(9) || chr(10) || chr(13)) AS answer, trim(regexp_extract(answer, '(?s)```(?:json)?\\s*(.*?)```', 1), ' ' || chr(9) || chr(10) || chr(13)) AS fenced, regexp_extract(answer, '(?s)\\{.*\\}', 0) AS braces FROM search_logs WHERE answer LIKE '%{%')
SELECT id, CASE WHEN json_valid(answer) AND json_type(answer) = 'OBJECT' THEN answer WHEN fenced <> '' AND json_valid(fenced) AND json_type(fenced) = 'OBJECT' THEN fenced WHEN json_valid(braces) AND json_type(braces) = 'OBJECT' THEN braces END AS rescued FROM a"""
)
def rescued_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object within an answer."""
    return table(spark, d, "search_logs", "id", "answer").where(F.contains("answer", F.lit("{"))).select("id", T.rescue_json("answer").alias("rescued"))


@register(
    """SELECT id, regexp_replace(regexp_extract(relative_path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(relative_path, '(\\.[^./\\\\]+)$', 1)) AS suffix, substr(sha256(relative_path), 1, 16) AS path_id,
CAST(len(string_split(relative_path, '/')) - 1 AS INT) AS depth FROM convert_files WHERE relative_path IS NOT NULL"""
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the catalogue's paths, and the ids that the logs use for them."""
    files = table(spark, d, "convert_files", "id", "relative_path").where("relative_path is not null")
    return files.select("id", T.stem("relative_path").alias("stem"), T.suffix("relative_path").alias("suffix"), T.path_id("relative_path").alias("path_id"), (F.size(F.split("relative_path", "/")) - 1).alias("depth"))


#: Patterns without look-around, so that SQL engines agree: 18-digit identity numbers, long card numbers, mobile numbers, e-mail and IP addresses.
COUNTED = {"id_cards": "[0-9]{17}[0-9Xx]", "mobiles": "1[3-9][0-9]{9}", "emails": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "addresses": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"}


@register(f"SELECT id, {', '.join(f"CAST(len(regexp_extract_all(coalesce(query, '') || ' ' || coalesce(answer, ''), '{p}')) AS INT) AS {k}" for k, p in COUNTED.items())} FROM search_logs")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often plain patterns of personal data occur in a log row."""
    text = F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("answer", F.lit("")))
    return table(spark, d, "search_logs", "id", "query", "answer").select("id", *[F.regexp_count(text, F.lit(p)).alias(k) for k, p in COUNTED.items()])


#: Words that tell what kind of document a text is.
KINDS = {"policy": ("payable", "premium", "insurer"), "medical": ("treatment", "patient", "diagnosis"), "technical": ("backup", "index", "password"), "hr": ("leave", "overtime", "probation")}


def _score(words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words)


@register(
    f"""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {", ".join(f"{_score(w)} AS {k}" for k, w in KINDS.items())} FROM t)
SELECT doc_id, CASE WHEN greatest({", ".join(KINDS)}) = 0 THEN 'unknown' {" ".join(f"WHEN {k} = greatest({', '.join(KINDS)}) THEN '{k}'" for k in KINDS)} END AS kind, CAST(greatest({", ".join(KINDS)}) AS INT) AS score FROM s"""
)
def document_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kind of a document by the words it contains; the first listed of equals."""
    low = F.lower("text")
    scores = {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in KINDS.items()}
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", *[s.alias(k) for k, s in scores.items()])
    best = F.greatest(*KINDS)
    kind = F.when(best == 0, "unknown")
    for k in KINDS:
        kind = kind.when(F.col(k) == best, k)
    return docs.select("doc_id", kind.alias("kind"), best.alias("score"))


@register(
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zäöüß]{4,}')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n FROM c ORDER BY n DESC, word LIMIT 50"""
)
def top_words(spark: SparkSession, d: str) -> DataFrame:
    """The fifty most frequent words of four letters or more (a report)."""
    found = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüß]{4,}"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


@register(
    """SELECT id, CAST(CASE WHEN regexp_matches(query, '(?i)compare|difference|区别|vergleich') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(query, '(?i)explain|how|怎么|wie|comment') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(query, '(?i) and |和| und | et ') THEN 1 ELSE 0 END
+ CASE WHEN length(query) > 60 THEN 1 ELSE 0 END AS INT) AS signals FROM search_logs WHERE query IS NOT NULL"""
)
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    """How many signs of a complex question a query shows."""
    logs = table(spark, d, "search_logs", "id", "query").where("query is not null")
    patterns = ["(?i)compare|difference|区别|vergleich", "(?i)explain|how|怎么|wie|comment", "(?i) and |和| und | et "]
    return logs.select("id", (T.count_matches("query", patterns) + (F.length("query") > 60).cast("int")).alias("signals"))
