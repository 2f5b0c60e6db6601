"""A fielded inverted index as relations, kept in files, and ranking over it.

Each text is split once: its terms are reduced to counts where it is, and an empty term stands for the document itself,
so that lengths and statistics come from the same relation. Kept, it lies in buckets by hash of the term, sorted by term;
a ranking reads the columns, buckets and row groups that its queries' terms need. Those terms are broadcast by Spark itself
where they are few and joined otherwise. Top-k is a window per query, which Spark cuts to k rows per partition before it
shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokens, words
from brindle.session import spread

K1, B = 1.5, 0.75
#: Folders of a kept index.
BUCKETS = 16


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """Rows (term, field, doc_id, tf, length, bucket); the term '' stands for the field of a document itself, empty ones too."""

    rows: DataFrame

    def postings(self, *fields: str) -> DataFrame:
        """Rows (bucket, term, field, doc_id, tf, length) of all or some fields."""
        out = self.rows.where("term <> ''")
        return out.where(F.col("field").isin(list(fields))) if fields else out

    def lengths(self) -> DataFrame:
        """Rows (doc_id, field, length): terms of every field, zero included."""
        return self.rows.where((F.col("bucket") == bucket(F.lit(""))) & (F.col("term") == "")).select("doc_id", "field", "length")

    def statistics(self) -> DataFrame:
        """Per field: documents, terms in all, mean length."""
        return self.lengths().groupBy("field").agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("terms"), F.avg("length").alias("mean_length"))


def build(docs: DataFrame, doc_id: str, fields: Mapping[str, Column]) -> Index:
    """The index of the fields of ``docs``, whose ids differ. Null and empty fields have no terms, and length 0."""
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), tokens(c).alias("terms")) for name, c in fields.items()]))
    wide = spread(docs).select(F.col(doc_id).alias("doc_id"), listed.alias("f"))
    terms = wide.select("doc_id", "f.field", F.size("f.terms").alias("length"), F.explode(F.concat(F.array(F.lit("")), "f.terms")).alias("term"))
    return Index(terms.groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length")).withColumn("bucket", bucket(F.col("term"))))


def save(index: Index, folder: str) -> None:
    """Writes an index; a bucket that a frequent term makes large is split over several files."""
    index.rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.schema("term string, field string, doc_id bigint, tf bigint, length int, bucket int").parquet(folder))


def query_terms(queries: DataFrame, query_id: str, query: Column, stop: Column | None = None) -> DataFrame:
    """Rows (query_id, term): distinct terms of each query, without stop words."""
    terms = F.array_distinct(tokens(query))
    if stop is not None:
        terms = F.array_except(terms, stop)
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms).alias("term"))


def bm25(index: Index, boosts: Mapping[str, float], terms: DataFrame, k: int | None = 10, offset: int = 0, min_score: float = 0.0, all_then_any: bool = False) -> DataFrame:
    """Rows (query_id, rank, doc_id, score, matched): documents ranked by BM25 for each query's terms.

    The score adds up over terms and fields, each field with its boost: idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
    tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), k1 = 1.5, b = 0.75. Ties go to the smaller doc_id,
    as scores count to six places. With ``all_then_any`` a query keeps only documents that match all of its terms, if
    there are any. ``min_score`` is applied before paging. ``terms`` are rows (query_id, term), each once per query.
    """
    boost = F.create_map(*[F.lit(x) for name, b in boosts.items() for x in (name, float(b))])
    asked = terms.select("term").distinct().withColumn("bucket", bucket(F.col("term")))
    found = index.postings(*boosts).join(asked, ["bucket", "term"], "left_semi")
    df = found.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    stats = index.statistics().select("field", F.col("documents").alias("n"), F.col("mean_length").alias("mean"))
    weighed = found.join(df, ["term", "field"]).join(F.broadcast(stats), "field")  # one row per field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))) * boost[F.col("field")]
    per_term = weighed.select("term", "doc_id", part.alias("part")).groupBy("term", "doc_id").agg(F.sum("part").alias("part"))
    scored = terms.join(per_term, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    scored = scored.where(F.col("score") >= min_score)
    if all_then_any:
        of = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("of"))
        best = scored.groupBy("query_id").agg(F.max("matched").alias("best"))
        scored = scored.join(best.join(of, "query_id"), "query_id").where((F.col("best") < F.col("of")) | (F.col("matched") == F.col("of")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    if k is not None:
        ranked = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + k))
    return ranked.select("query_id", "rank", "doc_id", "score", "matched")


def phrase_matches(docs: DataFrame, doc_id: str, text: Column, phrases: DataFrame) -> DataFrame:
    """Rows (phrase_id, doc_id, occurrences) for rows (phrase_id, phrase): runs of words equal to the phrase's.

    Places of each phrase's rarest word alone give where it may begin, so a phrase of frequent words costs no more than
    its rarest one; there each of its words is looked up by document and place.
    """
    wanted = phrases.select("phrase_id", words("phrase").alias("p")).where("size(p) > 0")
    asked = wanted.select("phrase_id", F.posexplode("p").alias("k", "term"), F.size("p").alias("n"))
    every = spread(docs).select(F.col(doc_id).alias("doc_id"), F.posexplode(words(text)).alias("at", "term"))
    spots = every.join(asked.select("term").distinct(), "term", "left_semi")
    counts = spots.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    rarest = asked.join(counts, "term", "left").groupBy("phrase_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "term", "k")).alias("r")).where("r.seen > 0").select("phrase_id", "r.term", "r.k")
    begins = spots.join(rarest, "term").where("at >= k").select("phrase_id", "doc_id", (F.col("at") - F.col("k")).alias("start"))
    looked_up = begins.join(asked, "phrase_id").select("phrase_id", "doc_id", "start", "n", (F.col("start") + F.col("k")).alias("at"), "term")
    whole = looked_up.join(spots, ["doc_id", "at", "term"]).groupBy("phrase_id", "doc_id", "start").agg(F.count(F.lit(1)).alias("hit"), F.first("n").alias("n")).where("hit = n")
    return whole.groupBy("phrase_id", "doc_id").agg(F.count(F.lit(1)).alias("occurrences"))


def wildcard_terms(posted: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (pattern, term, df) for rows (pattern): terms that match patterns with * and ?.

    Terms and patterns are joined on as many first characters as all patterns fix.
    """
    fixed = F.regexp_extract("pattern", r"^([^*?]*)", 1)
    lead = patterns.agg(F.min(F.length(fixed))).first()[0] or 0
    vocabulary = posted.groupBy("term").agg(F.countDistinct("doc_id").alias("df")).withColumn("lead", F.substring("term", 1, lead))
    as_like = F.replace(F.replace(F.regexp_replace("pattern", r"([%_\\])", r"\\$1"), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
    asked = patterns.select("pattern", as_like.alias("like"), F.substring("pattern", 1, lead).alias("lead"))
    return vocabulary.join(asked, "lead").where("term like `like`").select("pattern", "term", "df")
