"""Lines that match a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import lines, tokens
from brindle.session import spread


def grep_lines(docs: DataFrame, doc_id: str, text: Column, pattern: str, ignore_case: bool = True, context: int = 0) -> DataFrame:
    """Rows (doc_id, line_no from 1, line, and with ``context`` the lines before and after): every matching line.

    Texts without a match are left out before their lines are exploded.
    """
    regex = f"(?i){pattern}" if ignore_case else pattern
    wide = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text")).where(F.col("text").rlike(regex)).select("doc_id", lines("text").alias("all"))
    rows = wide.select("doc_id", "all", F.posexplode("all").alias("at", "line")).where(F.col("line").rlike(regex))
    out = [F.col("doc_id"), (F.col("at") + 1).alias("line_no"), F.col("line")]
    if context:
        first = F.greatest(F.col("at") - context, F.lit(0))
        out += [F.array_join(F.slice("all", first + 1, F.col("at") - first), "\n").alias("before"), F.array_join(F.slice("all", F.col("at") + 2, F.lit(context)), "\n").alias("after")]
    return rows.select(*out)


def grep_documents(docs: DataFrame, doc_id: str, text: Column, pattern: str, full: int = 50) -> DataFrame:
    """Per document: matching lines, the first of them (200 characters), and log1p(matches) / log1p(full)."""
    hits = grep_lines(docs, doc_id, text, pattern)
    return hits.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("matches"), F.substring(F.min_by("line", "line_no"), 1, 200).alias("first_line"), F.round(F.log1p(F.count(F.lit(1)).cast("double")) / F.log1p(F.lit(float(full))), 6).alias("score")
    )


def count_lines(docs: DataFrame, doc_id: str, text: Column, terms: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id, matches) for rows (query_id, term): lines that hold any of a query's terms, each once.

    A document's lines are gathered by term before the queries are joined, so a frequent term brings one row a document.
    """
    rows = spread(docs).select(F.col(doc_id).alias("doc_id"), F.posexplode(lines(text)).alias("line_no", "line"))
    held = rows.select("doc_id", "line_no", F.explode(F.array_distinct(tokens("line"))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    per_term = held.groupBy("term", "doc_id").agg(F.collect_list("line_no").alias("at"))
    met = per_term.join(terms, "term").groupBy("query_id", "doc_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("bigint").alias("matches"))
    return met
