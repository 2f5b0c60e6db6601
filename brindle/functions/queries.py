"""Query strings taken apart, as columns: phrases, fields, wildcards and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.clean import as_column
from brindle.functions.text import tokens

PHRASE = "[\"']([^\"']+)[\"']"
FIELD = r"([A-Za-z0-9_]+):([^ \t\r\n]+)"
#: Words that say nothing in a query, English and Chinese (pairs of characters, as terms are).
STOP = "a an the of to in on for and or is are be by at with from as it this that what which who how do does can may i my we our you your 什么 怎么 如何 请问 哪些 多少 是否 可以 一个 我们 你们".split()


def parts(c: Column | str) -> Column:
    """struct<phrases, fields array<struct<field, value>>, wildcard, terms>: phrases are taken out first, then fields; what is left gives the flag and the terms without stop words.

    Null gives empty lists. Of a field named twice both values are kept, in order.
    """
    text = F.coalesce(as_column(c), F.lit(""))
    phrases = F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1))
    bare = F.regexp_replace(text, PHRASE, " ")
    pairs = F.regexp_extract_all(bare, F.lit(FIELD), F.lit(0))
    fields = F.transform(pairs, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("field"), F.regexp_replace(x, "^[^:]*:", "").alias("value")))
    rest = F.regexp_replace(bare, FIELD, " ")
    stop = F.array(*[F.lit(w) for w in STOP])
    return F.struct(phrases.alias("phrases"), fields.alias("fields"), rest.rlike("[*?]").alias("wildcard"), F.array_except(F.array_distinct(tokens(rest)), stop).alias("terms"))
