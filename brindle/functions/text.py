"""Column functions on text: tokens, snippets, structure of Markdown, hashes and the like. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.clean import as_column

WORD = r"[\p{L}\p{N}]+"
HAN_RUN = r"[\x{4e00}-\x{9fff}]+"
OTHER_WORD = r"[^\P{L}\x{4e00}-\x{9fff}]+|[\p{N}]+"


def words(c: Column | str) -> Column:
    """Runs of letters and digits, in lower case, in order; an empty list for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(as_column(c), F.lit(""))), F.lit(WORD), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Index terms: words of letters and digits, however long; runs of Han characters as overlapping pairs.

    Single Han characters stand alone. Words come first, then pairs, each in order of appearance.
    """
    text = F.lower(F.coalesce(as_column(c), F.lit("")))
    plain = F.regexp_extract_all(F.regexp_replace(text, HAN_RUN, " "), F.lit(WORD), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(plain, pairs)


def snippet(c: Column | str, size: int = 200) -> Column:
    """The text cut to ``size`` characters, the last three of them dots where it was longer."""
    text = as_column(c)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def excerpt(c: Column | str, word: Column | str, around: int = 50, head: int = 200) -> Column:
    """The surroundings of the first occurrence of ``word`` in whatever case, with dots where text was cut off; the text's head where it doesn't occur."""
    text, low = as_column(c), F.lower(as_column(c))
    at = F.locate(F.lower(as_column(word)), low) if isinstance(word, str) else F.position(F.lower(word), low)
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + F.length(as_column(word)) + around - 1, F.length(text))
    body = F.substring(text, start, stop - start + 1)
    cut = F.concat(F.when(start > 1, F.lit("...")).otherwise(""), body, F.when(stop < F.length(text), F.lit("...")).otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, head))


def contained(c: Column | str, terms: Column, most: int = 5) -> Column:
    """Those of ``terms`` that the text contains in whatever case, the first ``most`` of them."""
    low = F.lower(as_column(c))
    return F.slice(F.filter(terms, lambda t: F.contains(low, F.lower(t))), 1, most)


def emphasise(c: Column | str, pattern: str, size: int = 200) -> Column:
    """The text's head with what matches ``pattern`` in double stars."""
    return F.regexp_replace(F.substring(as_column(c), 1, size), f"(?i)({pattern})", r"**$1**")


FRONT_MATTER = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


def has_front_matter(c: Column | str) -> Column:
    return as_column(c).rlike(FRONT_MATTER)


def front_matter(c: Column | str) -> Column:
    """Text between the two rules at the head; empty where there is none."""
    return F.regexp_extract(as_column(c), FRONT_MATTER, 1)


def strip_front_matter(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), FRONT_MATTER, "")


def front_matter_field(c: Column | str, name: str) -> Column:
    """A one-line field of the front matter without quotes; null where it is missing."""
    value = F.regexp_extract(front_matter(c), rf"(?m)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def add_front_matter(c: Column | str, **fields: Column) -> Column:
    """``c`` with the fields put before it; a front matter that is there already is replaced."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n"), strip_front_matter(c))


def lines(c: Column | str) -> Column:
    return F.split(as_column(c), r"\r\n|\n|\r")


def headings(c: Column | str, most: int = 30) -> Column:
    """Markdown headings outside of fences: array of (level, text, line), lines counted from 1, the first ``most``."""
    state = F.aggregate(
        lines(c),
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("fence"), F.array().cast("array<struct<level:int,text:string,line:int>>").alias("found")),
        lambda a, x: F.struct(
            (a["n"] + 1).alias("n"),
            F.when(x.rlike(r"^\s*```"), ~a["fence"]).otherwise(a["fence"]).alias("fence"),
            F.when(
                ~a["fence"] & x.rlike(r"^#{1,6}\s+\S"),
                F.concat(a["found"], F.array(F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("text"), (a["n"] + 1).alias("line")))),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.slice(state, 1, most)


def sample_text(c: Column | str, limit: int, head: int, middle: int, tail: int, mark: str = "") -> Column:
    """Head, middle and tail of texts longer than ``limit``, with ``mark`` between; shorter texts as they are."""
    text = as_column(c)
    mid = F.substring(text, (F.length(text) / 2 - middle / 2).cast("int") + 1, F.lit(middle))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(mark), mid, F.lit(mark), F.substring(text, F.length(text) - tail + 1, F.lit(tail)))).otherwise(text)


def strip_html(c: Column | str) -> Column:
    """Text of an HTML string: scripts and styles dropped, block ends as line ends, five entities, blank lines collapsed."""
    text = F.regexp_replace(as_column(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\n\s*\n+", "\n\n"))


def clean_scan(c: Column | str) -> Column:
    """Line ends made one kind, control characters dropped, three or more line ends made two, ends trimmed."""
    text = F.regexp_replace(as_column(c), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def truncate_at_sentence(c: Column | str, limit: int, least: float = 0.7) -> Column:
    """The text cut at its last sentence mark within ``limit`` if that keeps ``least`` of it, else at ``limit``."""
    text = as_column(c)
    head = F.substring(text, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^.*[.!?。！？]", 0)
    return F.when(F.length(text) <= limit, text).when(F.length(whole) >= limit * least, whole).otherwise(head)


def bigram_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the sets of character pairs, blanks dropped; 0 where either has none."""

    def pairs(c: Column | str) -> Column:
        chars = F.split(F.regexp_replace(F.coalesce(as_column(c), F.lit("")), r"\s+", ""), "")
        chars = F.filter(chars, lambda x: x != "")
        n = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda x, y: F.concat(x, y)))

    # The sets are bound once, so that they aren't computed anew wherever they are used.
    sets = F.array(F.struct(pairs(a).alias("x"), pairs(b).alias("y")))
    both = lambda s: F.size(F.array_union(s["x"], s["y"]))
    return F.transform(sets, lambda s: F.when(both(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s["x"], s["y"])) / both(s)))[0]


def rescue_json(c: Column | str) -> Column:
    """The JSON object in a text: the text itself, that in a fenced block, or that between the outermost braces; null if none parses."""
    text = as_column(c)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = lambda x: F.when(F.json_object_keys(x).isNotNull(), x)
    blanks = F.lit(" \t\r\n")
    return F.coalesce(ok(F.trim(text, blanks)), ok(F.trim(fenced, blanks)), ok(braces))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(as_column(path), r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_column(path), r"(\.[^./\\]+)$", 1))


def path_id(path: Column | str) -> Column:
    """Identity of a document: the first 16 hex digits of its path's SHA-256."""
    return F.substring(F.sha2(as_column(path), 256), 1, 16)


def human_size(n: Column | str) -> Column:
    size = as_column(n).cast("double")
    return F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B"))).when(size < 1024**2, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB"))).when(size < 1024**3, F.concat(F.format_string("%.1f", size / 1024**2), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", size / 1024**3), F.lit(" GB")))


def filetime(ticks: Column | str) -> Column:
    """100-nanosecond ticks since 1601 as a timestamp."""
    return F.timestamp_micros(F.expr("cast(({}) div 10 as bigint)".format(ticks)) - 11644473600000000) if isinstance(ticks, str) else F.timestamp_micros((F.floor(ticks / 10)).cast("bigint") - 11644473600000000)


def count_matches(c: Column | str, patterns: Sequence[str]) -> Column:
    """How many of the patterns a text matches."""
    text = as_column(c)
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))
