"""Masks that can be taken off again: numbered placeholders and what they stand for."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, in the order in which they are looked for.
PATTERNS = {
    "ID_CARD": r"(?<!\d)\d{17}[\dXx](?![\dXx])", "BANK_CARD": r"(?<!\d)\d{16,19}(?!\d)", "PHONE": r"(?<!\d)1[3-9]\d{9}(?!\d)", "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "IP": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
}
MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("mapping", T.MapType(T.StringType(), T.StringType()))])


def mask_text(text: str | None, patterns: Mapping[str, str] = PATTERNS, words: tuple[str, ...] = ()) -> tuple[str | None, dict[str, str]]:
    """Text with ``[KIND_n]`` for each match, numbered in one series, and what each stands for; the longest words first."""
    mapping: dict[str, str] = {}
    if not text:
        return text, mapping

    def put(kind: str):
        def one(m: re.Match) -> str:
            name = f"[{kind}_{len(mapping) + 1}]"
            mapping[name] = m.group()
            return name

        return one

    for kind, pattern in patterns.items():
        text = re.sub(pattern, put(kind), text)
    for word in sorted(filter(None, words), key=len, reverse=True):
        text = re.sub(re.escape(word), put("KEYWORD"), text)
    return text, mapping


def unmask_text(text: str | None, mapping: Mapping[str, str] | None) -> str | None:
    for name, value in reversed(list((mapping or {}).items())):
        text = text.replace(name, value) if text else text
    return text


def masked(c: Column, patterns: Mapping[str, str] = PATTERNS, words: tuple[str, ...] = ()) -> Column:
    """Struct of the masked text and its mapping."""

    def run(texts: pd.Series) -> pd.DataFrame:
        pairs = [mask_text(t, patterns, words) for t in texts]
        return pd.DataFrame({"text": [p[0] for p in pairs], "mapping": [p[1] for p in pairs]})

    return F.pandas_udf(run, MASKED)(c)


def mask_only(c: Column, patterns: Mapping[str, str] = PATTERNS) -> Column:
    """The text with ``[KIND]`` for each match, within the JVM; nothing is kept by which the masks could come off."""
    for kind, pattern in patterns.items():
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return c


def unmasked(text: Column, mapping: Column) -> Column:
    """The original of a masked text, within the JVM."""
    return F.reduce(F.map_entries(F.coalesce(mapping, F.create_map().cast("map<string,string>"))), text, lambda t, e: F.replace(t, e["key"], e["value"]))
