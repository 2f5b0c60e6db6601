"""Filters given as data: named fields, operators and values, joined by and / or."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = {"=": "__eq__", "!=": "__ne__", "≠": "__ne__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "≥": "__ge__", "<=": "__le__", "≤": "__le__"}


def condition(field: Column, operator: str, value: object = None) -> Column:
    """One comparison. Text is compared regardless of case; what isn't a number, or is null, fails a comparison of numbers."""
    text = F.lower(field.cast("string"))
    low = str(value).lower() if value is not None else ""
    listed = [str(v).strip().lower() for v in (value if isinstance(value, (list, tuple)) else low.split(","))]
    if operator in NUMBERS:
        try:
            number = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return F.lit(False)
        return F.coalesce(getattr(field.cast("string").try_cast("double"), NUMBERS[operator])(F.lit(number)), F.lit(False))
    found = {
        "is": text == low, "is not": ~text.eqNullSafe(F.lit(low)), "contains": F.contains(text, F.lit(low)), "not contains": ~F.coalesce(F.contains(text, F.lit(low)), F.lit(False)),
        "start with": text.startswith(low), "end with": text.endswith(low), "in": text.isin(listed), "not in": ~F.coalesce(text.isin(listed), F.lit(False)),
        "before": field.cast("string") < str(value), "after": field.cast("string") > str(value), "empty": F.coalesce(text, F.lit("")) == "", "not empty": F.coalesce(text, F.lit("")) != "",
    }
    if operator not in found:
        raise ValueError(f"unknown operator: {operator}")
    return F.coalesce(found[operator], F.lit(False))


def conditions(fields: Mapping[str, Column], listed: Sequence[tuple[str, str, object]], joined: str = "and") -> Column:
    """All or any of several conditions (field, operator, value); an empty list holds. An unknown field is null."""
    if not listed:
        return F.lit(True)
    parts = [condition(fields.get(name, F.lit(None).cast("string")), op, value) for name, op, value in listed]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if joined == "and" else out | p
    return out


def squash(score: Column, steepness: float = 1.0) -> Column:
    """Scores above 0 between 0 and 1, rising; 0 for others."""
    return F.when(score > 0, F.tanh(score * steepness)).otherwise(0.0)
