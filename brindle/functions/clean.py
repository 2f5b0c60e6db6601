"""Column functions that bring dirty text columns into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks at the ends of a key: white space in the Unicode sense, BOM and zero-width space.
BLANKS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_form(c: Column | str) -> Column:
    """Trimmed and in lower case; null where nothing remains."""
    return F.nullif(F.lower(F.trim(as_column(c), F.lit(BLANKS))), F.lit(""))


def log_time(c: Column | str) -> Column:
    """Text in one of the log's forms as a UTC timestamp; null where it is none.

    No zone means UTC; ``Z``, a numeric offset, fractions and epoch seconds are read too. The session's time zone
    has to be UTC, as everywhere in this library.
    """
    text = F.trim(as_column(c))
    epoch = text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$")
    return F.when(epoch, F.timestamp_micros((text.try_cast("decimal(18,6)") * 1000000).try_cast("bigint"))).otherwise(text.try_cast("timestamp"))
