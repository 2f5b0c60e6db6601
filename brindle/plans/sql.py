"""Pieces of SQL that the queries' SQL shares."""

from __future__ import annotations

TRIM = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def key_sql(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, '^{TRIM}|{TRIM}$', '', 'g')), '')"


def time_sql(column: str) -> str:
    """SQL of ``log_time``."""
    return (
        f"CASE WHEN regexp_full_match(trim({column}), '[+-]?[0-9]+([.][0-9]+)?') THEN make_timestamp(CAST(round(CAST(trim({column}) AS DOUBLE) * 1e6) AS BIGINT)) "
        f"ELSE timezone('UTC', TRY_CAST(CASE WHEN regexp_matches(trim({column}), '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN trim({column}) ELSE trim({column}) || '+00' END AS TIMESTAMPTZ)) END"
    )
