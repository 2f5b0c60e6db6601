"""Long Markdown texts cut into titled chunks, and ragged tables evened out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(\S.*)$")
FENCE = re.compile(r"^\s*(```|~~~)")


def sections(text: str, levels: tuple[int, ...]) -> list[tuple[str, str]]:
    """(title, text) of the parts that begin at headings of the given levels, outside of fences; the part before them has no title."""
    parts: list[tuple[str, list[str]]] = [("", [])]
    fenced = False
    for line in text.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        found = None if fenced else HEADING.match(line)
        if found and len(found.group(1)) in levels:
            parts.append((found.group(2).strip(), []))
        parts[-1][1].append(line)
    return [(t, "\n".join(x)) for t, x in parts if "\n".join(x).strip()]


def _pack(pieces: list[str], size: int, glue: str) -> list[str]:
    out: list[str] = []
    for piece in pieces:
        while len(piece) > size:
            if out and out[-1] and len(out[-1]) < size:
                out.append("")
            out.append(piece[:size])
            piece = piece[size:]
        if out and len(out[-1]) + len(glue) + len(piece) <= size:
            out[-1] = out[-1] + glue + piece if out[-1] else piece
        else:
            out.append(piece)
    return [x for x in out if x]


def split_text(text: str | None, size: int = 50_000, least: int = 500) -> list[tuple[str, str]]:
    """(title, text) of a text's chunks of at most ``size`` characters.

    A text that fits is one chunk. Others are cut at headings of levels 2 and 3, parts that are still too long at deeper
    ones, then between paragraphs, then anywhere. Chunks shorter than ``least`` join the one before if both fit. No
    character is lost but the breaks between joined pieces.
    """
    if not text or not text.strip():
        return []
    if len(text) <= size:
        return [("", text)]
    parts: list[tuple[str, str]] = []
    for title, body in sections(text, (1, 2, 3)):
        deeper = sections(body, (4, 5, 6)) if len(body) > size else [(title, body)]
        for t, b in deeper:
            parts += [(t or title, x) for x in (_pack(re.split(r"\n\s*\n", b), size, "\n\n") if len(b) > size else [b])]
    out: list[tuple[str, str]] = []
    for t, b in parts:
        if out and (len(b) < least or len(out[-1][1]) < least) and len(out[-1][1]) + 1 + len(b) <= size:
            out[-1] = (out[-1][0] or t, out[-1][1] + "\n" + b)
        else:
            out.append((t, b))
    return out


def chunk(df: DataFrame, doc_id: Column, text: Column, size: int = 50_000, least: int = 500) -> DataFrame:
    """Rows (doc_id, chunk_no from 0, chunk_id, title, text). Null and blank texts have no chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, k, f"{d}#c{k}", t, b) for d, x in zip(frame["doc_id"], frame["text"], strict=True) for k, (t, b) in enumerate(split_text(x, size, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk_id", "title", "text"])

    return df.select(doc_id.cast("string").alias("doc_id"), text.alias("text")).mapInPandas(run, "doc_id string, chunk_no int, chunk_id string, title string, text string")


def even_tables(text: str | None, pad: str = "left") -> str | None:
    """Pipe tables outside of fences with as many cells in each row as in the longest; short rows are padded on one side."""
    if not text or "|" not in text:
        return text
    out: list[str] = []
    block: list[str] = []
    fenced = False

    def close() -> None:
        rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in block]
        rule = [all(re.fullmatch(r":?-+:?", c) for c in r) for r in rows]
        width = max((len(r) for r, is_rule in zip(rows, rule, strict=True) if not is_rule), default=0)
        if len(block) < 2 or not any(rule) or not width:
            out.extend(block)
        else:
            for r, is_rule in zip(rows, rule, strict=True):
                gap = [""] * (width - len(r))
                cells = ["---"] * width if is_rule else (gap + r if pad == "left" else r + gap)
                out.append("| " + " | ".join(cells) + " |")
        block.clear()

    for line in text.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        if not fenced and line.strip().startswith("|"):
            block.append(line)
        else:
            close()
            out.append(line)
    close()
    return "\n".join(out)


def even_out_tables(df: DataFrame, column: str, pad: str = "left") -> DataFrame:
    """``df`` with the pipe tables of one column evened out."""
    fix = F.pandas_udf(lambda s: s.map(lambda x: even_tables(x, pad)), "string")
    return df.withColumn(column, fix(column))
