"""Byte-pair encoding of whole texts with a public vocabulary, by segment trees.

Texts are cut into pieces by the vocabulary's own pattern; within a piece, the pair of neighbouring tokens with the
lowest rank is merged until none has a rank. A segment tree over the piece's byte positions keeps the leftmost minimum
of the pair ranks, so a merge costs a logarithmic number of updates at its two live neighbours, and a word of a
million letters takes n log n steps. Frequent pieces are kept in a bounded memory of each Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pattern that cuts text into pieces for the public vocabulary byte_bpe_50k.
PIECE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces that a worker remembers, and the longest that it does; others are encoded anew each time.
REMEMBERED = 200_000
REMEMBERED_BYTES = 64


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes, from a file with a base64 token and its rank on each line."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece of text."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = len(ranks) + 1
    leaves = 1 << (n - 1).bit_length()
    tree = [none] * (2 * leaves)
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the token before it
    for i in range(n - 1):
        tree[leaves + i] = ranks.get(piece[i : i + 2], none)
    for k in range(leaves - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left <= right else right

    def put(i: int, rank: int) -> None:
        k = leaves + i
        tree[k] = rank
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            low = left if left <= right else right
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (low := tree[1]) != none:
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - leaves
        j = end[i]
        stop = end[i] = end[j]
        put(j, none)
        if stop < n:
            before[stop] = i
            put(i, ranks.get(piece[i : end[stop]], none))
        else:
            put(i, none)
        if (p := before[i]) >= 0:
            put(p, ranks.get(piece[p:stop], none))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encode_text(text: str | None, ranks: dict[bytes, int], cut: regex.Pattern, memory: dict[str, list[int]]) -> list[int]:
    """Ids of a text; none for null and empty. Strings of special tokens are ordinary text."""
    ids: list[int] = []
    for piece in cut.findall(text) if text else ():
        known = memory.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "replace")
            known = encode_piece(raw, ranks)
            if len(raw) <= REMEMBERED_BYTES:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[piece] = known
        ids.extend(known)
    return ids


def encode_corpus(df: DataFrame, row_id: Column, text: Column, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (doc_id, ids): every text of ``df`` as token ids, without special tokens.

    Null and empty texts have an empty list of ids. Each row is encoded on its own, so repeated rows repeat and a hot
    source needs no shuffle. The vocabulary's file is read by each worker from ``folder``, which every machine has to
    hold.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cut, memory = load_ranks(path), regex.compile(PIECE), {}
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids = [encode_text(t.as_py(), ranks, cut, memory) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(row_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
