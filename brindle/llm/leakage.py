"""Held-out passages inside a corpus, by suffix arrays of its shards.

A shard is a bounded number of symbols of the corpus: words (for Chinese items, characters) of as many texts as fit.
Each shard's suffixes are sorted by prefix doubling; every suffix of every test passage is then looked up by binary
search, and the shard's suffixes beside its place give the longest verbatim matches and where they are.

Only symbols that occur in a passage can be part of a match. Runs of such symbols shorter than the shortest match that
counts are left out of the shards, which loses no match. Shards are built where the texts are, without a shuffle. The
passages travel to the workers in blocks of a bounded size, one pass over the corpus for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest run that counts: words, and characters for items in Chinese.
MIN_WORDS = 12
MIN_CHARS = 20
#: Symbols of one shard; a text that has more makes a shard of its own.
SHARD_SYMBOLS = 1_000_000
#: Characters of passages that one pass takes along.
BLOCK_CHARS = 16_000_000

WORD = re.compile(r"[^\W_]+")

MATCHES = "doc_id bigint, item_id bigint, unit string, matched int, doc_at int, item_at int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def chars(text: str | None) -> str:
    return "".join(WORD.findall(text.lower())) if text else ""


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes by their first ``depth`` symbols or more, and the ranks after each doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    have = 1
    while have < depth and n:
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1 if have < n else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        have *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Passages:
    """One block of test items, coded for one unit (words or characters)."""

    def __init__(self, items: list[tuple[int, list[str] | str]], least: int) -> None:
        self.least = least
        names = sorted({s for _, seq in items for s in seq})
        self.code = {s: i + 1 for i, s in enumerate(names)}
        self.ids, self.at, seqs = [], [], []
        for item, seq in items:
            if len(seq) >= least:
                coded = np.fromiter((self.code[s] for s in seq), dtype=np.int32, count=len(seq))
                seqs += [coded, np.zeros(1, dtype=np.int32)]
                self.ids += [item] * (len(seq) + 1)
                self.at += range(len(seq) + 1)
        self.text = np.concatenate(seqs) if seqs else np.zeros(0, dtype=np.int32)
        self.ids, self.at = np.array(self.ids, dtype=np.int64), np.array(self.at, dtype=np.int32)
        ends = np.flatnonzero(self.text == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(self.text)))] - np.arange(len(self.text)) if len(ends) else np.zeros(0, dtype=np.int64)
        self.starts = np.flatnonzero(self.left >= least)
        self.longest = int(self.left.max()) if len(self.left) else 0


class Shard:
    def __init__(self, passages: Passages) -> None:
        self.passages, self.pieces, self.docs, self.size = passages, [], [], 0

    def add(self, doc: int, symbols: list[str] | str) -> None:
        """Takes over the runs of symbols that can match."""
        code, least = self.passages.code, self.passages.least
        if len(symbols) < least:
            return
        coded = np.fromiter((code.get(s, 0) for s in symbols), dtype=np.int32, count=len(symbols))
        known = np.flatnonzero(np.diff(np.r_[0, coded != 0, 0].astype(np.int8)))
        for a, b in zip(known[::2], known[1::2], strict=True):
            if b - a >= least:
                self.pieces.append(coded[a:b])
                self.docs.append((doc, int(a), int(b - a)))
                self.size += int(b - a) + 1

    def matches(self) -> pd.DataFrame | None:
        """Longest match of each document with each item that has one of the least length."""
        p = self.passages
        if not self.pieces or not len(p.starts):
            return None
        stop = np.zeros(1, dtype=np.int32)
        text = np.concatenate([x for piece in self.pieces for x in (piece, stop)])
        lengths = np.array([n for *_, n in self.docs]) + 1
        doc = np.repeat([d for d, *_ in self.docs], lengths)
        at = np.concatenate([np.arange(a, a + n + 1) for _, a, n in self.docs])
        room = np.concatenate([np.arange(n, -1, -1) for *_, n in self.docs])
        order = suffix_array(text, p.longest)
        padded, test = np.r_[text, np.full(p.longest + 1, -1, dtype=np.int32)], np.r_[p.text, np.full(p.longest + 1, -2, dtype=np.int32)]

        def bound(upper: bool) -> np.ndarray:
            """For every test suffix, the first shard suffix that is not below its ``least`` symbols (or above them)."""
            low, high = np.zeros(len(p.starts), dtype=np.int64), np.full(len(p.starts), len(order), dtype=np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                a, b = order[mid], p.starts[open_]
                below = np.zeros(len(open_), dtype=bool)
                same = np.ones(len(open_), dtype=bool)
                for k in range(p.least):
                    x, y = padded[a + k], test[b + k]
                    below |= same & (x < y)
                    same &= x == y
                go = below | same if upper else below
                low[open_[go]] = mid[go] + 1
                high[open_[~go]] = mid[~go]
            return low

        first, last = bound(False), bound(True)
        found = np.flatnonzero(last > first)
        if not len(found):
            return None
        counts = last[found] - first[found]
        rows = []
        step = max(1, 4_000_000 // int(counts.max()))
        for cut in range(0, len(found), step):
            f, c = found[cut : cut + step], counts[cut : cut + step]
            suffix = np.repeat(p.starts[f], c)
            place = order[np.repeat(first[f], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            # Only where the match can't be made longer to the left does a maximal match begin.
            inner = (place > 0) & (suffix > 0)
            inner &= (padded[place - 1] == test[suffix - 1]) & (padded[place - 1] > 0)
            suffix, place = suffix[~inner], place[~inner]
            length = np.full(len(place), p.least, dtype=np.int32)
            most = np.minimum(room[place], p.left[suffix])
            open_ = np.flatnonzero(length < most)
            while open_.size:
                go = padded[place[open_] + length[open_]] == test[suffix[open_] + length[open_]]
                open_ = open_[go]
                length[open_] += 1
                open_ = open_[length[open_] < most[open_]]
            rows.append(pd.DataFrame({"doc_id": doc[place], "item_id": p.ids[suffix], "matched": length, "doc_at": at[place], "item_at": p.at[suffix]}))
        out = pd.concat(rows, ignore_index=True).sort_values(["doc_id", "item_id", "matched", "doc_at", "item_at"], ascending=[True, True, False, True, True])
        return out.drop_duplicates(["doc_id", "item_id"])


def _search(by_word: Passages, by_char: Passages):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = {"word": Shard(by_word), "char": Shard(by_char)}

        def flush(unit: str) -> Iterator[pd.DataFrame]:
            found = shards[unit].matches()
            shards[unit] = Shard(shards[unit].passages)
            if found is not None:
                yield found.assign(unit=unit)[["doc_id", "item_id", "unit", "matched", "doc_at", "item_at"]]

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                if not text:
                    continue
                shards["word"].add(doc, words(text))
                shards["char"].add(doc, chars(text))
                for unit, shard in shards.items():
                    if shard.size >= SHARD_SYMBOLS:
                        yield from flush(unit)
        for unit in shards:
            yield from flush(unit)

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of bounded size, each read on its own."""
    size = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    count = -(-int(size) // BLOCK_CHARS)
    for k in range(count):
        yield items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect()


def find_leaks(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, passage: Column, lang: Column) -> DataFrame:
    """Rows (doc_id, item_id, unit, matched, doc_at, item_at): each document with each test item found in it.

    A match is a run of at least 12 words of the passage (unbroken letters and digits, in lower case); for items with
    lang 'zh' one of at least 20 characters, everything but letters and digits dropped. ``matched`` is the longest
    run's length in those units, ``doc_at`` and ``item_at`` its places counted in them. Null and empty texts and
    passages, and passages that are too short, have no match; null lang counts as not Chinese. Repeated texts are
    found each under its own id. Empty tables give an empty result.
    """
    wanted = items.select(item_id.cast("bigint").alias("item_id"), passage.alias("passage"), lang.alias("lang")).where("item_id is not null and passage is not null")
    corpus = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null")
    found = None
    for block in _blocks(wanted):
        by_word = Passages([(r.item_id, words(r.passage)) for r in block if r.lang != "zh"], MIN_WORDS)
        by_char = Passages([(r.item_id, chars(r.passage)) for r in block if r.lang == "zh"], MIN_CHARS)
        part = corpus.mapInPandas(_search(by_word, by_char), MATCHES)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if found is None else found


def clean_corpus(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents without those that hold a test passage."""
    return docs.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
