"""Operators with an exact answer: encoding, leak search, percentiles."""

import base64
import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import bpe, leakage, quantiles

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")


def _slow_encode(piece: bytes, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        low, at = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if low == math.inf:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_pieces_are_merged_as_by_brute_force(text):
    ranks = bpe.load_ranks(VOCABULARY)
    for piece in bpe.regex.compile(bpe.PIECE).findall(text):
        raw = piece.encode("utf-8", "replace")
        assert bpe.encode_piece(raw, ranks) == (_slow_encode(raw, ranks) if ranks.get(raw) is None else [ranks[raw]])


@needs_vocabulary
def test_corpus_is_encoded_as_by_the_reference_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.PIECE, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "\n\n  x", "Don't <|endoftext|> panic", "a" * 5000, "长期护理补贴" * 200, "naïve ﬁ 𝒳 ​", "ab" * 3 + "\r\n\t1234567890"]
    df = spark.createDataFrame(list(enumerate([*texts, texts[4]])), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, F.col("doc_id"), F.col("text")).collect()}
    assert got == {k: library.encode_ordinary(t) if t else [] for k, t in enumerate([*texts, texts[4]])}
    assert bpe.encode_corpus(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def _leaks(docs, items):
    out = set()
    for i, lang, p in items:
        if not p:
            continue
        unit, n = (leakage.chars, 20) if lang == "zh" else (leakage.words, 12)
        grams = {tuple(unit(p)[k : k + n]) for k in range(len(unit(p)) - n + 1)}
        for d, t in docs:
            seq = unit(t)
            if any(tuple(seq[k : k + n]) in grams for k in range(len(seq) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 400)  # several blocks
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(9)] + ["the", "of"]
    han = "甲乙丙丁戊己庚"
    items = [(k, rng.choice(["en", None]), " ".join(rng.choices(pool, k=rng.randrange(5, 40)))) for k in range(8)]
    items += [(20 + k, "zh", "".join(rng.choices(han, k=30)) + "，。") for k in range(4)] + [(30, "en", None), (31, "zh", ""), (32, "en", "too short")]
    docs = []
    for k in range(60):
        _, lang, p = rng.choice(items[:12])
        if lang == "zh":
            a = rng.randrange(0, 12)
            text = "前言。" + " ".join(p[a : a + rng.choice([15, 19, 20, 25])]) + "结尾"
        else:
            seq = p.split()
            a = rng.randrange(0, max(1, len(seq) - 11))
            text = "Intro, " + "-\n".join(x.upper() for x in seq[a : a + rng.choice([8, 11, 12, 20])]) + "! Outro " + " ".join(rng.choices(pool, k=20))
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, "x " * 30000 + docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, lang string, passage string")
    found = leakage.find_leaks(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("passage"), F.col("lang"))
    rows = found.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == _leaks(docs, items) and rows
    texts, passages = dict(docs), {k: (lang, p) for k, lang, p in items}
    for r in rows:
        unit = leakage.chars if r.unit == "char" else leakage.words
        a, b = unit(texts[r.doc_id]), unit(passages[r.item_id][1])
        assert a[r.doc_at : r.doc_at + r.matched] == b[r.item_at : r.item_at + r.matched]
    assert {r.doc_id for r in leakage.clean_corpus(d, "doc_id", found).collect()} == set(texts) - {r.doc_id for r in rows}
    assert leakage.find_leaks(d, F.col("doc_id"), F.col("text"), i.limit(0), F.col("item_id"), F.col("passage"), F.col("lang")).count() == 0
    assert leakage.find_leaks(d.limit(0), F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("passage"), F.col("lang")).count() == 0


@pytest.mark.parametrize("error", [0.001, 0.01, 0.1])
def test_percentiles_keep_their_bound_and_merge(spark, error):
    rng = random.Random(4)
    values = [rng.choice([-1, 1, 1, 1]) * rng.lognormvariate(0, 4) for _ in range(3000)] + [0.0] * 40 + [5.0] * 200
    rows = [(k % 5, rng.choice(["a", None]), v) for k, v in enumerate(values)] + [(9, "a", float("nan")), (9, "a", None), (9, "a", float("inf"))]
    df = spark.createDataFrame(rows, "day int, g string, v double").withColumn("n", F.lit(1))
    daily = quantiles.log_sketch(df, ["day", "g"], F.col("v"), error)
    got = quantiles.sketch_percentiles(quantiles.merge_sketches(daily, ["g"]), ["g"], (0.01, 0.5, 0.99), error).collect()
    assert len(got) == 2
    for r in got:
        own = sorted(v for _, g, v in rows if g == r.g and v is not None and math.isfinite(v))
        assert r.n == len(own)
        for share, found in ((0.01, r.p1), (0.5, r.p50), (0.99, r.p99)):
            exact = own[max(math.ceil(share * len(own)), 1) - 1]
            assert abs(found - exact) <= error * abs(exact) * (1 + 1e-9)
    direct = quantiles.log_sketch(df, ["g"], F.col("v"), error)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(quantiles.merge_sketches(daily, ["g"]).select("g", "sign", "exp", "n")) == key(direct.select("g", "sign", "exp", "n"))
    assert quantiles.sketch_percentiles(quantiles.log_sketch(df.limit(0), ["g"], F.col("v")), ["g"]).count() == 0
