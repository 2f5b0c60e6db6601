"""Trailing totals, sessions and nested records against plain Python, with the odd cases."""

import datetime as dt
import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.clean import key_form, log_time
from brindle.operators import nested, rolling, sessions


def test_log_time_reads_every_form(spark):
    forms = ["2024-01-01 01:00:00", "2024-01-01T01:00:00Z", "2024-01-01T09:00:00+08:00", "2024-01-01 01:00:00.250", "1704070800", "1704070800.5", " ", "soon", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(forms)], "k int, v string")
    got = [r.us for r in df.select("k", F.unix_micros(log_time("v")).alias("us")).orderBy("k").collect()]
    base = 1704070800_000000
    assert got == [base, base, base, base + 250000, base, base + 500000, None, None, None]


def test_key_form_drops_outer_blanks(spark):
    df = spark.createDataFrame([(" A B ",), ("　x ",), ("",), ("  ",), (None,)], "v string")
    assert [r.k for r in df.select(key_form("v").alias("k")).collect()] == ["a b", "x", None, None, None]


def test_rolling_totals_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 5, 20, 41, 60])), rng.choice([None, 3, 7])) for _ in range(60)]
    rows.append(("c", None, 4))
    df = spark.createDataFrame(rows, "entity string, day timestamp, total bigint")
    got = {(r.entity, r.day): r for r in rolling.rolling_totals(df, F.col("entity"), F.col("day"), F.col("total")).collect()}
    by = defaultdict(list)
    for e, t, v in rows:
        if e and t:
            by[e].append((t.date(), v))
    expected = 0
    for e, own in by.items():
        day, last = min(d for d, _ in own), max(d for d, _ in own)
        while day <= last:
            expected += 1
            r = got[e, day]
            for n in (7, 30):
                inside = [v for d, v in own if day - dt.timedelta(days=n) < d <= day]
                total, valued = sum(v or 0 for v in inside), [v for v in inside if v is not None]
                assert (r[f"rows_{n}"], r[f"total_{n}"]) == (len(inside), total)
                assert r[f"avg_{n}"] == pytest.approx(total / n)
                assert r[f"avg_row_{n}"] == (pytest.approx(total / len(valued)) if valued else None)
            day += dt.timedelta(days=1)
    assert expected == len(got)


def test_rolling_totals_of_nothing(spark):
    df = spark.createDataFrame([], "entity string, day timestamp, total bigint, rows int")
    out = rolling.rolling_totals(df, F.col("entity"), F.col("day"), F.col("total"))
    assert out.count() == 0 and rolling.silent_days(out).count() == 0


@pytest.mark.parametrize("gap", [1, 5, 64, 100, 1800])
def test_closing_fills_holes_up_to_the_gap(gap):
    rng = np.random.default_rng(gap)
    width = (6000 + gap) // 64 + 2
    at = np.sort(rng.choice(5000, 40, replace=False))
    bits = np.zeros((1, width), dtype=np.uint64)
    for i in at:
        bits[0, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    shut = sessions.close_gaps(bits, gap)
    got = {i for i in range(width * 64) if shut[0, i // 64] >> np.uint64(i % 64) & np.uint64(1)}
    want = set(at.tolist())
    for a, b in zip(at, at[1:]):
        if b - a <= gap:
            want |= set(range(a, b))
    assert got == want


def _plain_sessions(rows, gap):
    by = defaultdict(list)
    for e, t, i in rows:
        if e is not None and t is not None:
            by[e].append((t, i))
    out = []
    for e, own in by.items():
        own.sort()
        run = [own[0]]
        for p, q in zip(own, own[1:]):
            if q[0] - p[0] > dt.timedelta(seconds=gap):
                out.append((e, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(q)
        out.append((e, run[0][1], run[-1][1], len(run)))
    return sorted(out)


def test_sessions_against_plain_python(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1, 22, 30)
    rows, i = [], 0
    for e in ["hot"] * 60 + [f"t{k}" for k in range(12)]:
        t = start + dt.timedelta(days=rng.randrange(3), microseconds=rng.randrange(10**6))
        for _ in range(rng.randrange(1, 25)):
            t += rng.choice([dt.timedelta(0), dt.timedelta(minutes=30), dt.timedelta(minutes=30, microseconds=1), dt.timedelta(seconds=1799, microseconds=999999), dt.timedelta(hours=3), dt.timedelta(minutes=2)])
            i += 1
            rows.append((e, t, i))
    rows += [(None, start, 0), ("t1", None, -1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "entity string, second timestamp, rows bigint")
    got = sessions.sessionize(df, F.col("entity"), F.col("second"), F.col("rows")).collect()
    assert sorted((r.entity, r.first_id, r.last_id, r.rows) for r in got) == _plain_sessions(rows, 1800)
    assert all(r.duration_s == pytest.approx((r.end - r.start).total_seconds()) for r in got)


def test_sessions_of_nothing(spark):
    assert sessions.sessionize(spark.createDataFrame([], "e string, t timestamp, i bigint"), F.col("e"), F.col("t"), F.col("i")).count() == 0


CALLS = [
    None, "", "null", "[]", "[null]", "not json", '[{"tool": "a"}, {"tool', '{"tool": "a", "content": {"results": [null, {"doc_id": "x"}, {"doc_id": null}, {}]}}',
    json.dumps(json.dumps([{"tool": "b", "content": json.dumps({"results": [{"doc_id": "y"}]})}])), '{"calls": [null, {"tool": "c", "content": "[1, {\\"doc_id\\": \\"z\\"}]"}], "version": 2}',
    '[{"tool": "d", "content": {"results": null, "total": 0}}, {"content": "plain words"}, {"content": {"doc_id": "alone"}}, 7, "s"]', '{"calls": {"tool": "e"}}', '[{"tool": "f", "content": "{\\"results\\": [{\\"doc_id\\""}] ',
]
HITS = ['[{"doc_id": "h1"}, null, {"title": "t"}]', '{"results": [{"doc_id": "h2"}], "total": 1}', '{"doc_id": "h3"}', json.dumps('[{"doc_id": "h4"}]'), '{"results": null}', "[1, 2]", '{"results": {"doc_id": "h5"}}', None, "[", '{"results": "[{\\"doc_id\\": \\"h6\\"}]"}', "true", "{}", " [ ] "]


def _load(t):
    try:
        return json.loads(t)
    except (TypeError, ValueError):
        return None


def _list(v, key):
    if isinstance(v, str):
        v = _load(v)
    if isinstance(v, str):
        v = _load(v)
    if isinstance(v, dict):
        v = v[key] if key in v else [v]
        v = _load(v) if isinstance(v, str) else v
        v = [v] if isinstance(v, dict) else v
    return v if isinstance(v, list) else []


def test_nested_records_against_plain_python(spark):
    rows = [(k, c, h) for k, (c, h) in enumerate(zip(CALLS, HITS, strict=True))]
    df = spark.createDataFrame(rows, "id bigint, calls string, hits string")
    want = []
    for i, c, h in rows:
        want += [(i, -1, k, x.get("doc_id") or "") for k, x in enumerate(_list(h, "results")) if isinstance(x, dict)]
        for k, x in enumerate(_list(c, "calls")):
            if isinstance(x, dict):
                want.append((i, k, -1, ""))
                want += [(i, k, m, y.get("doc_id") or "") for m, y in enumerate(_list(x.get("content"), "results")) if isinstance(y, dict)]
    got = nested.flatten_links(df, F.col("id"), F.col("calls"), F.col("hits"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    calls = nested.flatten_calls(df, F.col("id"), F.col("calls")).collect()
    assert sorted((r.id, r.call_no) for r in calls) == sorted((i, k) for i, k, m, _ in want if k >= 0 and m < 0)
    hits = nested.flatten_hits(df, F.col("id"), F.col("calls"), F.col("hits")).collect()
    assert sorted((r.id, r.call_no, r.hit_no) for r in hits) == sorted((i, k, m) for i, k, m, _ in want if m >= 0)
    assert nested.flatten_links(df.limit(0), F.col("id"), F.col("calls"), F.col("hits")).count() == 0


def test_the_bitmaps_decide_the_sessions(spark, monkeypatch):
    """With holes that aren't closed every second would be a session of its own; only exact gaps are told by the rows."""
    start = dt.datetime(2024, 1, 1, 8)
    rows = [("a", start + dt.timedelta(minutes=k), k) for k in range(30)] + [("a", start + dt.timedelta(hours=3), 99)]
    df = spark.createDataFrame(rows, "e string, t timestamp, i bigint")
    assert sessions.sessionize(df, F.col("e"), F.col("t"), F.col("i")).count() == 2
    cells = [np.array(x, dtype=np.int64) for x in ([0] * 4, [10, 11, 70, 2000], [10_000_000, 11_000_000, 70_000_000, 2_000_000_000], [10_000_000, 11_000_000, 70_000_000, 2_000_000_000])]
    assert sessions._runs(*cells, 1800).tolist() == [0, 3]
    monkeypatch.setattr(sessions, "close_gaps", lambda words, gap: words)
    assert sessions._runs(*cells, 1800).tolist() == [0, 2, 3]  # neighbouring bits need no closing


def test_sessions_of_repeated_rows_null_ids_and_seconds_cut_by_batches(spark):
    start = dt.datetime(2024, 1, 1, 8)
    rows = [("a", start + dt.timedelta(microseconds=k % 7 * 100_000), None if k == 0 else k) for k in range(300)] + [("a", start + dt.timedelta(seconds=1800, microseconds=600_000), 500), ("b", start, 1), ("b", start, 1)]
    df = spark.createDataFrame(rows, "entity string, t timestamp, i bigint")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        got = sorted((r.entity, r.first_id, r.last_id, r.rows) for r in sessions.sessionize(df, F.col("entity"), F.col("t"), F.col("i")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == [("a", None, 500, 301), ("b", 1, 1, 2)]
