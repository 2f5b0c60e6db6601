"""The core's other operators: cases by hand, odd values, and the registered queries against DuckDB."""

import datetime as dt
import glob
import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from brindle.functions import masking, queries
from brindle.functions import text as T
from brindle.functions.conditions import conditions
from brindle.operators import chunks, fusion, grep, index, ranks, recall, snapshots
from brindle.plans import registry
from brindle.sources import files, sinks
from brindle.streaming import jobs

DATA = "/root/testdata/sf0.001"


def _column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_tokens(spark):
    got = _column(spark, ["Don't panic, 42x!", "年假 and 长期护理a", "甲", None, "", "x" * 41], T.tokens)
    assert got == [["don", "t", "panic", "42x"], ["and", "a", "年假", "长期", "期护", "护理"], ["甲"], [], [], ["x" * 41]]


def test_text_functions(spark):
    assert _column(spark, ["a" * 201, "short", None], T.snippet) == ["a" * 197 + "...", "short", None]
    page = "---\ntitle: \"A b\"\nk: 1\n---\n# One\n```\n# no\n```\n###  Two  \ntext"
    assert _column(spark, [page, "plain", None], T.strip_front_matter) == [page.split("---\n")[-1], "plain", None]
    assert _column(spark, [page, "plain"], lambda c: T.front_matter_field(c, "title")) == ["A b", None]
    assert [[(h.level, h.text, h.line) for h in x] for x in _column(spark, [page], T.headings)] == [[(1, "One", 5), (3, "Two", 9)]]
    assert _column(spark, [page], lambda c: T.strip_front_matter(T.add_front_matter(c, a=F.lit("1")))) == [page.split("---\n")[-1]]
    assert _column(spark, ["<p>a&amp;b</p><script>x</script><br>c<style>y</style>"], T.strip_html) == ["a&b\n\nc"]
    assert _column(spark, ["One. Two three four", "abc", "no mark at all here"], lambda c: T.truncate_at_sentence(c, 6, 0.5)) == ["One.", "abc", "no mar"]
    assert _column(spark, ['x ```json\n{"a": 1}\n``` y', '{"b": 2}', 'pre {"c": 3} post', "none", None], T.rescue_json) == ['{"a": 1}', '{"b": 2}', '{"c": 3}', None, None]
    assert _column(spark, [0, 1023, 1536, 3 * 1024**2], T.human_size, "bigint") == ["0 B", "1023 B", "1.5 KB", "3.0 MB"]
    assert [str(x) for x in _column(spark, [116444736000000000], lambda c: T.filetime(c), "bigint")] == ["1970-01-01 00:00:00"]
    df = spark.createDataFrame([("ab cd", "abcd"), ("ab", ""), (None, None), ("abab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(T.bigram_overlap("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.5]


def test_ranking_prefers_rare_terms_and_short_fields(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog and the cat and more words"), (3, "the the the"), (4, None), (5, "")], "doc_id bigint, text string")
    terms = index.query_terms(spark.createDataFrame([(1, "CAT the"), (2, "zebra"), (3, None)], "q bigint, text string"), "q", F.col("text"))
    got = index.bm25(index.build(docs, "doc_id", {"text": F.col("text")}), {"text": 1.0}, terms).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    strict = index.bm25(index.build(docs, "doc_id", {"text": F.col("text")}), {"text": 1.0}, terms, all_then_any=True).collect()
    assert {r.doc_id for r in strict} == {1, 2}
    assert index.bm25(index.build(docs.limit(0), "doc_id", {"text": F.col("text")}), {"text": 1.0}, terms).count() == 0


def test_phrases_and_wildcards(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b a"), (3, None)], "doc_id bigint, text string")
    phrases = spark.createDataFrame([("ab", "A b"), ("aba", "a b a"), ("none", "")], "phrase_id string, phrase string")
    assert sorted(map(tuple, index.phrase_matches(docs, "doc_id", F.col("text"), phrases).collect())) == [("ab", 1, 2), ("aba", 1, 1)]
    posted = index.build(spark.createDataFrame([(1, "cart cut coat")], "doc_id bigint, text string"), "doc_id", {"text": F.col("text")}).postings()
    assert sorted(r.term for r in index.wildcard_terms(posted, spark.createDataFrame([("c?t",), ("c*rt",)], "pattern string")).collect()) == ["cart", "cut"]


def test_grep_and_fusion(spark):
    docs = spark.createDataFrame([(1, "one\r\nTWO\nthree"), (2, None), (3, "two two\ntwo")], "doc_id bigint, text string")
    got = sorted(map(tuple, grep.grep_lines(docs, "doc_id", F.col("text"), "two", context=1).collect()))
    assert got == [(1, 2, "TWO", "one", "three"), (3, 1, "two two", "", "two"), (3, 2, "two", "two two", "")]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "key string, rank int")
    fused = {r["key"]: r.rrf_score for r in fusion.reciprocal_rank_fusion([(a, 1.0), (a.where("key = 'y'"), 0.5)], [], "key").collect()}
    assert fused == {"x": pytest.approx(1 / 61, abs=1e-8), "y": pytest.approx(1.5 / 62, abs=1e-8)}
    scaled = fusion.min_max(spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, s double"), ["g"], "s")
    assert sorted((r.g, r.normalized) for r in scaled.collect()) == [("g", 0.0), ("g", 1.0), ("h", 1.0)]


@pytest.mark.parametrize("n", [1, 2, 10, 11])
def test_picks(spark, n):
    values = [float(k) for k in range(n)] + [None, float("nan")]
    got = ranks.picks(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], F.col("v"), {"p50": 0.5, "p90": 0.9}).first()
    assert (got.n, got.p50, got.p90, got["max"]) == (n, float(n // 2), float(int(0.9 * n)), float(n - 1))


def test_snapshots(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", ""), ("n", None)], "path string, hash string")
    comp = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("f", ""), ("n", None)], "path string, hash string")
    got = sorted(map(tuple, snapshots.diff(base, comp).collect()))
    assert got == [("a", "unchanged", None), ("b", "changed", None), ("c", "deleted", None), ("d", "moved", "c"), ("e", "deleted", None), ("f", "added", None), ("n", "unchanged", None)]
    merged = snapshots.merge(base, comp.withColumn("gone", F.col("path") == "b"), ["path"], "gone")
    assert sorted(r.path for r in merged.collect()) == ["a", "c", "d", "e", "f", "n"]
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 5, "z")], "key string, v int, w string")
    assert sorted((str(r.key), r.w) for r in snapshots.latest(rows, ["key"], F.col("v")).collect()) == [("None", "z"), ("k", "y")]


def test_chunks_keep_every_line():
    text = "intro\n" + "\n".join(f"## Part {k}\n" + "\n\n".join(f"paragraph {k} {j} " + "w " * 40 for j in range(6)) for k in range(5)) + "\n" + "z" * 900
    got = chunks.split_text(text, 400, 50)
    assert all(len(b) <= 400 for _, b in got) and "".join("".join(b.split()) for _, b in got) == "".join(text.split()) and {t for t, _ in got} >= {f"Part {k}" for k in range(5)}
    assert chunks.split_text(None) == chunks.split_text(" \n") == [] and chunks.split_text("x") == [("", "x")]


def test_even_tables():
    table = "| a | b |\n|---|---|\n| 1 |\n```\n| x |\n|-|\n```\n| lone |"
    assert chunks.even_tables(table) == "| a | b |\n| --- | --- |\n|  | 1 |\n```\n| x |\n|-|\n```\n| lone |"
    assert chunks.even_tables(None) is None and chunks.even_tables("none") == "none"


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# A\nx", encoding="utf-8")
    (root / "sub" / "b.txt").write_bytes("年假".encode("gbk"))
    (root / "a.md.json").write_text('{"id": "i1", "title": "A", "tags": ["t"]}')
    (root / "q.jsonl").write_text('# note\n\n{"query": "x", "expected_files": ["a"]}\n')
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("in.txt", "hello")
        z.writestr("../out.txt", "evil")
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w:gz") as t:
            info = tarfile.TarInfo("deep.txt")
            info.size = 2
            t.addfile(info, io.BytesIO(b"ok"))
        z.writestr("x.tar.gz", inner.getvalue())
    (root / "z.zip").write_bytes(box.getvalue())
    snap = {r.path: r.hash for r in files.snapshot(spark, str(root)).collect()}
    assert set(snap) == {"a.md", "sub/b.txt", "a.md.json", "q.jsonl", "z.zip"} and all(len(h) == 64 for h in snap.values())
    assert all(r.hash.startswith("mtime:") for r in files.snapshot(spark, str(root), large=1).collect())
    assert {r.path: r.text for r in files.read_texts(spark, str(root)).collect()} == {"a.md": "# A\nx", "sub/b.txt": "# b\n\n年假"}
    assert [(r.query, r.expected_files) for r in files.read_query_set(spark, str(root / "q.jsonl")).collect()] == [("x", ["a"])]
    assert [(r.id, r.tags) for r in files.read_sidecars(spark, str(root)).collect()] == [("i1", ["t"])]
    zipped = spark.createDataFrame([("z.zip", bytearray(box.getvalue())), ("bad.zip", bytearray(b"PK nothing"))], "path string, content binary")
    got = {(r.path, r.content and bytes(r.content), r.error) for r in files.unpack(zipped).collect()}
    assert got == {("z.zip/in.txt", b"hello", None), ("z.zip/../out.txt", None, "unsafe path"), ("z.zip/x.tar.gz/deep.txt", b"ok", None), ("bad.zip", None, "unreadable: BadZipFile")}
    assert files.html_to_markdown("<h2>T</h2><p>a <b>b</b></p><ul><li>x</ul><table><tr><th>h<th>i</tr><tr><td>1<td>2</tr></table><script>s</script>") .startswith("## T\n\na **b**\n")


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert sinks.current_version(spark, folder) is None
    df = spark.createDataFrame([(1,)], "a int")
    assert sinks.write_version(df, folder) == 1 and sinks.write_version(df.union(df), folder) == 2
    assert sinks.read_version(spark, folder).count() == 2 and sinks.read_version(spark, folder, 1).count() == 1
    paths = sinks.output_paths(spark.createDataFrame([("x/a.pdf",), ("x/A.docx",), ("x/b.md",)], "p string"), "p")
    assert sorted(r.output_path for r in paths.collect()) == ["x/A.md", "x/a_1.md", "x/b.md"]


def test_index_kept_from_a_stream_equals_one_built_anew(spark, tmp_path):
    rows = [[(1, "a b", False, 1), (2, "c", False, 2)], [(1, "b b", False, 3), (3, "d e", False, 4), (3, "e", False, 5)], [(2, None, True, 6), (4, None, False, 7)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "doc_id bigint, text string, gone boolean, seq bigint").coalesce(1).write.parquet(str(tmp_path / "c" / f"{k}.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(3):
        part = next((tmp_path / "c" / f"{k}.parquet").glob("part*"))
        os.link(part, flat / f"{k}.parquet")
        os.utime(flat / f"{k}.parquet", (1000 + k, 1000 + k))
    jobs.keep_index(jobs.stream_table(spark, str(flat), 1), str(tmp_path / "index"), "doc_id", "text", "gone")
    got = sorted(map(tuple, jobs.kept_postings(spark, str(tmp_path / "index")).select("doc_id", "term", "tf").collect()))
    assert got == [(1, "b", 2), (3, "e", 1)]


def test_conditions(spark):
    df = spark.createDataFrame([(1, "Policy A", "10", None), (2, "manual", "x", ""), (3, None, "7.5", "note")], "id int, title string, size string, extra string")
    fields = {c: F.col(c) for c in df.columns}

    def ids(listed, joined="and"):
        return [r.id for r in df.where(conditions(fields, listed, joined)).orderBy("id").collect()]

    assert ids([]) == [1, 2, 3] and ids([("title", "contains", "POLICY")]) == [1] and ids([("title", "is not", "manual")]) == [1, 3]
    assert ids([("size", ">", 7), ("extra", "empty", None)]) == [1] and ids([("size", "<", "8")]) == [3] and ids([("size", "=", "many")]) == []
    assert ids([("title", "in", "manual, other"), ("extra", "not empty", None)], "or") == [2, 3] and ids([("none", "is", "x")]) == []
    with pytest.raises(ValueError):
        conditions(fields, [("title", "resembles", "x")])


def test_masks_come_off_again(spark):
    texts = ["id 11010519491231002X, card 6222021234567890123, call 13912345678 or a@b.example from 10.0.0.1", "a long secret and a secret", "", None]
    for t in texts:
        hidden, mapping = masking.mask_text(t, words=("secret", "long secret"))
        assert masking.unmask_text(hidden, mapping) == t
    assert masking.mask_text(texts[0])[0] == "id [ID_CARD_1], card [BANK_CARD_2], call [PHONE_3] or [EMAIL_4] from [IP_5]"
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", masking.masked(F.col("t"), words=("secret", "long secret")))
    assert [r[0] for r in df.select(masking.unmasked(F.col("m.text"), F.col("m.mapping"))).collect()] == texts


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return int(v) if isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=key)
    b = sorted((tuple(_norm(r[p]) for p in places) for r in want.fetchall()), key=key)
    assert a == b


def test_every_query_is_registered_with_the_driver():
    assert set(registry.QUERIES) <= set(entry_points.queries()) and set(registry.ORACLE) <= set(entry_points.oracle_sql()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_picks_of_all_kinds_of_values(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, -0.0, 1.5, -1.5, rng.lognormvariate(0, 9), -rng.lognormvariate(0, 9), 5e-324, 1.7e308, float("inf"), float("-inf")])) for g in ("a", "b", None) for _ in range(300)]
    got = {r.g: r for r in ranks.picks(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), {"low": 0.1, "mid": 0.5, "high": 0.99}).collect()}
    for g in ("a", "b", None):
        own = sorted(v for k, v in rows if k == g)
        assert (got[g].low, got[g].mid, got[g].high, got[g].n) == (own[30], own[150], own[297], 300), g
    assert ranks.picks(spark.createDataFrame([], "g string, v double"), ["g"], F.col("v"), {"p50": 0.5}).count() == 0 and math.isinf(got["a"]["max"])


def test_long_terms_are_indexed_and_a_kept_index_ranks_alike(spark, tmp_path):
    long = "x" * 60
    docs = spark.createDataFrame([(1, f"{long} cat"), (2, "cat cat dog"), (3, None), (4, "")], "doc_id bigint, text string")
    made = index.build(docs, "doc_id", {"text": F.col("text")})
    index.save(made, str(tmp_path / "ix"))
    kept = index.load(spark, str(tmp_path / "ix"))
    terms = index.query_terms(spark.createDataFrame([(1, f"{long} dog"), (2, "cat")], "q bigint, text string"), "q", F.col("text"))
    a, b = (sorted(map(tuple, index.bm25(i, {"text": 1.0}, terms).collect())) for i in (made, kept))
    assert a == b and {r[2] for r in a if r[0] == 1} == {1, 2}
    assert kept.statistics().first().documents == 4


def test_questions_are_recalled_by_what_they_hold(spark):
    known = spark.createDataFrame([(k, q) for k, q in enumerate(["who pays the bill", "so who pays the bill for the ward", "who pays", "whose turn", "年假有几天", "请问年假"])], "id bigint, q string")
    asked = spark.createDataFrame([(1, "who pays"), (2, "年假多久"), (3, ""), (4, "x")], "a bigint, t string")
    got = {(r.a, r.id): r["class"] for r in recall.recalled(asked, known, "a", "t", "q", "id", (20, 4, 2), 10).collect()}
    assert got == {(1, 2): 1, (1, 0): 2, (1, 1): 2, (1, 3): 4, (2, 4): 4, (2, 5): 4}


def test_bursts_of_alerts_are_thinned(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s)) for s in (0, 299, 300, 301, 599, 600, 1000, 1000)] + [(None, start), ("b", None), ("b", start)]
    df = spark.createDataFrame(rows, "c string, t timestamp")
    got = sorted((r.category, r.at // 1_000_000 - int(start.replace(tzinfo=dt.timezone.utc).timestamp())) for r in jobs.rate_limited(df, "t", "c").collect())
    assert got == [("a", 0), ("a", 300), ("a", 600), ("a", 1000), ("b", 0)]


def test_masks_for_good(spark):
    got = _column(spark, ["id 11010519491231002X, card 6222021234567890123, call 13912345678 or a@b.example from 10.0.0.1", "no 139123456789 and 1.2.3.4.5", "", None], masking.mask_only)
    assert got == ["id [ID_CARD], card [BANK_CARD], call [PHONE] or [EMAIL] from [IP]", "no 139123456789 and 1.2.3.4.5", "", None]


def test_queries_are_taken_apart(spark):
    got = _column(spark, ['"waiting period" title:leave of reimburs* the leave', "don't say 'sick leave' http://x.y", "年假 有 几天?", "", None, "the of"], queries.parts)
    first, second = got[0], got[1]
    assert first.phrases == ["waiting period"] and [tuple(f) for f in first.fields] == [("title", "leave")] and first.wildcard and first.terms == ["reimburs", "leave"]
    assert second.phrases == ["t say "] and [f.field for f in second.fields] == ["http"]
    assert got[2].terms == ["年假", "有", "几天"] and got[2].wildcard and got[3].terms == got[4].terms == got[5].terms == []


def test_lines_are_counted_once_for_each_query(spark):
    docs = spark.createDataFrame([(1, "cat dog\ndog\nbird"), (2, None), (3, "bird")], "doc_id bigint, text string")
    terms = spark.createDataFrame([(1, "cat"), (1, "dog"), (2, "bird")], "query_id int, term string")
    assert sorted(map(tuple, grep.count_lines(docs, "doc_id", F.col("text"), terms).collect())) == [(1, 1, 2), (2, 1, 1), (2, 3, 1)]
