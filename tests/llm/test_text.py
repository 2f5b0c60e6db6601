"""Operators on free text: cases by hand, odd values, and the same results whichever way a table is cut."""

import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.llm import ocr_repair, pairs, pii, toxicity

MENTIONS = [
    ("write to edwin.lund@clinic.example.com or ring 07700 900590.", {"email", "phone"}),
    ("Copy to gfeld[at]inbox[dot]test, please.", {"email"}),
    ("Contact: Peter Eskovar, +1 617 555 0158, clara (at) mail.example.", {"email", "phone", "name"}),
    ("Mention @claims-desk in the ticket. Total: 665 @ 4.50 each.", set()),
    ("请在下班后拨打１８６００００７６３６。", {"phone"}),
    ("Rückruf bitte unter 030/23125363.", {"phone"}),
    ("Merci de rappeler le 06.39.98.85.31.", {"phone"}),
    ("Ledger entry 209732984273590486. Claim reference CLM7785416. Effective 2021-04-11. Form KV-2019-21172.", set()),
    ("My identity number is QQ 35 90 24 D.", {"id_number"}),
    ("Signed by Ruth Kastrovic (974-81-6808).", {"id_number", "name"}),
    ("我的身份证号是991247 19710908 5641。流水号268441944342893266。", {"id_number"}),
    ("Identität geprüft: Personalausweis T22656695.", {"id_number"}),
    ("Send the papers to 232 Foxglove Road.", {"address"}),
    ("Room 8, Building 6 is closed. See Section 14. 见附件表3第22行。", set()),
    ("材料请寄到望溪市南桥区柳浦巷229号7栋1403室。", {"address"}),
    ("Unterlagen an Rosengartenallee 6, 00330 Kirchwelden senden.", {"address"}),
    ("Le demandeur Oscar Wexcombe habite au 101 bis, rue des Alouettes, 00343 Pontclair.", {"address", "name"}),
    ("申请人李峤棠现住望溪市青禾区松影路363号13楼。", {"address", "name"}),
    ("请联系值班医生或服务台。先生或女士均适用本条款。Dear Sir or Madam.", set()),
    ("上周徐澜珩也问过同样的问题。", {"name"}),
    ("Mrs Yarlsberg and Wexcombe, Tobias can be reached.", {"name"}),
    ("The Harbour Care Basic brochure was updated by Tamarisk Clinics; the project lead agrees.", set()),
    ("The insured\nmoved to 525 Seven\nElms Avenue, new mobile\n+44 (0)7700 900920.", {"address", "phone"}),
]


@pytest.mark.parametrize("text,kinds", MENTIONS)
def test_mentions(text, kinds):
    found = pii.find_mentions(text)
    assert {k for *_, k in found} == kinds
    assert all(0 <= a < b <= len(text) for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    masked = pii.mask(text)
    assert all(pii.PLACEHOLDER[k] in masked for k in kinds) and (kinds or masked == text)


def test_masking_of_odd_values(spark):
    long = "nothing here. " * 20000 + "Signed by Ruth Kastrovic (974-81-6808)."
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, long, "z"), (3, long, "z")], "id bigint, query string, kind string")
    out = pii.redact(df, "query").orderBy("id").collect()
    assert [r["query"] for r in out[:2]] == [None, ""] and out[2]["query"].endswith("Signed by [NAME] ([ID_NUMBER]).") and len(out) == 4
    assert pii.redact(df.limit(0), "query").count() == 0


Q = "How do I apply for dental treatment?"
DEFECTS = [
    (Q, None, "empty"), (Q, "​", "empty"), (Q, "**", "empty"), (Q, "（无）", "empty"), (Q, "N/A", "empty"), (Q, "Yes.", None), (None, "Yes.", None), ("", "Section 4.", None),
    (Q, Q.upper(), "copy"), (Q, f"Q: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"), ("如何申请年假?", "您的问题是：如何申请年假?", "copy"), (Q, "Dental treatment is covered in full.", None),
    (Q, "Thank you for asking; however, I can't help with that request. Try the search page instead.", "refusal"), (Q, "I could not find a separate rule in the handbook, but the tariff is clear: Claims cannot be accepted later than May.", None),
    ("年假有几天?", "很遗憾，知识库中没有关于年假的内容。", "refusal"), ("年假有几天?", "保险人有权拒绝年假的申请。", None), ("Wer genehmigt Probezeit?", "Leider liegen mir zu Probezeit keine Informationen vor.", "refusal"),
    (Q, "The insurer pays. Claims under the plan cannot be acc", "truncated"), (Q, "The following papers are required:\n\n- ", "truncated"), (Q, "It is limited.\n\n| item | limit |\n|---|---|\n| x | 3 |", None), (Q, "It is limited.\n\n| item | limit |\n|---|---|\n| x |", "truncated"),
    (Q, 'Yes.\n\n```json\n{"limit": 90, "unit": "day', "truncated"), (Q, "Yes.\n\n```json\n{}\n```", None), (Q, "The form applies from May.\n\n[source: hr/manual_009.md]", None), (Q, "See the list.\n1. one is covered\n2.", "truncated"),
    (Q, "Das Formular ersetzt die frühere Fassung und gilt ab dem Unfall.", "language"), (f"{Q} Bitte auf Deutsch antworten.", "Das Formular ersetzt die frühere Fassung und gilt ab dem Unfall.", None),
    (Q, "The form applies.\n\n> 表格替代旧版本，自保单周年日起适用。\n\nThe rest follows.", None), ("年假有几天?", "The officer must review the exclusion list within 8 days.", "language"), ("waiting period deadline", "若反复头痛持续超过39天，建议口服补液。", "language"),
]


def test_defects(spark):
    df = spark.createDataFrame([(k, q, a) for k, (q, a, _) in enumerate(DEFECTS)], "id bigint, query string, answer string").withColumn("defect", F.lit("x"))
    got = {r.id: r.defect for r in pairs.find_defects(df, F.col("id"), F.col("query"), F.col("answer")).collect()}
    assert {k: (a, got.get(k)) for k, (_, a, d) in enumerate(DEFECTS) if got.get(k) != d} == {}
    assert pairs.find_defects(df.limit(0), F.col("id"), F.col("query"), F.col("answer")).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_shortened_list_items_are_found_beside_their_whole_forms(spark, partitions):
    whole = [f"The {w} must record the blood pressure within {k} days of the accident." for k, w in enumerate(["clerk", "nurse", "broker", "adjuster"] * 5)]
    tails = ["The nurse must record the blood pre", "The broker must record the blood pressure within 7 days of the accident", "Nobody says this"]
    complete = spark.createDataFrame([(pairs.segment_form(t),) for t in whole], "segment string")
    asked = spark.createDataFrame([(pairs.segment_form(t),) for t in tails], "segment string")
    got = {r.segment for r in pairs.shortened_tails(asked, complete, partitions).collect()}
    assert got == {"The nurse must record the blood pre"}


def test_limits_of_length(spark):
    rows = [(k, 30) for k in range(50)] + [(k, 100 + k) for k in range(60)] + [(k, 7) for k in range(19)]
    df = spark.createDataFrame(rows, "id bigint, length int")
    assert [r.length for r in pairs.length_limits(df).collect()] == [30]


def test_most_shortened_answers_are_told_by_their_neighbours(spark):
    """Of the answers at scale 0.1 that are found shortened, neighbours and limits alone tell more than half."""
    logs = spark.read.parquet("/root/testdata/sf0.1/search_logs.parquet")
    told = F.col("neighbour") | F.col("limit") | F.col("continued")
    views = pairs.view_pairs(logs, F.col("id"), F.col("query"), F.col("answer")).where(F.col("defect").isNull() & (told | F.col("cut")))
    n, by_others, only = views.agg(F.count(F.lit(1)), F.sum(told.cast("int")), F.sum((told & ~F.col("cut")).cast("int"))).first()
    print(f"{n} shortened answers, {by_others} told by others, {only} by others alone")
    assert by_others > n / 2


def test_a_shortened_answer_without_open_marks_is_told_by_its_neighbour(spark):
    item = "The clerk must attach the discharge summary within {} days of the accident"
    rows = [(k, "Which papers?", f"See:\n\n- {item.format(k)}\n- the claim form for the ward\n\nThe rest follows.") for k in range(5)]
    rows += [(10, "Which papers?", "See:\n\n- a copy of the form\n- The clerk must attach the discharge"), (11, "Which papers?", "See:\n\n- the claim form for the ward"), (12, None, None), (13, "", " ")]
    df = spark.createDataFrame(rows, "id bigint, query string, answer string")
    got = {r.id: r for r in pairs.view_pairs(df, F.col("id"), F.col("query"), F.col("answer")).collect()}
    assert got[10].neighbour and not got[10].cut and 11 not in got and not got[12].neighbour
    assert {r.id: r.defect for r in pairs.find_defects(df, F.col("id"), F.col("query"), F.col("answer")).collect()} == {10: "truncated", 12: "empty", 13: "empty"}


def _pages():
    body = "The insured person must record the blood pressure within two days of the accident, and the clerk receives a copy."
    rows, n = [], 0
    for file in (1, 2):
        for page in range(1, 7):
            n += 1
            head = [] if page == 1 else [("Ward Manual 2016" if page != 3 else "Ward Manua1 2016") + ("" if file == 1 else f"    {page}")]
            text = [*head, "The insurer may refuse the blood pressure record if the", "insured person fails to attach the dis-", "charge summary. " + body, "For the co-", "insurance share see the blood pressure record.", f"- {page} -"]
            rows.append((n, file, page, 1, "\r\n".join(text) if page % 2 else "\n".join(text)))
    for k in range(20):
        rows.append((100 + k, None, None, None, f"Do not delay the discharge summary. {body} A co-insurance share applies."))
    rows += [(200, 9, 1, 1, "The c1erk and the rnanager delay the disch¬\narge summary of the insured person, and the blood press+re rises."), (201, 9, 2, 1, None), (202, 9, 2, 1, " \n"), (203, 9, 3, 1, "表格KV-\n2019 用完为 限。\n第 3 页")]
    rows.append((204, 9, 1, 1, "The manager and the clerk delay it. " * 25))
    return rows


def test_noise_of_scanned_pages(spark):
    df = spark.createDataFrame(_pages(), "result_id bigint, file_id bigint, page_no int, pages int, text string").withColumn("item", F.lit("clash"))
    repair = ocr_repair.repair_pages(df)
    got = {(r.result_id, r.kind, r.item) for r in repair.noise().collect()}
    for n in range(1, 13):
        file, page = (n - 1) // 6 + 1, (n - 1) % 6 + 1
        assert (n, "hyphen", "discharge") in got and (n, "hyphen", "co-insurance") in got and (n, "page_number", f"- {page} -") in got
        heads = {i for r, k, i in got if r == n and k == "header"}
        assert heads == (set() if page == 1 else {("Ward Manual 2016" if page != 3 else "Ward Manua1 2016") + ("" if file == 1 else f"    {page}")})
    assert {(k, i) for r, k, i in got if r == 200} == {("misread", "clerk"), ("misread", "manager"), ("hyphen", "discharge")}
    assert {(k, i) for r, k, i in got if r == 203} == {("page_number", "第 3 页")}
    texts = {r.result_id: r.repaired for r in repair.paragraphs().collect()}
    assert "fails to attach the discharge summary." in texts[2] and "Ward" not in texts[2] and "- 2 -" not in texts[2] and 201 not in texts
    assert texts[200].startswith("The clerk and the manager delay the discharge summary") and texts[203] == "表格KV-2019用完为限。"


class _Watched:
    """A pattern that counts the characters it is asked about."""

    def __init__(self, pattern):
        self.pattern, self.asked = pattern, 0

    def findall(self, text):
        self.asked += len(text)
        return self.pattern.findall(text)

    def finditer(self, text):
        self.asked += len(text)
        return self.pattern.finditer(text)


def test_each_stretch_of_pages_is_taken_apart_once(monkeypatch):
    page = "The c1erk  (and\tthe claims-desk) pays 1,200.50 at 9|10.\nIm Jahr 2019 stieg·der Preis der Kran-\nkenhaus€ und A/B x@y.z, l'heure d'été.\n付31,000元 在合同 Plan B内+ rn a a a"
    texts, copies = [page[k:] + page[:k] for k in range(0, len(page), 7)], 60
    frame = pd.DataFrame({"result_id": range(len(texts) * copies), "text": texts * copies, "drop": [[]] * len(texts) * copies, "heads": [[]] * len(texts) * copies})
    # The counts are those of the patterns over whole texts ...
    expected = Counter()
    for text in texts:
        lines = [x.strip() for x in re.split("[\r\n]", text) if x.strip()]
        words = Counter(ocr_repair.TOKEN.findall("\n".join(lines)))
        for a, b, soft in ocr_repair._broken(list(enumerate(lines))):
            words.subtract([a, b])
            expected["soft" if soft else "hard", a, b, False] += 1
        for word, n in words.items():
            if n > 0 and ocr_repair.WORD_LIKE.match(word.lower()):
                expected["word", word.lower(), None, word[0].isupper()] += n
        for a, _, b in ocr_repair.PAIR.findall("\n".join(lines)):
            expected["pair", a.lower(), b.lower(), b[0].isupper()] += 1
    watched = _Watched(ocr_repair.TOKEN)
    monkeypatch.setattr(ocr_repair, "TOKEN", watched)
    got = Counter()
    for out in ocr_repair._emit_pieces(iter([frame[:100], frame[100:]])):
        for row in out.itertuples(index=False):
            got[row.sort, row.a, row.b, row.cased] += row.n
    assert got == {k: n * copies for k, n in expected.items()}
    # ... and the work, as that for the windows, doesn't grow with the copies.
    once = sum(map(len, texts))
    assert watched.asked <= once
    watched.asked = 0
    bits = bytearray(ocr_repair.FILTER_BITS // 8)
    at = zlib.crc32(b"c1erk") % ocr_repair.FILTER_BITS
    bits[at >> 3] |= 1 << (at & 7)
    windows = pd.concat(ocr_repair._emit_windows(SimpleNamespace(value=bytes(bits)))(iter([frame])))
    assert (windows["surfaces"].map(lambda x: "c1erk" in x)).sum() == copies * sum("c1erk" in t for t in texts)
    assert watched.asked <= once


@pytest.mark.parametrize("line", ["页", "第 3 页", "共5", "of 12", "de 5", "xiv", "· 7 ·", "Seite 3 von 9", "- - -", "O1", "ſ. 4"])
def test_any_line_that_is_a_number_of_a_page_is_looked_at(line):
    frame = pd.DataFrame({"result_id": [1], "file_id": [1.0], "page_no": [1], "pages": [1], "text": [f"The clerk\x0c{line}\r\npays."]})
    rows = pd.concat(ocr_repair._emit_lines(iter([frame])))
    assert [(r.line_no, r.kind) for r in rows.itertuples() if r.kind != "line"] == [(1, ocr_repair._mere(line))] and ocr_repair._mere(line)


def test_no_pages(spark):
    df = spark.createDataFrame([], "result_id bigint, file_id bigint, page_no int, pages int, text string")
    repair = ocr_repair.repair_pages(df)
    assert repair.noise().count() == 0 and repair.paragraphs().count() == 0


def test_decoding_takes_the_cheapest_words():
    put = lambda form, readings, own=None: [f[:3] for f in ocr_repair.decode_window(form, {k: [(w, c, False, False) for w, c in v] for k, v in readings.items()}, own)]
    assert put("is theend", {"theend": [("the end", 3.0), ("tbe end", 4.0)]}, {"theend": 5.0}) == [(3, 9, "the end")]
    assert put("is theend", {"theend": [("the end", 6.0)]}, {"theend": 5.0}) == []
    assert put("zz", {}) == []
    # Of two merges over the same word the cheaper pair of readings counts, not the cheaper reading.
    both = {"in sur": [("insur", 2.0), ("in sur", 9.0)], "sur ance": [("surance", 3.0), ("sur ance", 9.0)]}
    assert put("in sur ance", both, {"in": 9.0, "sur": 9.0, "ance": 1.0}) == [(0, 6, "insur")]
    assert put("in sur ance", both, {"in": 1.0, "sur": 9.0, "ance": 9.0}) == [(3, 11, "surance")]
    # A mark of division is read somehow, whatever it costs, and a misread part belongs to the divided word.
    assert put("the treat-\nrnent is", {"treat-\nrnent": [("treatment", 30.0), ("treatrnent", 40.0)], "rnent": [("ment", 1.0)]}, {"rnent": 2.0}) == [(4, 16, "treatment")]


@pytest.mark.parametrize(("spelling", "word", "yes"), [
    ("c1erk", "clerk", True), ("c1erk", "cierk", True), ("11110111", "llllolll", True), ("rnanager", "manager", True), ("c1", "d", True), ("tbe", "the", True), ("tbc", "the", False), ("clerk", "clerk", False), ("m" * 70 + "rn", "m" * 71, True), ("i1l" * 30, "ill" * 30, True), ("a+", "at", True), ("ab", "a", False),
])
def test_what_may_have_been_misread_shares_a_key(spelling, word, yes):
    assert ocr_repair.explains(spelling, word) == yes
    if yes:
        assert set(ocr_repair.keys(spelling)) & set(ocr_repair.word_keys(word))


def test_keys_are_shared_by_all_that_explains():
    rng = random.Random(3)
    for _ in range(3000):
        word = "".join(rng.choice("abcdehilmnrtuvw") for _ in range(rng.choice([3, 5, 9, 63, 64, 65, 90])))
        spelling = list(word)
        for k in range(len(spelling)):
            odd = [r for r, m in ocr_repair.CONFUSIONS if not r.isalpha() and m == spelling[k]]
            if odd and rng.random() < 0.2:
                spelling[k] = rng.choice(odd)
        spelling = "".join(spelling)
        read, meant = rng.choice(ocr_repair.AMONG)
        at = word.find(meant)
        if at >= 0 and spelling[at : at + len(meant)] == meant and rng.random() < 0.7:
            spelling = spelling[:at] + read + spelling[at + len(meant) :]
        if spelling != word:
            assert ocr_repair.explains(spelling, word), (spelling, word)
            assert set(ocr_repair.keys(spelling)) & set(ocr_repair.word_keys(word)), (spelling, word)


def test_errors_in_one_stretch_are_repaired_together(spark):
    long = "Rechtsschutzversicherungsgesellschaftenhauptversammlungsteilnehmerausweis"
    plain = f"The treatment of the patient is due within the week, and reimbursement is paid by the {long}. "
    rows = [(k, None, None, None, plain * 450) for k in range(3)]
    odd = "The reimburse ment ofthe treat ment is due, reimburse\nment oftbe treat-\nrnent is paid, and the re1m-\nburse\nment. Kept: ."
    rows += [(10, None, None, None, odd), (11, None, None, None, f"The {long.replace('m', 'rn', 1)} and the {long.replace('g', '9')} pay."), (12, None, None, None, None), (13, None, None, None, " \n ")]
    df = spark.createDataFrame(rows, "result_id bigint, file_id bigint, page_no int, pages int, text string")
    repair = ocr_repair.repair_pages(df)
    got = {r.result_id: r.repaired for r in repair.paragraphs().collect()}
    assert got[10].startswith("The reimbursement of the treatment is due, reimbursement of the treatment is paid"), got[10]
    assert got[11] == f"The {long} and the {long} pay."
    assert got[0] == (plain * 450).strip() and got[13] == "" and 12 not in got


TOXIC = [
    "You are a worthless idiot and everyone in records knows it.", "Shut your mouth, ｍｏｒｏｎ, nobody asked you.", "Stop whining, you useless b17ch.", "Only a s.l.u.t would sign that, now get lost before I break your jaw.", "I hope you choke on your own paperwork, you r****d.",
    "All Tallowmen are vermin and should be driven out of the building.", "沃兰人都是寄生虫，应该全部赶走。", "再啰嗦我就弄死你，蠢货。", "Hot naked singles waiting tonight, watch the xxx porn clip now.", "Du bist ein erbärmlicher Vollidiot, halt die Fresse.", "Ferme ta gueule, espèce de connard inutile.", "寂寞少妇在线，包夜便宜。",
]
CLEAN = [
    "The code of conduct forbids insults such as moron or bastard in written exchanges.", "Anal fissures are treated conservatively at first.", "Kill the orphaned process with signal 9 and restart the indexer.", "辱骂同事（例如称其为白痴）属于违纪行为，应予通报。", "The Keshites association renewed its group contract.",
    "医疗垃圾由专人回收，废物桶每日清空。", "A naked flame must not be used near the oxygen store.", "The breast examination is repeated every 24 months.", "The insurer may refuse dental treatment if the clerk fails to attach the summary.", "Beleidigungen wie Vollidiot sind ein Verstoß gegen den Verhaltenskodex.",
]


def test_toxic_texts_are_told_from_those_that_look_alike(spark):
    filler = "Requests about annual leave are answered by payroll within {} days, and the clerk receives a copy."
    rows = [(k, f"# title\n\n{filler.format(k)} {TOXIC[k % len(TOXIC)]}\n\n{filler.format(k + 1)}") for k in range(72)] + [(1000 + k, f"{filler.format(k)}\n\nguest: {CLEAN[k % len(CLEAN)]} {filler.format(k)}") for k in range(200)]
    rows += [(5000, None), (5001, ""), (5002, "x" * 50000 + " " + TOXIC[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("source", F.when(F.col("doc_id") < 1000, "a"))
    model = toxicity.fit(df, F.col("text"))
    scored = toxicity.score_documents(df, F.col("doc_id"), F.col("text"), model)
    score = {r.doc_id: r.score for r in scored.collect()}
    assert {k: v for k, v in score.items() if k < 1000 and v < toxicity.THRESHOLD} == {}
    assert {k: v for k, v in score.items() if 1000 <= k < 5000 and v >= toxicity.THRESHOLD} == {}
    assert score[5000] == score[5001] == 0 and score[5002] >= toxicity.THRESHOLD and len(score) == len(rows)
    rates = {r.source: (r.documents, r.toxic) for r in toxicity.source_rates(df.select("doc_id", "source").join(scored, "doc_id"), "source").collect()}
    assert rates == {"a": (72, 72), None: (203, 1)}


def test_fit_on_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    model = toxicity.fit(empty, F.col("text"))
    assert toxicity.score_documents(empty, F.col("doc_id"), F.col("text"), model).count() == 0


def test_excuses_are_told_from_accusations_by_the_counts_alone():
    bit = toxicity.BIT
    patterns = {("insult", "address"): 50, ("threat", "wish"): 30, ("hate",): 20, ("insult", "quoting"): 60, ("sexual_word", "technical"): 40, ("insult_de_fr", "quoting"): 20, (): 5000}
    bits = np.array([sum(bit[v] for v in p) for p in patterns], dtype=np.int64)
    share = dict(zip(patterns, toxicity.fit_label_model(bits, np.array(list(patterns.values()), dtype=float)).posterior(bits), strict=True))
    assert {p: round(float(x), 3) for p, x in share.items() if (x > 0.5) != (p != () and not set(p) & set(toxicity.NEGATIVE))} == {}
    assert 0 < share[()] < 0.01
    # An excuse in a sentence that several voters accuse doesn't clear it.
    both = np.array([sum(bit[v] for v in ("insult", "address", "threat", "wish", "technical"))])
    assert toxicity.fit_label_model(bits, np.array(list(patterns.values()), dtype=float)).posterior(both)[0] > 0.5


def test_votes_of_a_table_of_any_size_are_judged_alike():
    bit = toxicity.BIT
    patterns = {
        ("insult", "address"): 1700, ("address",): 300, ("wish", "threat"): 200, ("hate",): 900, ("sexual_word", "sexual"): 400, ("sexual",): 100, ("insult_zh",): 72, ("address_other",): 53, ("insult_de_fr", "address_other"): 161, ("insult_zh", "address_other"): 282, ("insult_zh", "threat_other"): 71,
        ("insult_zh", "address_other", "threat_other"): 145, ("hate_other",): 256, ("insult_de_fr", "hate_other"): 109, ("insult_zh", "hate_other"): 55, ("sexual_word_other", "sexual_other"): 240, ("insult", "quoting"): 228, ("insult_zh", "quoting"): 203, ("sexual_word", "clinical"): 204,
        ("insult_zh", "technical"): 199, ("sexual_word", "technical"): 204, ("hate_other", "business"): 1, ("insult_zh", "address_other", "business"): 1, (): 900000,
    }
    bits, n = np.array([sum(bit[v] for v in p) for p in patterns], dtype=np.int64), np.array(list(patterns.values()), dtype=float)
    one, many = (toxicity.fit_label_model(bits, n * k).posterior(bits) for k in (1, 1000))
    assert np.abs(one - many).max() < 1e-3
    assert {p: round(float(x), 3) for p, x in zip(patterns, many, strict=True) if p and (x > 0.5) != (not {"quoting", "clinical", "technical"} & set(p))} == {}


def test_accused_sentences_that_repeat_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_VOTED", 40)
    rows = [(k, TOXIC[k % len(TOXIC)]) for k in range(4000)] + [(5000 + k, f"Request {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]} about your annual leave is answered by payroll.") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    scored = toxicity.score_documents(df, F.col("doc_id"), F.col("text"), toxicity.fit(df, F.col("text")))
    got = {r.doc_id for r in scored.where(F.col("score") >= toxicity.THRESHOLD).collect()}
    assert {TOXIC[k % len(TOXIC)] for k in range(4000) if k not in got} == set() and got == set(range(4000))


def test_an_excuse_counts_in_its_own_sentence_only():
    aside = sum(toxicity.BIT[v] for v in ("clinical", "technical", "business"))
    for text in ("如何申请康复治疗?member: 谁雇外人谁就是往家里放老鼠。", "差旅报销有几天?你就是个废物，滚出去。", "差旅报销的条款guest: 你就是个废物，滚出去。", "therapy deadline?guest: You disgust me, crawl back into your hole."):
        assert len(toxicity.sentences(text)) == 2 and toxicity.vote(toxicity.sentences(text)[1])[0] & ~aside, text
        assert not toxicity.vote(toxicity.sentences(text)[1])[0] & aside, text
    for text in ("who approves premium refund Nobody would miss you if you jumped off the roof.", "therapy deadline Only a moron would sign that."):
        assert toxicity.vote(text)[0] and not toxicity.vote(text)[0] & aside, text
    for text in ("The patient with Dick as a name is examined.", "The insurer says Nobody would miss you is forbidden by the code of conduct and the contract.", "患者体内寄生虫检查。", "Parasites of patients are treated."):
        assert toxicity.vote(text)[0] & sum(toxicity.BIT[v] for v in toxicity.NEGATIVE), text
    assert toxicity.vote("患者体内寄生虫检查。")[0] == toxicity.BIT["insult_zh"] | toxicity.BIT["clinical"]


def test_letters_kept_apart_end_where_the_next_word_begins():
    assert toxicity.plain("You are a worthless s l u t and all know it.")[1] == "you are a worthless slut and all know it."
    assert toxicity.plain("You are a s l u t s")[1] == "you are a sluts" and toxicity.plain("an a s s h o l e")[1] == "an asshole"
    assert toxicity.vote("Such a s l u t and I know it.")[0] & toxicity.BIT["disguised"]


def test_the_classifier_knows_words_that_no_voter_knows():
    rows = [(f"you snarfblat, {w} is late", 0.99) for w in ("the claim", "my form", "our report", "the answer")] * 10 + [(f"{w} is late", 0.001) for w in ("the claim", "my form", "our report", "the answer")] * 30
    classifier = toxicity.Classifier(toxicity.fit_label_model(np.array([0]), np.array([100.0])), toxicity.train_linear(rows))
    assert toxicity.vote("What a snarfblat.")[0] == 0
    assert classifier.score("What a snarfblat.") > 2.5 * classifier.score("What a report.")


def test_words_run_together_and_torn_words_are_put_right(spark):
    plain = "The report of the insurance is due, and the clerk may be late with the claim. "
    rows = [(k, None, None, None, plain * 60) for k in range(3)]
    rows += [(10, None, None, None, "Cover ofthe house: the insur ance of\nthe house and the in\nsurance of a boat."), (11, None, None, None, "Insur ance pays; maybe the clerk has a due report."), (12, None, None, None, "Die Sache derClerk.")]
    df = spark.createDataFrame(rows, "result_id bigint, file_id bigint, page_no int, pages int, text string")
    got = {r.result_id: r.repaired for r in ocr_repair.repair_pages(df).paragraphs().collect()}
    assert got[10] == "Cover of the house: the insurance of the house and the insurance of a boat."
    assert got[11] == "Insurance pays; maybe the clerk has a due report."
    assert got[0] == (plain * 60).strip()


def _matching(parsed, rng):
    """A random text that the parsed pattern matches; conditions on what stands around are left out."""
    out = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "IN":
            kind, of = rng.choice(value)
            out.append("天" if str(value[0][0]) == "NEGATE" else chr(of) if str(kind) == "LITERAL" else chr(rng.randint(*of)) if str(kind) == "RANGE" else "k")
        elif name == "NOT_LITERAL":
            out.append("天")
        elif name == "BRANCH":
            out.append(_matching(rng.choice(value[1]), rng))
        elif name == "SUBPATTERN":
            out.append(_matching(value[3], rng))
        elif name == "MAX_REPEAT":
            low, high, inner = value
            out += [_matching(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 3)))]
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT", "ANY"), name
    return "".join(out)


@pytest.mark.parametrize("name", ["STRONG_RE:insult", "DE_RE:insult_de_fr", "FR_RE:insult_de_fr", "ADDRESS_EN:address", "WISH_EN:wish", "ADDRESS_OTHER:address_other", "THREAT_EN:threat", "THREAT_OTHER:threat_other", "HATE_EN:hate", "HATE_OTHER:hate_other", "SEX_RE:sexual_word", "SEX_DE_RE:sexual_word_other", "SEXUAL_PHRASE_EN:sexual", "SEXUAL_PHRASE_OTHER:sexual_other"])
def test_triggers_reject_nothing_that_accusing_patterns_match(name):
    pattern, voter, rng = getattr(toxicity, name.split(":")[0]), name.split(":")[1], random.Random(5)
    parsed, missed, matched = re._parser.parse(pattern.pattern), set(), 0
    for _ in range(8000):
        text = rng.choice(["{}", "Zz {} zz.", "zz-{}-zz", "'{}'", "_{}_", "\t{}"]).format(_matching(parsed, rng))
        if pattern.search(text):
            matched += 1
            if not toxicity.triggered(text) & toxicity.BIT[voter]:
                missed.add(text)
    assert matched > 4000 and sorted(missed)[:40] == []


def test_short_words_after_marks_and_shortened_verbs_are_voted_on():
    for text in ("We'll find them.", "I'll hurt her.", "I’ll destroy him.", "Live-sex shows", "_cunts_", "'fag'", "bi+ch"):
        assert toxicity.vote(text)[0], text
    assert toxicity.vote("A person who needs help gets it.")[0] == 0 != toxicity.vote("A pig who needs help.")[0]


def test_answers_cut_after_a_whole_item_row_or_sentence_are_found_beside_their_whole_forms(spark):
    listed = "The papers are:\n\n1. The first form.\n2. The second form."
    table = "The limits are:\n\n| item | limit |\n|---|---|\n| x | 3 |"
    answers = [
        (listed, "truncated"), (listed + "\n3. The third form.\n4. The fourth form.\n\nSee below.", None), (table, "truncated"), (table + "\n| y | 4 |\n", None),
        ("It is covered. The form is due.", "truncated"), ("It is covered. The form is due. The clerk signs.", None), ("保险涵盖门诊。表格须在五天内提交。", "truncated"), ("保险涵盖门诊。表格须在五天内提交。由经办人签字。", None),
        ("Yes.", None), ("Yes. The form is due in May.", None), ("See the list:\n- one is due.\n- two is due.", None), ("See the list:\n- one is due.\n- two is due.\n\nThe clerk signs the form.", None),
        ("It is paid. The clerk is told.", None), ("It is paid. The clerk is told.\n\nSigned by the office.", None), ("- a is due.", "truncated"), ("- a is due.\n\nNo more.\n- b is due.", None), ("- a is due.\r\n- b is due.", None),
    ]
    df = spark.createDataFrame([(k, None, a) for k, (a, _) in enumerate(answers)], "id bigint, query string, answer string")
    found = {r.id: r.defect for r in pairs.find_defects(df, F.col("id"), F.col("query"), F.col("answer")).collect()}
    assert {k: (a, found.get(k)) for k, (a, d) in enumerate(answers) if found.get(k) != d} == {}


def test_headers_above_numbers_with_page_counts_and_of_few_pages(spark):
    body = [f"The clerk must record the {w} of the insured person" for w in ("pressure", "claim", "letter", "address", "invoice", "form", "answer", "charge")]
    rows = [(k, 1, k, 1, "\n".join([*body, "Printed on recycled paper", roman])) for k, roman in enumerate(["i", "ii", "iii", "iv", "v"], 1)]
    rows += [(20 + k, 2, k, 1, "\n".join([f"Claims Handbook - Page {k} of 12", *body])) for k in range(1, 13)]
    rows += [(100 + k, 3, k, 1, "\n".join([*(["Chapter of Losses"] if k < 10 else []), *body, f"- {k} -"])) for k in range(1, 101)]
    rows += [(300, 4, 1, None, "\n".join([*body, "Ward Manual", *body] * 2)), (301, 4, 2, None, "\n".join([*body, "Ward Manual", *body]))]
    df = spark.createDataFrame(rows, "result_id bigint, file_id bigint, page_no int, pages int, text string")
    found = {(r.result_id, r.item) for r in ocr_repair.furniture(df).where("kind = 'header'").collect()}
    wanted = {(k, "Printed on recycled paper") for k in range(1, 6)} | {(20 + k, f"Claims Handbook - Page {k} of 12") for k in range(1, 13)} | {(100 + k, "Chapter of Losses") for k in range(1, 10)} | {(300, "Ward Manual"), (301, "Ward Manual")}
    assert wanted <= found


def test_long_lines_can_be_headers_and_numbers_between_long_rules(spark):
    head = "General Conditions of Cover for Members of the Supplementary Plan and their Families, Edition for the Regional Offices, Part Two"
    rows = [(k, 1, k, 1, f"{head}\nThe clerk pays on day {k}.\n{'-' * 40} {k} {'-' * 40}\n{'=' * 70}\nThe end of page {'i' * k}.") for k in range(1, 7)]
    df = spark.createDataFrame(rows, "result_id bigint, file_id bigint, page_no int, pages int, text string")
    got = {(r.result_id, r.kind) for r in ocr_repair.furniture(df).collect()}
    assert {(k, kind) for k in range(1, 7) for kind in ("header", "page_number", "marks")} <= got


def test_long_texts_full_of_mentions_take_time_by_their_length():
    piece = "Write to edwin.lund@clinic.example.com or ring 07700 900590; Mrs Yarlsberg lives at 12 Foxglove Road, her number is 974-81-6808. "
    took = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        assert len(pii.find_mentions(piece * n)) == 5 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] and pii.find_mentions("7" * 200_000) == [] and pii.find_mentions("@" * 200_000) == [] and pii.find_mentions("a" * 300_000 + "@") == []


def test_numbers_and_domains_are_validated():
    kinds = lambda x: {k for _, _, k in pii.find_mentions(x)}
    assert kinds("Signed (998431197410013555).") == {"id_number"} and kinds("Signed (998431197410013554).") == set() and kinds("Signed (998431197413413555).") == set()
    assert kinds("See 123-45-6789.") == {"id_number"} and kinds("See 666-45-6789.") == set() and kinds("See 123-00-6789.") == set()
    assert kinds("invoice 0301234567 is due") == set() and kinds("ring 0301234567 today") == {"phone"}
    assert kinds("x@mail.example") == {"email"} and kinds("x" * 65 + "@mail.example") == set() and kinds(f"x@{'m' * 64}.example") == set() and kinds("665@4.50") == set()


def test_names_that_no_list_knows_and_every_form_of_street_and_at_sign():
    assert [k for _, _, k in pii.find_mentions("Please ask Ayodele Okonkwo about it, not Customer Care; please ask Customer Care.")] == ["name"]
    for x in ("12 Baker St, Leeds", "5 Hill Sq", "Kaiserring 12 bis", "9 Elm Rd\n", *(f"12 Foxglove {w.capitalize()}." for w in pii.STREET_WORDS)):
        assert [k for _, _, k in pii.find_mentions(x)] == ["address"], x
    for at in ("@", "[at]", "[ at ]", "(at)", "( at )", "{at}", "<at>", "[ät]", "( ät )"):
        assert [k for _, _, k in pii.find_mentions(f"write to ann.lee{at}mail.example now")] == ["email"], at
