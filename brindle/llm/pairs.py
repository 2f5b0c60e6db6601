"""Defects of question and answer pairs.

1. Responses are sorted by text over the whole table, whole ones and their segments (sentences, list items, lines), and
   each is compared with its neighbour's beginning: a last segment that is the common prefix of itself and its
   neighbour, and stands complete nowhere, is a shortened version; so is a whole answer that another one continues in
   the same list, table, quotation or paragraph, however it ends.
2. A histogram of lengths shows limits at which answers without an end pile up.
3. What neighbours can't tell, as nobody else says it, the answer's own marks do: open brackets, blocks and sentences.
4. Rules for empty and copied answers, refusals and other languages.

All three views of a shortened answer are taken of every answer. The sorts are by range over distinct texts, so no
prefix, however frequent, gathers in one task; where two partitions meet, the first text of the next one (one per
partition) is handed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

#: Stand-ins for nothing, without blanks and marks, in lower case.
NOTHING = frozenset(
    "null none nil na nan n undefined nothing empty blank tbd tba todo void noanswer nocontent noresponse noreply keine keiner leer keineantwort "
    "kA ka entfällt aucun aucune rien vide néant sansobjet 无 空 暂无 没有 无内容 无回答 无答案 空白 未填写 待补充".lower().split()
)
#: What stands before a repeated question, without blanks and marks, in lower case.
LABELS = frozenset(
    "q question query youasked yourquestion yourquestionwas yourquestionis youwanttoknow userquestion frage ihrefrage ihrefragewar ihrefragelautet siefragten "
    "siefragen votrequestion votrequestionest vousavezdemandé vousdemandez questionposée 问 问题 问题是 提问 您问 您问的是 您的问题 您的问题是 你问 你的问题 你的问题是 用户问题 原问题".split()
)

REFUSAL = re.compile(
    r"\b(?:i|we)(?: a|')?(?:m| are| re)? (?:sorry|unable|not able|not allowed|not permitted)\b"
    r"|\bcan(?:no|')?t (?:help|answer|assist|provide|respond|comment|discuss|find|share|give)\b|\bcannot (?:help|answer|assist|provide|respond|comment|discuss|find|share|give)\b"
    r"|\b(?:could not|couldn't|did not|didn't) find\b|\bunable to (?:answer|help|assist|find|provide|respond)|\brather not (?:comment|say|discuss|answer)|\b(?:outside|beyond) (?:of )?(?:my|our) (?:remit|scope|abilities|area|knowledge)"
    r"|\bno (?:suitable |relevant |matching )?(?:answer|information|results?|match(?:es)?|documents?|material) (?:could|was|were|is|are|can|found|available|on\b)|\bnothing (?:relevant |suitable |matching )?(?:turned up|was found|could be found|is known)"
    r"|\bnot enough (?:material|information|context|data)|\bdecline to\b|\bdo(?:es)? not (?:let|allow|permit) me\b|\bhave no (?:information|data|knowledge|material)\b|\bno information on\b"
    r"|\bnicht (?:beantworten|weiterhelfen|helfen)\b|\bkeine auskunft\b|\bkeine (?:\w+ )?(?:informationen|angaben|treffer|unterlagen|daten|dokumente|antwort)\b|\bnicht in der lage\b|\baußerhalb meine|\bmöchte ich mich nicht\b|\bnichts (?:passendes )?gefunden\b"
    r"|\bne (?:peux|puis|pouvons) pas\b|\bne suis pas (?:en mesure|autorisée?)\b|\baucune? (?:information|réponse|résultat|document|donnée)|\bpréfère ne pas\b|\bhors de mon\b|\bn'ai (?:pas|aucune?) (?:d'|l')?information"
    r"|无法(?:回答|找到|提供|作答|协助|帮|给出|查到|解答)|不便(?:对|就|回答|评论|透露)|超出(?:了)?我?的?(?:能力|范围|职责)|没有(?:关于|找到|查到|检索到)|(?:未|没)能?(?:找到|查到|检索到)|不能(?:提供|回答|给出|讨论)|拒绝回答|恕我",
    re.IGNORECASE,
)
#: An answer follows after all.
YET = re.compile(r"(?:\bbut\b|\bhowever\b|\byet\b|\baber\b|\bjedoch\b|\bdoch\b|\bmais\b|\bcependant\b|但|不过|然而)[^.!?。！？]{0,80}[:：]\s*\S")
OFFER = re.compile(
    r"rephras|search page|something else|an expert|anything else|another question|try (?:again|asking)|contact (?:support|the)|formulieren|suche\b|sonst noch|expert|reformul|recherche|autre chose|换个问法|搜索页面|其他可以|专家|重新(?:提问|表述)|联系人工", re.IGNORECASE
)

SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: Marks that end a sentence, or close what it stands in.
ENDS = frozenset(".!?。！？\"'”’»)）]】」』*_")
SOURCE = re.compile(r"^\s*(?:\[(?:source|quelle|sources?|来源|出处)\b.*\]|(?:source|quelle|来源|出处)\s*[:：].*)\s*$", re.IGNORECASE)
MARK = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)、]|[>#]+)\s*")
ITEM = re.compile(r"^(\s*)(?:([-*+•])|(\d{1,3})([.)、]))\s*\S")
CJK_END = re.compile(r"(?<=[。！？])(?=\S)")
CJK = re.compile(r"[㐀-鿿]+")
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿœŒ]+")
NOT_ALNUM = re.compile(r"[\W_]+")
LATIN = re.compile(r"[a-zà-öø-ÿœ']+")
ASKS = {
    "en": re.compile(r"(?:answer|reply|respond|write|please)[^.!?。！？]{0,25}\bin english\b|\bin english,? please\b|用英[语文]|英[语文]回答|auf englisch|en anglais", re.IGNORECASE),
    "de": re.compile(r"auf deutsch|in german\b|用德[语文]|德[语文]回答|en allemand", re.IGNORECASE),
    "fr": re.compile(r"en français|in french\b|auf französisch|用法[语文]|法[语文]回答", re.IGNORECASE),
    "zh": re.compile(r"用(?:简体|繁体)?(?:中文|汉语)|(?:中文|汉语)(?:回答|作答|回复)|in chinese\b|auf chinesisch|en chinois", re.IGNORECASE),
}
#: Frequent words by which a text's language is told.
COMMON = {
    "en": frozenset("the of is are was for and to if in on at by be or an a must may not within what which how do does who can i my any under after before when where with from this that it you your please yes no section see only days hours weeks months deadline approves".split()),
    "de": frozenset("der die das den dem des ist sind war für und zu wenn in im am von bei nach vor mit auf aus wird werden nicht muss kann darf welche welcher wie wer wann wo bitte sie ich mein eine einer ein ab zum zur tage tagen stunden wochen monate monaten ja nein nur sofern solange falls frist ziffer".split()),
    "fr": frozenset("le la les de du des est sont pour et à au aux dans en un une si sur par avec après avant que qui quelles quels comment où quand doit peut ne pas vous je mon ma oui non jours mois semaines heures seulement uniquement tant l d".split()),
}


def ended(text: str) -> bool:
    return text.rstrip()[-1:] in ENDS and not text.isspace() and text != ""


def squeezed(text: str) -> str:
    """Letters and digits alone, in lower case."""
    return NOT_ALNUM.sub("", text.casefold())


def language(text: str) -> str | None:
    """en, de, fr or zh; None where nothing tells."""
    han = 0 if text.isascii() else sum(map(len, CJK.findall(text)))
    latin = sum(map(len, LETTERS.findall(text)))
    if han and 2 * han >= latin / 2:
        return "zh"
    tokens = LATIN.findall(text.lower().replace("’", "'").replace("'", " "))
    if not tokens:
        return None
    score = {k: float(sum(map(v.__contains__, tokens))) for k, v in COMMON.items()}
    score["de"] += 0.7 * sum(("ß" in t) or ("ä" in t) or ("ü" in t) or ("ö" in t) or t.endswith(("ung", "keit", "heit")) for t in tokens)
    score["fr"] += 0.7 * sum(("é" in t) or ("è" in t) or ("ê" in t) or ("ç" in t) for t in tokens)
    score["en"] += 0.4
    return max(score, key=lambda k: score[k])


def _body(answer: str) -> str:
    """The answer without quotations, code, source notes and headings."""
    kept, code = [], False
    for line in answer.split("\n"):
        if line.lstrip().startswith("```"):
            code = not code
        elif not code and not line.lstrip().startswith((">", "#", "|")) and not SOURCE.match(line):
            kept.append(line)
    return "\n".join(kept)


def is_empty(answer: str | None) -> bool:
    core = squeezed(answer or "")
    return not core or core in NOTHING


def is_copy(query: str | None, answer: str) -> bool:
    asked, said = squeezed(query or ""), squeezed(answer)
    if len(asked) < 2 or not said:
        return False
    if said == asked or (len(said) % len(asked) == 0 and said == asked * (len(said) // len(asked))):
        return True
    if said.endswith(asked):
        label = said[: -len(asked)]
        if label in LABELS or label in (x + asked for x in LABELS):
            return True
    # The question alone, where the query says more.
    parts = {squeezed(s) for s in SENTENCE.split(query or "")} - {""}
    for label in sorted(LABELS, key=len, reverse=True):
        if said.startswith(label) and said[len(label) :] in parts:
            return True
    return said in parts and len(said) >= 6 and answer.rstrip().endswith(("?", "？"))


def is_refusal(answer: str) -> bool:
    sentences = [s.strip() for s in SENTENCE.split(_body(answer)) if s and s.strip()]
    first = next((k for k, s in enumerate(sentences[:2]) if REFUSAL.search(s)), None)  # an answer that declines does so at once
    if first is None or YET.search(" ".join(sentences[first : first + 2])):
        return False
    others = 0
    for k, s in enumerate(sentences):
        others += k != first and not OFFER.search(s) and not REFUSAL.search(s)
        if others > 1:
            return False
    return True


def tail_of(answer: str) -> tuple[str, str]:
    """How the answer ends: 'done', 'cut' or, where only other texts can tell, 'item'; and its last segment."""
    lines = [x for x in answer.rstrip().split("\n")]
    if sum(x.lstrip().startswith("```") for x in lines) % 2:
        return "cut", lines[-1]
    while lines and (not lines[-1].strip() or SOURCE.match(lines[-1])):
        lines.pop()
    if not lines:
        return "done", ""
    last = lines[-1].strip()
    if last.startswith("```"):
        return "done", last
    if last.startswith("|"):
        head = next((x.strip() for x in lines if x.strip().startswith("|")), last)
        whole = last.endswith("|") and last.count("|") == head.count("|") and (last.replace(" ", "").find("||") < 0) and len(lines) >= 2
        rule = not re.sub(r"[|\s:-]", "", last)
        return ("cut" if not whole or rule else "done"), last
    item = MARK.match(last)
    text = last[item.end() :].strip() if item else last
    if not text:
        return "cut", last
    if text.endswith(("…", "...", "..", ":", "：", ",", "，", "、", ";", "；", "—", "(", "（", "-")):
        return "cut", text
    if last.startswith("#"):
        return ("cut" if len(lines) > 1 else "item"), text
    for opening, closing in (("(", ")"), ("（", "）"), ("[", "]"), ("「", "」"), ("“", "”")):
        segment = SENTENCE.split(text)[-1] if not ended(text) else ""
        if segment.count(opening) > segment.count(closing):
            return "cut", text
    if ended(text):
        return "done", text
    if item:
        return "item", (SENTENCE.split(text) or [text])[-1].strip()
    return "cut", text


def whole_form(answer: str) -> str:
    """An answer in the form in which whole answers are compared: a blank after each sentence, none at the end."""
    answer = answer.replace("\r\n", "\n")
    return (answer if answer.isascii() else CJK_END.sub(" ", answer)).rstrip()


def continuations(whole: str) -> list[str]:
    """With what a longer version of an answer (in its ``whole_form``) goes on, where it is the same list, table, quotation or paragraph.

    A paragraph of one sentence is an answer of its own, and a new paragraph may always follow.
    """
    last = whole.rsplit("\n", 1)[-1]
    if not whole or SOURCE.match(last) or whole.count("```") % 2 or last.lstrip().startswith(("```", "#")):
        return []
    if last.lstrip().startswith(("|", ">")):
        indent = last[: len(last) - len(last.lstrip())]
        return [f"\n{indent}{last.lstrip()[0]}"]
    item = ITEM.match(last)
    if item:
        indent, bullet, number, end = item.groups()
        mark = f"{indent}{bullet} " if bullet else f"{indent}{int(number) + 1}{end}"
        return [f"\n{mark}", f"\n\n{mark}"]
    return [" "] if ended(last) and len([x for x in SENTENCE.split(last) if x.strip()]) >= 2 else []


def judge(query: str | None, answer: str | None) -> tuple[str | None, bool, bool]:
    """By the pair's own text: 'empty', 'copy' or 'refusal'; whether the answer breaks off by its marks; whether it is in another language."""
    if is_empty(answer):
        return "empty", False, False
    if is_copy(query, answer):
        return "copy", False, False
    if is_refusal(answer):
        return "refusal", False, False
    cut, other = tail_of(answer)[0] == "cut", False
    if query and not cut:
        asked = [k for k, v in ASKS.items() if v.search(query)]
        for k in asked:
            query = ASKS[k].sub(" ", query)
        said, wants = language(_body(answer)), language(query)
        other = bool(said and wants and said != wants and said not in asked)
    return None, cut, other


#: Marks and blanks at a segment's end that its form does without.
FORM_END, DIGITS = ".!?。！？… \t\r\n\f\v\u00a0\u3000", re.compile(r"[0-9]+")


def segment_form(text: str) -> str:
    """A segment in the form in which segments are compared: marks at its ends gone, runs of digits as 0."""
    return DIGITS.sub("0", MARK.sub("", text, 1).rstrip(FORM_END).strip())


def segments(answer: str) -> tuple[list[tuple[str, bool]], str | None]:
    """Segments of an answer in their form, each with whether it is complete here, and the last one where it isn't.

    Segments are complete if another one follows, or by their end mark. Source notes at the end are left out; a closed block
    is complete.
    """
    lines = answer.rstrip().split("\n")
    while lines and (not lines[-1].strip() or SOURCE.match(lines[-1])):
        lines.pop()
    parts = [x for x in SENTENCE.split("\n".join(lines)) if x and not x.isspace()]
    forms = [segment_form(x) for x in parts]
    if not parts:
        return [], None
    closed = parts[-1].lstrip().startswith("```") and sum(x.lstrip().startswith("```") for x in lines) % 2 == 0
    whole = closed or ended(parts[-1]) and not parts[-1].rstrip().endswith(("..", "…"))
    out = [(f, True) for f in forms[: len(forms) if whole else -1] if f]
    return out, None if whole or not forms[-1] else forms[-1]


def _views(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each pair as judged by itself, with its last segment where that isn't complete; and a batch's complete segments, each once."""
    columns = ["id", "defect", "cut", "other", "length", "whole", "after", "segment"]
    for frame in frames:
        rows, complete = [], set()
        for id_, query, answer in zip(frame["id"], frame["query"], frame["answer"], strict=True):
            defect, cut, other = judge(query, answer)
            parts, tail = segments(answer) if answer else ([], None)
            complete.update(x for x, _ in parts)
            whole = whole_form(answer) if answer and defect is None else ""
            after = continuations(whole)
            rows.append((id_, defect, cut, other, len(answer or ""), whole if after else None, after, tail))
        rows += [(None, "segment", False, False, 0, None, [], x) for x in complete]
        yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64"})


def _neighbours(first: dict[int, str]):
    """Marks each segment that the next one in order begins with. ``first``: the first text of each partition."""
    order = sorted(first)
    follows = {p: first[q] for p, q in zip(order, order[1:], strict=False)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if not len(frame):
                continue
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            held = frame.tail(1)
            texts = frame["segment"].tolist()
            begins = [b.startswith(a) for a, b in zip(texts, texts[1:], strict=False)]
            out = frame.iloc[:-1].assign(begins=begins)
            out = out[out["is_tail"]]
            yield out[["segment", "ends", "begins"]]
        if held is not None and bool(held["is_tail"].iloc[0]):
            after = follows.get(int(held["part"].iloc[0]))
            yield held.assign(begins=[after is not None and after.startswith(held["segment"].iloc[0])])[["segment", "ends", "begins"]]

    return run


def shortened_tails(tails: DataFrame, complete: DataFrame, partitions: int | None = None) -> DataFrame:
    """Of the ``tails`` (column ``segment``), those that are beginnings of other segments, ``complete`` or not, and nowhere complete."""
    every = complete.select("segment", F.lit(True).alias("ends"), F.lit(False).alias("is_tail")).unionByName(tails.select("segment", F.lit(False).alias("ends"), F.lit(True).alias("is_tail")))
    distinct = every.groupBy("segment").agg(F.max("ends").alias("ends"), F.max("is_tail").alias("is_tail"))
    return _beside(distinct, partitions).where("begins and not ends").select("segment")


def _beside(distinct: DataFrame, partitions: int | None) -> DataFrame:
    """Rows (segment, ends, begins) of the tails among distinct rows (segment, ends, is_tail): whether the next one in order begins with it."""
    count = partitions or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = cut_lineage(distinct.repartitionByRange(count, "segment").sortWithinPartitions("segment").withColumn("part", F.spark_partition_id()))
    first = {r["part"]: r["segment"] for r in line.groupBy("part").agg(F.min("segment").alias("segment")).collect()}
    return line.mapInPandas(_neighbours(first), "segment string, ends boolean, begins boolean")


def shortened_answers(answers: DataFrame, judged: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ids of the rows (id, whole, after) of ``judged`` whose answer is continued, as ``after`` says, by one of ``answers``.

    Each continuation's beginning is sorted among the whole answers, so the next one in order tells whether it stands
    anywhere.
    """
    form = F.regexp_replace(F.regexp_replace(F.replace("answer", F.lit("\r\n"), F.lit("\n")), r"(?U)(?<=[。！？])(?=\S)", " "), r"(?U)\s+$", "")
    whole = answers.select(form.alias("segment"), F.lit(True).alias("ends"), F.lit(False).alias("is_tail"))
    asked = judged.select("id", F.explode("after").alias("after"), "whole").select("id", F.concat("whole", "after").alias("segment"))
    every = whole.unionByName(asked.select("segment", F.lit(False).alias("ends"), F.lit(True).alias("is_tail")))
    distinct = every.groupBy("segment").agg(F.max("ends").alias("ends"), F.max("is_tail").alias("is_tail"))
    return asked.join(_beside(distinct, partitions).where("begins or ends").select("segment"), "segment", "left_semi").select("id").distinct()


def length_limits(unended: DataFrame, reach: int = 10, least: int = 20, times: float = 8.0) -> DataFrame:
    """Lengths at which answers without an end pile up: ``least`` or more, and ``times`` the mean of ``reach`` lengths on either side.

    Fewer answers of one length are no evidence of a limit.
    """
    counts = unended.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    around = counts.select(F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length"), "n", F.col("length").alias("own"))
    mean = around.groupBy("length").agg(F.sum(F.when(F.col("own") != F.col("length"), F.col("n")).otherwise(0)).alias("other"), F.sum(F.when(F.col("own") == F.col("length"), F.col("n")).otherwise(0)).alias("n"))
    return mean.where((F.col("n") >= least) & (F.col("n") > times * F.col("other") / (2 * reach))).select("length")


VIEW = "id bigint, defect string, cut boolean, other boolean, length int, whole string, after array<string>, segment string"


def view_pairs(df: DataFrame, row_id: Column, query: Column, answer: Column) -> DataFrame:
    """Rows (id, defect, neighbour, limit, continued, cut, other): each pair from every view.

    ``defect`` is 'empty', 'copy' or 'refusal'. An answer is a shortened one by its ``neighbour`` among the segments, by
    a ``limit`` of length, as another answer ``continued`` it, or as its own marks show that it is ``cut``. ``other``: in
    another language.
    """
    pairs = df.select(row_id.cast("bigint").alias("id"), query.cast("string").alias("query"), answer.cast("string").alias("answer"))
    views = cut_lineage(pairs.mapInPandas(_views, VIEW))
    rows, complete = views.where("defect is null or defect <> 'segment'"), views.where("defect = 'segment'")
    unended = rows.where("segment is not null")
    near = shortened_tails(unended, complete).withColumn("neighbour", F.lit(True))
    limits = length_limits(unended).withColumn("limit", F.lit(True))
    longer = shortened_answers(pairs.where("answer is not null").select("answer"), rows.where("whole is not null")).withColumn("continued", F.lit(True))
    told = unended.join(near, "segment", "left").join(limits, "length", "left").select("id", "neighbour", "limit", F.lit(None).cast("boolean").alias("continued")).where("neighbour or limit")
    told = told.unionByName(longer.select("id", F.lit(None).cast("boolean").alias("neighbour"), F.lit(None).cast("boolean").alias("limit"), "continued"))
    own = rows.select("id", "defect", "cut", "other", *[F.lit(False).alias(c) for c in TOLD])
    others = told.select("id", F.lit(None).cast("string").alias("defect"), F.lit(False).alias("cut"), F.lit(False).alias("other"), *[F.coalesce(c, F.lit(False)).alias(c) for c in TOLD])
    return own.where("defect is not null or cut or other").unionByName(others).groupBy("id").agg(F.max("defect").alias("defect"), *[F.max(c).alias(c) for c in (*TOLD, "cut", "other")])


#: Views of an answer that only other answers give.
TOLD = ("neighbour", "limit", "continued")


def find_defects(df: DataFrame, row_id: Column, query: Column, answer: Column) -> DataFrame:
    """Rows (id, defect): every pair whose answer is unfit, at most one defect each.

    Defects, the first that holds: 'empty' (null, blanks, marks or a stand-in for nothing), 'copy' (the question and
    nothing more), 'refusal', 'truncated' (unfinished sentence, list, table or block), 'language' (another one than the
    question's, unless the query asks for it). Null and empty queries are compared with nothing. Repeated rows are
    judged alike, each under its own id (an id once); an empty table gives an empty result. Whole answers are judged,
    however long.
    """
    shortened = F.col("neighbour") | F.col("limit") | F.col("continued") | F.col("cut")
    defect = F.coalesce("defect", F.when(shortened, "truncated"), F.when(F.col("other"), "language"))
    return view_pairs(df, row_id, query, answer).select("id", defect.alias("defect")).where("defect is not null")
