"""Personal information in free text: found from anchors, replaced by typed placeholders.

One Aho-Corasick pass over each text finds anchors of all five kinds: at-signs and their spellings, digits and the cues
of identity numbers, street words, and what stands before, after or within names. From each anchor a local parser reads
outwards, to both sides, and validates what it finds: the labels of a domain, the calendar and check digit of a citizen
number, the parts of a social insurance number, the house number of a street. E-mail addresses are settled first, so
that their user parts are never names. All windows are local, so the work grows with the text's length alone. Texts are
worked on where they lie, without a shuffle.
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Common given names of several languages, in lower case; none that is also a month or an everyday word.
GIVEN = (
    "adam adrian agnes ahmed albert alexander alice amelia amir andrea andreas andrew anna anne anthony antoine arthur astrid beatrice benjamin bernard birgit brian bruno camille carla "
    "carlos carmen caroline catherine charles charlotte christian christine christopher claire clara claudia daniel david deborah dennis diana diego dmitri dominik dorothy edith edward edwin "
    "elena elias elisabeth elizabeth ella emil emily emma eric erik esther eva fatima felix fiona florian francis frank franz fritz gabriel georg george gerhard gertrud giulia greta hannah "
    "hans harold hassan heike helen helena helmut henrik henry hiroshi ibrahim igor ines ingrid irene isabel isabella ivan ivo jakob james jane jean jennifer jessica joachim johann johannes john "
    "jonas jonathan joseph juan julia julian jürgen karen karim karin karl katharina kenji kevin klaus lars laura leila lena leon leonard linda lisa louis louise lucas lucia lucy lukas maja "
    "marcel marco marcus margaret maria marie mario markus martha martin martina mary matthew matthias mehmet mei michael miguel mohammed monika nadia natalia nicolas nina noah nora olga oliver olivia omar oscar otto pablo "
    "patricia patrick paul pauline pedro peter petra philip pierre priya rachel rafael rahul ralf raymond rebecca richard robert roland rosa ruth samuel sandra sarah sebastian simon sofia sophia sophie "
    "stefan stephen steven susan susanne sven sylvia tanja tatiana teresa theodore thomas tim tobias ulrich ursula valentina vera veronica victor victoria viktor vincent walter werner william wolfgang yasmin yusuf zoe"
).split()
#: Chinese family names of one character, and those of two.
FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝"
FAMILY_TWO = ("欧阳", "上官", "司马", "诸葛", "皇甫", "尉迟", "公孙", "慕容", "司徒", "令狐")

FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2212: 0x2D, 0x2019: 0x27}
HAN = "㐀-鿿"

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"[A-Za-z0-9ÄÖÜäöüß](?:[\w.%+'-]*[A-Za-z0-9_])?(?:@| ?[\[({{<] ?(?:at|ät) ?[\])}}>] ?){LABEL}(?:(?:\.| ?[\[({{<] ?(?:dot|punkt|point) ?[\])}}>] ?){LABEL})+"
    rf"|[A-Za-z0-9][\w.+-]* at {LABEL}(?: dot {LABEL})+",
    re.IGNORECASE | re.ASCII,
)
#: Digits kept apart by up to three blanks or marks, as numbers of phones and persons are written.
DIGITS = re.compile(r"\d(?:[ ().\-/]{0,3}\d)*")
PHONE = re.compile(
    r"""(?<![A-Za-z0-9.+/])(?<!\d-)(?:
      (?:\+|\b00)[ ]?[1-9]\d{0,2}(?:[ .\-/]?\(0\)[ ]?|[ ]?\(\d{1,4}\)[ ]?|[ .\-/])?\d{1,5}(?:[ .\-/]?\d{2,8}){1,5}
      | \(\d{3}\)[ ]?\d{3}[-. ]\d{4}
      | [2-9]\d{2}([-. ])\d{3}\1\d{4}
      | 1[ -.]\(?[2-9]\d{2}\)?[-. ]\d{3}[-. ]\d{4}
      | 0\d([ .\-])\d{2}\2\d{2}\2\d{2}\2\d{2}
      | 0\d{3,4}[ ]\d{3}[ ]?\d{3,4}
      | 0\d{2,3}[ ]\d{3,4}[ ]\d{4}
      | \(0\d{1,4}\)[ ]?\d{3,4}[ ]?\d{3,4}
      | 0\d{1,4}[ ]?[-/][ ]?\d{5,8}(?:[ -]\d{1,4})?
      | 0[1-9]\d{2,3}[ ]\d{5,8}
      | 1[3-9]\d([ -]?)\d{4}\3\d{4}
      | [2-9]\d{2}[2-9]\d{6}
      | 0[1-9]\d{8,9}
    )(?![A-Za-z0-9]|[-/.]\d)""",
    re.VERBOSE,
)
SOCIAL = re.compile(r"(?<![A-Za-z0-9-])\d{3}([- ])\d{2}\1\d{4}(?![A-Za-z0-9]|[-/]\d)")
INSURANCE = re.compile(r"(?<![A-Za-z0-9-])[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D](?![A-Za-z0-9])", re.IGNORECASE)
CITIZEN = re.compile(r"(?<![A-Za-z0-9-])[1-9]\d{5}[ -]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx](?![A-Za-z0-9])")
CUED = re.compile(r"[^\dA-Z\n]{0,24}?((?:[A-Z]{1,3}[ -]?)?\d(?:[ -]?[\dA-Z]){5,18})(?![A-Za-z0-9])")
LEDGER = re.compile(r"(?:ledger|entry|claim|policy|invoice|ticket|account|流水|保单|案件|发票|单)\D{0,12}$", re.IGNORECASE)

WORD = r"(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]*[A-Za-zÀ-ÖØ-öø-ÿ])"
SURNAME = rf"{WORD}(?:-{WORD})?"
INITIAL = r"(?: [A-Z]\.?(?=[ ]))?"
#: streets' kinds in English, with their short forms.
STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Court|Ct\.?|Drive|Dr\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Crescent|Gardens?|Mews|Boulevard|Blvd\.?|Row|Walk|Parade|Grove|Highway|Parkway|Alley|Wharf|Quay|Rise)"
ENGLISH = re.compile(rf"(?<![A-Za-z0-9-])\d{{1,5}} ?[A-Za-z]?,? (?:{WORD} |St\. ){{1,4}}{STREET}(?![A-Za-z])(?:,? (?:Apt|Flat|Unit|Suite)\.? ?\d+[A-Za-z]?)?")
GERMAN = re.compile(r"(?<![A-Za-zäöüß])(?:[A-ZÄÖÜ][a-zäöüß]+[ -]){0,3}[A-ZÄÖÜa-zäöüß][a-zäöüß-]*(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|damm|ufer|steig|pfad|ring|hof|markt|chaussee)[ ]\d{1,4} ?[a-z]?(?![A-Za-z0-9])(?:, \d{5} [A-ZÄÖÜ][a-zäöüß]+)?")
GERMAN_CODE = re.compile(r"(?<![A-Za-zäöüß])(?:[A-ZÄÖÜ][A-Za-zäöüß.-]* ){1,4}\d{1,4} ?[a-z]?, ?\d{5} [A-ZÄÖÜ][a-zäöüß]+")
FRENCH = re.compile(r"(?<![A-Za-z0-9-])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|chemin|place|impasse|allée|quai|route|cours|passage|square|sentier|faubourg)[ ](?:de la |de l'|des |du |de |d'|à la )?(?:[A-ZÀ-Þ][\wÀ-ÿ'-]*[ ]?){1,4}(?:, \d{5} [A-ZÀ-Þ][\wÀ-ÿ-]+)?", re.IGNORECASE)
CHINESE = re.compile(rf"(?:[{HAN}]{{1,7}}[省市区县乡镇村])*[{HAN}]{{1,7}}(?:路|街|巷|大道|道|弄|胡同|里)[ ]?\d{{1,5}}[ ]?(?:号|弄|栋|幢)(?:[ ]?\d+[ ]?(?:栋|幢|单元|号楼|楼|室|层|座|号))*(?:\d{{2,4}})?")
LEADS_TO = re.compile(r"现住|居住[在于]|住在|住址是?|寄到|寄至|寄往|搬到|搬至|搬往|送到|送至|地址[是为]?|位于|女士|先生")
CAPITALS = re.compile(ENGLISH.pattern, re.IGNORECASE)
BEFORE_STREET = 70
ANY_DIGIT = re.compile(r"\d")

TITLE = re.compile(rf"(?:(?:Dr|Prof|Dipl|Ing)\.? )*({SURNAME})(?: ({SURNAME}))?")
#: What a person can be asked, or done to, in lower case; a name follows.
PERSONAL = (
    "please ask", "i asked", "we asked", "i met", "we met", "i phoned", "i thanked", "my colleague", "our colleague", "my wife", "my husband", "my son", "my daughter", "my mother", "my father", "my brother", "my sister", "my neighbour", "my partner",
    "meine frau", "mein mann", "mein sohn", "meine tochter", "mein kollege", "meine kollegin", "ma femme", "mon mari", "mon fils", "ma fille", "mon collègue", "ma collègue",
)
#: Words of firms, products and roles.
NO_PERSON = frozenset(
    "care cover plan basic plus premium comfort group team desk office service services clinic clinics hospital logistics systems insurance travel support department ltd inc gmbh ag sa llc co company bank union manager officer clerk nurse doctor broker director "
    "supervisor adjuster administrator physician auditor human resources customer claims payroll procurement legal records branch ward manual handbook section part form policy".split()
)
NOT_A_NAME = frozenset("the a an sir madam dr prof or and und et ou oder mr mrs ms miss herr frau mme please bitte merci this that see section note flat apt room total claim form under for where patients requests any your our my we you it if is do not no all der die das ein eine le la les un une".split())
INTRODUCED = re.compile(rf"[ :]*({WORD}{INITIAL}(?: [A-Z]\.)? {SURNAME}|{SURNAME}, {WORD}(?: [A-Z]\.)?)(?![A-Za-z])")
PERSON = re.compile(rf"[ :,]+({WORD}{INITIAL} {SURNAME})(?![A-Za-z-])")
GIVEN_FIRST = re.compile(rf"({WORD}(?:-{WORD})?)(?: [A-Z]\.| [A-Z](?= ))? ({SURNAME})(?![A-Za-z])")
FAMILY_FIRST = re.compile(rf"({SURNAME}), $")
FOLLOWED = re.compile(r"[\s]*(?:asked about|can be reached|lives at|hat gestern|habite au|a posé|wohnhaft|先生|女士|也问过|现住|已搬)")
HAN_NAME = rf"(?:{'|'.join(FAMILY_TWO)}|[{FAMILY}])[{HAN}]{{1,2}}?"
HAN_AFTER = re.compile(rf"[:： ]*({HAN_NAME})(?=确认|也|现|已|先生|女士|小姐|[，,。.（(、;；:：\s]|电话|的|$)")
HAN_TITLED = re.compile(rf"((?:{'|'.join(FAMILY_TWO)}|[{FAMILY}])[{HAN}]{{0,2}})$")
LATIN_TITLED = re.compile(rf"({SURNAME})$")

#: What stands before a name.
INTRODUCTIONS = (
    "my name is", "i spoke with", "i talked to", "spoke to", "signed by", "according to", "the applicant", "contact:", "applicant:", "patient:", "insured:", "name:", "attn:", "attn.", "c/o", "regards,", "sincerely,",
    "mein name ist", "ich heiße", "antragsteller:", "antragstellerin:", "ansprechpartner:", "unterschrieben von", "laut", "versicherter:", "je m'appelle", "mon nom est", "le demandeur", "la demandeuse", "signé par", "selon",
)
HAN_INTRODUCTIONS = ("请联系", "联系人", "我叫", "我是", "申请人", "签字人", "上周", "姓名", "经办人", "本人", "昨天", "患者", "根据", "收件人", "投保人", "被保险人", "负责人", "家属")
TITLES = ("mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "miss ", "mx ", "mx. ", "dr ", "dr. ", "prof ", "prof. ", "professor ", "herr ", "herrn ", "frau ", "m. ", "mme ", "mme. ", "mlle ", "monsieur ", "madame ")
#: Anchors of streets: the kinds that ``ENGLISH`` and ``GERMAN`` read, in full anywhere, short ones between a blank and what may follow them.
STREET_WORDS = [w.removesuffix("s?").removesuffix("\\.?").lower() for w in STREET.removeprefix("(?:").removesuffix(")").split("|")]
STREETS = tuple(w for w in STREET_WORDS if len(w) > 4) + tuple(f" {w}{after}" for w in STREET_WORDS if len(w) <= 4 for after in " .,;:!?)\"'\n\r")
GERMAN_STREETS = tuple(f"{w} " for w in ("straße", "strasse", "str.", *"weg allee gasse platz damm ufer steig pfad ring hof markt chaussee".split()))
FRENCH_STREETS = (" rue ", " avenue ", " av. ", " boulevard ", " bd ", " chemin ", " impasse ", " allée ", " quai ", " route ", " faubourg ")
IDENTITY = ("passport", "reisepass", "personalausweis", "ausweis", "passeport", "carte d'identité", "identity card", "identity number", "identity checked", "identität geprüft", "id card", "national id", "ssn", "social security", "social insurance", "sozialversicherung", "sécurité sociale", "nino", "national insurance", "身份证", "护照", "社保")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    words: dict[str, tuple[str, int]] = {}
    for kind, group in (
        ("given", GIVEN), ("intro", INTRODUCTIONS), ("han", HAN_INTRODUCTIONS), ("title", TITLES), ("street", STREETS), ("german", GERMAN_STREETS),
        ("french", FRENCH_STREETS), ("identity", IDENTITY), ("han_title", ("先生", "女士", "小姐", "太太")), ("han_street", ("号", "弄", "栋")), ("mail", ("@", " dot ", *(f"{at}{gap}{close}" for at in ("at", "ät") for gap in ("", " ") for close in "])}>"))),
        ("digit", tuple("0123456789")), ("person", PERSONAL),
    ):
        for w in group:
            words.setdefault(w, (kind, len(w)))
    machine = ahocorasick.Automaton()
    for w, value in words.items():
        machine.add_word(w, value)
    machine.make_automaton()
    return machine


def flatten(text: str) -> tuple[str, list[int] | None]:
    """The text in one line's form, and the place of each of its characters in the original (None if they agree).

    Full-width forms become plain ones and line ends blanks, except at empty lines; of several blanks one is left. Words
    divided at a line's end are joined. Where Han characters prevail, blanks beside them are dropped.
    """
    flat = text.translate(FULL_WIDTH)
    if "\n" not in flat and "\r" not in flat and "­" not in flat and "  " not in flat and not (" " in flat and re.search(rf"[{HAN}] | [{HAN}]", flat)):
        return flat, None
    han = len(re.findall(rf"[{HAN}]", flat)) * 4 > len(flat)
    drop: set[int] = set()
    for m in re.finditer(r"(?<= ) +", flat):
        drop.update(range(m.start(), m.end()))
    for m in re.finditer(r"(?<=[A-Za-zäöüß])[-¬­][ ]?\r?\n[ ]?(?=[a-zäöüß])|\r(?=\n)|­", flat):
        drop.update(range(m.start(), m.end()))
    if han:
        for m in re.finditer(rf"(?<=[{HAN}，。：；、（）,.:;()0-9A-Za-z@_-])[ ]+(?=[{HAN}，。：；、（）])|(?<=[{HAN}，。：；、（）])[ ]+(?=[0-9A-Za-z{HAN}])|(?<=[^\n.。!?！？])[ ]?\r?\n[ ]?(?=[^\n\s])", flat):
            drop.update(range(m.start(), m.end()))
    lines = re.sub(r"(?<!\n)\r?\n(?!\r?\n)", lambda m: " " * len(m.group()), flat)
    if not drop:
        return lines, None
    kept = [k for k in range(len(flat)) if k not in drop]
    return "".join(lines[k] for k in kept), kept


def _good_name(words: list[str]) -> bool:
    return all(w.lower().strip(".'’") not in NOT_A_NAME for w in words)


def _is_citizen(number: str) -> bool:
    """Whether a Chinese citizen number holds a day of the calendar and its check digit."""
    digits = re.sub("[ -]", "", number).upper()
    try:
        dt.date(int(digits[6:10]), int(digits[10:12]), int(digits[12:14]))
    except ValueError:
        return False
    return "10X98765432"[sum(int(d) << 17 - k for k, d in enumerate(digits[:17])) % 11] == digits[17]


def _is_social(number: str) -> bool:
    """Whether none of a social security number's parts is one that is never given."""
    area, group, serial = re.split("[ -]", number)
    return area not in ("000", "666") and group != "00" and serial != "0000"


def _is_mail(address: str) -> bool:
    """Whether the domain is made of labels of at most 63 characters, the last of them no number."""
    labels = re.split(r"[.]|dot|punkt|point", re.split(r"@|[\[({<] ?[aä]t ?[\])}>]| at ", address, flags=re.IGNORECASE)[-1])
    return len(labels) > 1 and all(0 < len(x.strip(" []{}()<>")) <= 63 for x in labels) and not labels[-1].strip(" []{}()<>").isdigit()


LOCAL = frozenset("0123456789.%+'-_")


def _mails(flat: str, hits: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """E-mail addresses around the at-signs, read to the left as far as a user part goes and to the right over the domain."""
    out: list[tuple[int, int]] = []
    for end, kind, size in hits:
        if kind != "mail" or (out and end <= out[-1][1]):
            continue
        low = end - size
        if flat[low] == " ":  # ' dot ' of 'name at mail dot com'
            low = max(0, flat.rfind(" at ", max(0, low - 80), low))
        while low > 0 and flat[low - 1] in " [({<" and end - size - low < 3:
            low -= 1
        user = low
        while low > 0 and user - low <= 64 and (flat[low - 1].isalpha() or flat[low - 1] in LOCAL):
            low -= 1
        if user - low > 64:  # no user part is longer
            continue
        m = EMAIL.search(flat, max(low, out[-1][1] if out else 0), min(len(flat), end + 260))
        if m and m.start() < end <= m.end() and _is_mail(m.group()):
            out.append(m.span())
    return out


def _numbers(flat: str, at: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Where the digits that begin at ``at`` end, and the numbers of persons and phones among them."""
    run = DIGITS.match(flat, at)
    stop = run.end()
    if sum(map(str.isdigit, run.group())) < 6:
        return stop, []
    low, high = max(0, at - 6), min(len(flat), stop + 4)
    ledger = LEDGER.search(flat[max(0, at - 20) : at]) is not None
    found = [(*m.span(), "id_number") for m in CITIZEN.finditer(flat, low, high) if not ledger and _is_citizen(m.group())]
    found += [(*m.span(), "id_number") for m in SOCIAL.finditer(flat, low, high) if _is_social(m.group())]
    found += [(*m.span(), "id_number") for m in INSURANCE.finditer(flat, low, high)]
    if not found:
        found = [(*m.span(), "phone") for m in PHONE.finditer(flat, low, high) if not (ledger and m.group().isdigit())]
    return stop, found


def _mentions(flat: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    lower = flat.lower()
    if len(lower) != len(flat):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in flat)
    hits = [(end + 1, *value) for end, value in anchors().iter(f"{lower} ") if end < len(flat) or value[0] in ("street", "german")]
    hits = [(min(end, len(flat)), kind, size - max(0, end - len(flat))) for end, kind, size in hits]
    kinds = {h[1] for h in hits}

    mails = _mails(flat, hits) if "mail" in kinds else []
    if mails:
        found += [(a, b, "email") for a, b in mails]
        rest, at = [], 0
        for a, b in mails:
            rest += [flat[at:a], "\x00" * (b - a)]
            at = b
        flat = "".join([*rest, flat[at:]])

    digits_end = -1
    everywhere = flat.isupper()
    seen_street = -1
    for end, kind, size in hits:
        start = end - size
        if kind == "digit":
            if start >= digits_end and flat[start] != "\x00":
                digits_end, numbers = _numbers(flat, start)
                found += numbers
                if digits_end - start == 5 and flat[digits_end : digits_end + 1] == " ":
                    found += [(*m.span(), "address") for m in GERMAN_CODE.finditer(flat, max(0, start - 120), min(len(flat), end + 60))]
        elif kind == "identity":
            if flat[start - 1 : start].isascii() and flat[start - 1 : start].isalpha():
                continue
            m = CUED.match(flat, end)
            if m and sum(c.isdigit() for c in m.group(1)) >= 6:
                found.append((*m.span(1), "id_number"))
        elif kind == "street" and start > seen_street and ANY_DIGIT.search(flat, max(0, start - BEFORE_STREET), start):
            for m in (CAPITALS if everywhere else ENGLISH).finditer(flat, max(0, start - BEFORE_STREET), min(len(flat), end + 24)):
                found.append((*m.span(), "address"))
                seen_street = m.end()
        elif kind == "german" and flat[end : end + 1].isdigit():
            for m in GERMAN.finditer(flat, max(0, start - BEFORE_STREET), min(len(flat), end + 30)):
                found.append((*m.span(), "address"))
        elif kind == "french":
            for m in FRENCH.finditer(flat, max(0, start - 12), min(len(flat), end + 60)):
                found.append((*m.span(), "address"))
        elif kind == "han_street":
            for m in CHINESE.finditer(flat, max(0, start - 40), min(len(flat), end + 20)):
                led = [x.end() for x in LEADS_TO.finditer(m.group())]
                found.append((m.start() + (led[-1] if led else 0), m.end(), "address"))
        elif kind == "title":
            if start and (flat[start - 1].isalnum() and flat[start - 1].isascii() or flat[start - 1] in "-.'"):
                continue
            m = TITLE.match(flat, end)
            if m and _good_name([m.group(1)]) and not (flat[start] in "dD" and re.search(rf"\d ?[A-Za-z]?,? (?:{WORD} )+$", flat[max(0, start - 60) : start])):
                found.append((start, m.end(1), "name"))
        elif kind == "intro":
            if start and flat[start - 1].isalpha() and flat[start - 1].isascii():
                continue
            m = INTRODUCED.match(flat, end)
            if m and _good_name(re.split(r"[ ,]+", m.group(1))) and (lower[start:end] not in ("laut", "selon", "name:", "contact:", "according to") or FOLLOWED.match(flat, m.end()) or flat[m.end() : m.end() + 1] in ",.;:("):
                found.append((*m.span(1), "name"))
        elif kind == "person":
            m = None if start and flat[start - 1].isalpha() else PERSON.match(flat, end)
            if m and _good_name(words := m.group(1).split(" ")) and not any(w.lower().strip(".") in NO_PERSON for w in words):
                found.append((*m.span(1), "name"))
        elif kind == "given":
            if start and (flat[start - 1].isalpha() and flat[start - 1].isascii() or flat[start - 1] in "-'.\x00") or not flat[start].isupper() or (end < len(flat) and flat[end].isalpha() and flat[end].isascii()):
                continue
            m = GIVEN_FIRST.match(flat, start)
            if m and _good_name([m.group(2)]):
                found.append((*m.span(), "name"))
                continue
            before = FAMILY_FIRST.search(flat[max(0, start - 40) : start])
            if before and _good_name([before.group(1)]):
                found.append((start - len(before.group()), end, "name"))
        elif kind == "han":
            m = HAN_AFTER.match(flat, end)
            if m:
                found.append((*m.span(1), "name"))
        elif kind == "han_title":
            before = flat[max(0, start - 30) : start]
            m = HAN_TITLED.search(before) or LATIN_TITLED.search(before)
            if m and "或" not in flat[end : end + 1]:
                found.append((start - len(m.group(1)), start, "name"))
    return found


def find_mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each mention in ``text``, in order and without overlaps; none in null and empty text."""
    if not text:
        return []
    flat, places = flatten(text)
    found = _mentions(flat)
    if places is not None:
        found = [(places[a], places[b - 1] + 1, k) for a, b, k in found]
    rank = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str]] = []  # in order of place, without overlaps
    for a, b, k in sorted(set(found), key=lambda f: (rank[f[2]], f[0], -f[1])):
        at = bisect_left(taken, (a, b, k))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            insort(taken, (a, b, k))
    return taken


def mask(text: str | None) -> str | None:
    """``text`` with a placeholder of its type for each mention, the rest as it is; null stays null."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, k in find_mentions(text):
        parts += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*parts, text[at:]])


def _mask_frames(columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{c: [mask(t) for t in frame[c]] for c in columns})

    return run


def redact(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named text columns masked; rows, other columns and their order stay as they are."""
    return df.mapInPandas(_mask_frames(list(columns)), df.schema)


def _list_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(s, i, f, k, a, b) for s, i, f, t in frame[["src", "row_id", "field", "text"]].itertuples(index=False) for a, b, k in find_mentions(t)]
        yield pd.DataFrame(rows, columns=["src", "row_id", "field", "kind", "start", "stop"])


def list_mentions(texts: DataFrame) -> DataFrame:
    """Of rows (src, row_id, field, text): one row per mention, with its kind and its place in the text.

    Null and empty texts have none; repeated rows repeat theirs; an empty table gives an empty result.
    """
    return texts.select("src", "row_id", "field", "text").mapInPandas(_list_frames, "src string, row_id bigint, field string, kind string, start int, stop int")
