"""Text of scanned pages made into continuous paragraphs.

1. Furniture. Lines are compared over the pages of their file: one that comes back on several of them is a running
   header or footer, whatever number it carries and whichever characters were misread in it; a line that only gives a
   page number is one too. Lines are reduced to counts per file before they are joined.
2. Edges. All words of the corpus are counted, and neighbours too. Joins of word types give what a stretch of text may
   stand for, each with the price of a noisy channel, -log of its frequency and of the error's odds: a spelling for a
   word from which the usual confusions lead to it, or for two words that ran together; neighbours for one torn word; a
   word divided at a line's end for its two forms; and two errors at once. What costs more than leaving the stretch as it
   is could be on no cheapest path and is left out. No list of words is held by any worker: they hold a bitmap of fixed
   size, of the edges' hashes, which tells the texts' places worth a look.
3. Decoding. Each text's lines, without its furniture, become one stream of characters. Around each such place a window
   of neighbouring words, over blanks and line ends, is joined with its edges, and the cheapest sequence of words over
   its characters is found. What is put right there goes into the text again.
4. Paragraphs. The cheapest set of boundaries, by dynamic programming over the lines.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import cut_lineage, spread

#: What recognisers take for what (read, meant).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("|", "l"), ("!", "i"), ("$", "s"), ("+", "t"), ("€", "e"),
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("h", "b"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("d", "cl"), ("h", "li"), ("b", "h"), ("w", "vv"), ("u", "ii"), ("u", "n"), ("n", "u"), ("f", "t"), ("t", "f"), ("t", "l"), ("o", "c"), ("a", "o"),
)
#: How much more often the right word has to occur than the misread one, where the letters alone would do as a word.
TIMES_LETTERS, TIMES_DIGITS = 20, 2
#: The same for a word torn by a blank or a line's end one of whose parts is a word of its own.
TIMES_TORN = 100
#: Least share of a file's pages on which a header stands, and least number of pages.
HEADER_SHARE, HEADER_PAGES = 0.15, 2
#: Bits of the bitmap that tells which surfaces have edges: 4 MB, whatever the corpus' size. Fuller, it lets more pass that have none.
FILTER_BITS = 1 << 25
#: Words longer than this are compared by their halves, as all their variants would take room by the square of it.
BY_HALVES = 64

HYPHENS = "-‐¬­‑"
ROMAN = r"[A-Za-zÀ-ɏ0-9|!$+€]"
BROKEN = re.compile(rf"(?<![^\W_])([A-Za-zÀ-ɏ]{ROMAN}*(?:['’-]{ROMAN}+)*|{ROMAN}+)[{HYPHENS}]$")
HEAD = re.compile(rf"^({ROMAN}+(?:['’-]{ROMAN}+)*)")
#: Neighbouring words of letters, kept apart by one blank or a line's end.
PAIR = re.compile(r"(?<![\w'’|!$+€.@/-])([A-Za-zÀ-ɏ]+)(?=([ \n])([A-Za-zÀ-ɏ]+)(?![\w'’|$+€@/-]))")
#: Its two parts, in what stands between blanks or line ends.
PAIR_TAIL, PAIR_HEAD = re.compile(r"(?<![\w'’|!$+€.@/-])([A-Za-zÀ-ɏ]+)\Z"), re.compile(r"([A-Za-zÀ-ɏ]+)(?![\w'’|$+€@/-])")
#: Words that are right though both of their parts often stand side by side.
ALSO_TWO = frozenset(
    "maybe everyday anyone anybody anything anyway anymore anytime everyone everybody everything someone somebody something somehow someday sometime sometimes somewhat nobody nothing cannot into onto upon within without "
    "already always altogether also almost although another about above across abroad away awhile along alike aside ahead apart around alone again aloud whoever whatever whenever wherever however whereas whereby therefore thereby therein thereof "
    "indeed instead inside outside overall today tomorrow together before because become himself herself itself themselves yourself myself nevertheless nonetheless "
    "daran damit dabei davon dafür danach dazu darin daraus darauf darüber darum darunter hierzu hierbei wobei womit woran sodass sofern soweit sowie solange zudem zumal zurzeit zuerst zunächst anstatt aufgrund infolge inwieweit indem nachdem seitdem trotzdem vorher "
    "bientôt aussitôt plutôt surtout partout toujours quelquefois puisque lorsque parfois enfin ensuite afin davantage dedans dehors malgré pourquoi".split()
)
TOKEN = re.compile(r"(?:[^\W_]|[+$€](?=[^\W\d_]))(?:[^\s,;:()\[\]\"“”„»«<>=/—–…。，：；！？、（）?]*[^\W_]|)(?:(?<=[^\W\d_])[+](?![^\W_]))?")
WORD_LIKE = re.compile(r"^[A-Za-zÀ-ÿ0-9|!$+€]+(?:['’-][A-Za-zÀ-ÿ0-9|!$+€]+)*$")
LETTERS = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*$")
#: Spellings with a digit that are no misread words: numbers with units, codes, forms.
CODE = re.compile(r"^(?:[0-9]+[a-z]{0,2}|[a-z][0-9]+|[a-z]{1,4}-?[0-9][0-9-]+|[0-9][0-9.,/:-]*|v[0-9][0-9.]*|[0-9-]+[a-z]?)$")
SECTION = r"^(?:[0-9]{1,3}(?:[.][0-9]{1,3})*[.)] |#|Part \w+[.:]|Teil \w+[.:]|Partie \w+|第[一二三四五六七八九十百0-9]+[部章节]|[(（]?[0-9]+[)）、]|[-*•] )"
NUMBER_LINE = re.compile(
    r"[-–—~·•\[\](){}|.:=*_<>#\s]*(?:(?:page|pages|pag[.]?|pg[.]?|p[.]?|seite|s[.]|blatt|folio|página|no[.]?|nr[.]?|第)\s*)?"
    r"(?:[0-9][0-9OoIl]{0,4}|[OoIl][0-9][0-9OoIl]{0,3}|m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
    r"\s*(?:页|頁)?\s*[,，]?\s*(?:(?:/|of|von|sur|de|out of|共|of the|\|)\s*[0-9][0-9OoIl]{0,4}\s*(?:页|頁)?)?[-–—~·•\[\](){}|.:=*_<>#\s]*$",
    re.IGNORECASE,
)
ITEM_NUMBER = re.compile(r"[0-9]+[.)]$")
#: Marks and words at a line's end, in the middle of a sentence.
GOING_ON = frozenset(".。!?！？;；,，、:：")
WORDS_GOING_ON = frozenset("der die das den dem des ist auf nach für von in im und wenn beginnt the of than for and to a an within is are by with after le la les de du pour dans est et".split())
SECTION_RE = re.compile(SECTION)
#: First characters of what ``SECTION`` matches; characters that end a paragraph, and what may follow them.
SECTION_STARTS, ENDS, QUOTES = frozenset("0123456789#PT第(（-*•"), frozenset(".!?。！？:："), frozenset("'\"”’)）")
ENGLISH = frozenset("the of is for and to if in must within are be by after under any as".split())
GERMAN = frozenset("der die das und ist für den dem nach nicht wenn kann muss ab wird werden".split())


#: A page's number within a line, with the number of all pages perhaps.
PAGE_OF = re.compile(r"(?:\b(?:pages?|seite|blatt|folio|página|pag[.]?|pg[.]?|p[.]|s[.])\s*|第\s*)[0-9]{1,4}(?:\s*[页頁])?(?:\s*(?:/|of|von|sur|de|out of|共)\s*[0-9]{1,4}(?:\s*[页頁])?)?(?![0-9.])|(?<![0-9./])[0-9]{1,4}\s*(?:/| of | von | sur )\s*[0-9]{1,4}$", re.IGNORECASE)
DIGIT, NOT_WORD = re.compile("[0-9]"), re.compile(r"\W")
OUTER_NUMBER = re.compile(r"^[\[(]?[0-9]{1,4}[\])]?(?=[^\w.)]|_)|(?<=[\W_])[\[(]?[0-9]{1,4}[\])]?$")
YEAR = re.compile(r"(?<=[\W_])(?:19|20)[0-9]{2}$")
ALIKE, ALIKE_DIGITS = tuple(zip("|!i", "lll", strict=True)), tuple(zip("015968", "olsgbb", strict=True))


class Remembered(dict):
    """Answers about stretches of text, worked out once for each; ``shrink`` forgets them when they get many.

    Long stretches are never kept, and those without an answer only if they are no whole line of Han text.
    """

    LONGEST, LONGEST_EMPTY, MOST = 64, 24, 200_000

    def __init__(self, answer: Callable[[str], object]) -> None:
        super().__init__()
        self.answer = answer

    def __missing__(self, stretch: str):
        value = self.answer(stretch)
        if len(stretch) <= (self.LONGEST if value else self.LONGEST_EMPTY):
            self[stretch] = value
        return value

    def shrink(self) -> None:
        if len(self) > self.MOST:
            self.clear()


def split_lines(text: str) -> list[str]:
    """Lines of a text, whichever mark ends them."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    for mark in "\x0c\x0b\u2028\u2029":
        if mark in text:
            text = text.replace(mark, "\n")
    return text.split("\n")


def without_page(line: str) -> str:
    """A line with its page's number taken out."""
    return PAGE_OF.sub("#", line) if DIGIT.search(line) else line


def header_form(line: str, bare: str | None = None) -> str:
    """A line's form for comparison: its page's number and a number at either end dropped, look-alike characters made one, blanks and marks gone.

    ``bare`` is the line without its page's number, if it is known.
    """
    line = line.strip()
    text = (without_page(line) if bare is None else bare).strip().lower()
    if DIGIT.search(line):
        # A year belongs to the title; only a number that changes from page to page is dropped, so years come back.
        year = YEAR.search(line)
        text = OUTER_NUMBER.sub("#", text) + (year.group() if year else "")
        for read, meant in ALIKE_DIGITS:
            text = text.replace(read, meant)
    for read, meant in ALIKE:
        text = text.replace(read, meant)
    text = text.replace("rn", "m").replace("vv", "w").replace("c", "e")
    return text if text.isalnum() else "".join(filter(str.isalnum, text))


def is_unfinished(line: str) -> bool:
    """Whether a line ends, or begins, in the middle of a sentence."""
    if not line or line[-1] in GOING_ON or line[0].islower():
        return True
    words = line.rsplit(" ", 2)
    last = words[-2] if len(words) > 1 and words[-1].isdigit() else words[-1]
    return last in WORDS_GOING_ON or NOT_WORD.split(last)[-1] in WORDS_GOING_ON


#: First small letters of what ``PAGE_OF`` takes out.
PAGE_STARTS = frozenset("bfpsſ")


def _bare(line: str) -> str | None:
    """A line without its page's number, if it then neither ends nor begins in the middle of a sentence; a page's number never ends in a mark of ``GOING_ON``."""
    if line[-1] in GOING_ON or line[0].islower() and line[0] not in PAGE_STARTS:
        return None
    bare = without_page(line)
    return None if is_unfinished(bare) else bare


#: Lines from a page's top or bottom within which headers stand; longest number of a page, marks around it aside, that ``NUMBER_LINE`` knows.
EDGE, SHORT = 4, 32
#: Lines from a page's top or bottom within which a line that only ever stands there is a header on however few pages.
OUTER = 2
#: Marks at the ends of lines that give a page's number.
RULE = "-–—~·•[](){}|.:=*_<># "


def _mere(line: str) -> str | None:
    """'page_number' or 'marks' for a line that is nothing else."""
    if len(line) > SHORT and len(line.strip(RULE)) > SHORT:
        return None
    if not any(map(str.isalnum, line)):
        return "marks"
    return "page_number" if NUMBER_LINE.match(line) and not ITEM_NUMBER.match(line) else None


#: Whether a line that begins like this can be one of them.
_may_be_mere = Remembered(lambda first: not first.isalnum() or MERE_START.match(first) is not None)
MERE_START = re.compile("[0-9OoIlmdcxvpsbfn第页頁共]", re.IGNORECASE)


LINE = "result_id bigint, file_id bigint, page_no int, line_no int, item string, edge boolean, kind string, goes_on boolean, form string"


def _emit_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines that are 'page_number' or 'marks', and those that can be headers (kind 'line', with their form).

    The latter stand at the top or bottom of a page; in texts of several pages, or of an unknown number, anywhere.
    """
    for frame in frames:
        rows = []
        for result, file, page, pages, text in zip(frame["result_id"], frame["file_id"], frame["page_no"], frame["pages"], frame["text"], strict=True):
            lines = [(k, x) for k, y in enumerate(split_lines(text)) if (x := y.strip(" \t\u00a0\u3000"))]
            mere = [_mere(x) if _may_be_mere[x[0]] and (len(x) <= SHORT or x[0] in RULE or x[-1] in RULE) else None for _, x in lines]
            one, anywhere, n = pages == 1, not pages <= 1, len(lines)
            rows += [(result, file, page, k, x, None, m, None, None) for (k, x), m in zip(lines, mere, strict=True) if m]
            if file != file:
                continue
            for at in range(n) if anywhere or n <= 2 * EDGE else (*range(EDGE), *range(n - EDGE, n)):
                k, x = lines[at]
                if not mere[at] and x[-1] not in GOING_ON and (bare := _bare(x)) is not None and not (x[0] in SECTION_STARTS and SECTION_RE.match(x)):
                    after = next((y for (_, y), m in zip(lines[at + 1 : at + 1 + EDGE], mere[at + 1 : at + 1 + EDGE], strict=True) if not m), "")
                    form = header_form(x, None if x[0].isspace() or x[-1].isspace() else bare)
                    rows.append((result, file, page, k, x, one and (at < OUTER or at >= n - OUTER), "line", GOES_ON.match(after) is not None and after.lstrip("0123456789 ")[:1].islower(), form))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")]).astype({"file_id": "Int64", "page_no": "Int32", "edge": "boolean", "goes_on": "boolean"})


#: A line's beginning where a sentence may go on: at once, or after a number.
GOES_ON = re.compile(r"(?:[0-9]+ )?[^\W\d_]")


def furniture(pages: DataFrame) -> DataFrame:
    """Rows (result_id, line_no, kind, item): lines that are a 'header', a 'page_number' or mere 'marks'.

    A header comes back on two pages or more of its file, and either on at least 15 % of them or nowhere but at the top
    or bottom; lines that end as sentences do, titles and section lines are none. Runs stored twice count as one page. Rows without a file have no
    headers.
    """
    lines = cut_lineage(pages.select("result_id", "file_id", "page_no", "pages", "text").mapInPandas(_emit_lines, LINE))
    forms = lines.where("kind = 'line' and length(form) >= 3")
    per_run = forms.groupBy("file_id", "form", "page_no", "result_id").agg(F.count(F.lit(1)).alias("n"), F.min("goes_on").alias("goes_on"), F.min("edge").alias("edge"))
    per_page = per_run.groupBy("file_id", "form", "page_no").agg(F.max("n").alias("n"), F.min("goes_on").alias("goes_on"), F.min("edge").alias("edge"))
    # A line of the running text goes on in small letters wherever it stands.
    repeats = per_page.groupBy("file_id", "form").agg(F.sum("n").alias("n"), F.min("goes_on").alias("goes_on"), F.min("edge").alias("edge")).where("not goes_on")
    sizes = pages.where("file_id is not null").groupBy("file_id", "page_no").agg(F.max(F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))).alias("pages")).groupBy("file_id").agg(F.sum("pages").alias("of_file"))
    known = repeats.where(F.col("n") >= HEADER_PAGES).join(sizes, "file_id").where(F.col("edge") | (F.col("n") >= HEADER_SHARE * F.col("of_file"))).select("file_id", "form")
    heads = forms.join(known, ["file_id", "form"], "left_semi").select("result_id", "line_no", F.lit("header").alias("kind"), "item")
    rest = lines.where("kind <> 'line'").select("result_id", "line_no", "kind", "item")
    return heads.unionByName(rest)


#: English words of a stretch between blanks, and German ones times ``_MANY``.
_MANY = 1 << 40
_tongues = Remembered(lambda chunk: sum((t in ENGLISH) + (t in GERMAN) * _MANY for t in LOW_WORD.findall(chunk.lower())))
LOW_WORD = re.compile("[a-zäöüß]+")


def _language(text: str) -> str:
    de, en = divmod(sum(map(_tongues.__getitem__, text.split())), _MANY)
    _tongues.shrink()
    return "de" if de > en else "en" if en else "other"


def _stream(text: str, drop: set[int]) -> list[tuple[int, str]]:
    """Lines that belong to the running text."""
    return [(k, x) for k, x in enumerate(split_lines(text)) if k not in drop and x and not x.isspace()]


def _chunks(running: str) -> list[str]:
    """What stands between single blanks and line ends; neither words nor parts of neighbours reach over them."""
    return running.replace("\n", " ").split(" ")


def _divided(left: str, right: str) -> bool:
    """Whether two parts can be one word of letters, a misread one perhaps; codes and numbers aren't."""
    if left.isalpha() and right.isalpha():
        return True
    return not CODE.match(left.lower()) and not CODE.match(right.lower()) and sum(c.isalpha() for c in left + right) > sum(c.isdigit() for c in left + right) * 2


def _division(line: str, after: str) -> tuple[re.Match, re.Match] | None:
    """The parts of a word divided between two lines without blanks around them."""
    if line[-1:] not in HYPHENS:
        return None
    tail, head = BROKEN.search(line, line.rfind(" ") + 1), HEAD.match(after)
    return (tail, head) if tail and head and _divided(tail.group(1), head.group(1)) else None


def _broken(lines: list[tuple[int, str]]) -> list[tuple[str, str, bool]]:
    """Words divided at the lines' ends: both parts, and whether the mark can only be that of a division."""
    found = ((line, _division(line, after)) for (_, line), (_, after) in zip(lines, lines[1:], strict=False) if line[-1] in HYPHENS)
    return [(d[0].group(1), d[1].group(1), line[-1] != "-") for line, d in found if d]


class Counts:
    """Words and neighbours of texts, counted by the chunks they stand in: each chunk is taken apart once, its number stands for it."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers = Remembered(self._number)
        self.parts: dict[str, int] = {}
        self.words: list[list[str]] = []
        self.tails, self.heads = [], []
        self.of_chunk = np.zeros(0, dtype=np.int64)
        self.pairs: Counter[int] = Counter()
        self._add([], None, None)  # number 0: nothing to be counted

    def __len__(self) -> int:
        return len(self.numbers) + len(self.words) + len(self.pairs)

    def _add(self, words: list[str], tail: re.Match | None, head: re.Match | None) -> int:
        self.words.append(words)
        for part, to in ((tail, self.tails), (head, self.heads)):
            to.append(self.parts.setdefault(part.group(1), len(self.parts)) if part else -1)
        return len(self.words) - 1

    def _number(self, chunk: str) -> int:
        words = [t for t in TOKEN.findall(chunk) if WORD_LIKE.match(t.rstrip(".").lower())]
        tail, head = PAIR_TAIL.search(chunk), PAIR_HEAD.match(chunk)
        return self._add(words, tail, head) if words or tail or head else 0

    def add(self, streams: list[str]) -> None:
        """Counts streams; no neighbours stand on two of them."""
        number = self.numbers.__getitem__
        each = [x for r in streams for x in (np.fromiter(map(number, _chunks(r)), dtype=np.int64), [0])]
        if not each:
            return
        at = np.concatenate(each, dtype=np.int64)
        self.of_chunk = np.bincount(at, minlength=len(self.words)) + np.pad(self.of_chunk, (0, len(self.words) - len(self.of_chunk)))
        left, right = np.array(self.tails)[at[:-1]], np.array(self.heads)[at[1:]]
        both = (left >= 0) & (right >= 0)
        codes, n = np.unique((left[both] << 32) | right[both], return_counts=True)
        for code, k in zip(codes.tolist(), n.tolist(), strict=True):
            self.pairs[code] += k

    def by_word(self) -> Counter[str]:
        out: Counter[str] = Counter()
        for words, n in zip(self.words, self.of_chunk.tolist(), strict=False):
            for word in words:
                out[word] += n
        return out

    def by_pair(self) -> Iterator[tuple[str, str, int]]:
        parts = list(self.parts)
        return ((parts[code >> 32], parts[code & 0xFFFFFFFF], n) for code, n in self.pairs.items())


def _emit_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words, broken words, neighbours and header words of a partition with their counts, let go whenever they get many."""
    counts = Counts()
    broken: Counter[tuple[str, str, bool]] = Counter()
    heads_: Counter[str] = Counter()

    def flush() -> pd.DataFrame:
        rows: Counter[tuple] = Counter()
        words, of_heads = counts.by_word(), Counter()
        for (a, b, _), n in broken.items():
            words[a] -= n
            words[b] -= n
        for head, n in heads_.items():
            for token in TOKEN.findall(head):
                of_heads[token] += n
        for sort, counter in (("word", words), ("head", of_heads)):
            for token, n in counter.items():
                small = token.rstrip(".").lower()
                if n > 0 and WORD_LIKE.match(small):
                    rows[sort, small, None, sort == "word" and token[:1].isupper()] += n
        for (a, b, soft), n in broken.items():
            rows["soft" if soft else "hard", a, b, False] += n
        for a, b, n in counts.by_pair():
            rows["pair", a.lower(), b.lower(), b[:1].isupper()] += n
        for counter in (counts, broken, heads_):
            counter.clear()
        return pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["sort", "a", "b", "cased", "n"])

    for frame in frames:
        streams = []
        for text, drop, heads in zip(frame["text"], frame["drop"], frame["heads"], strict=True):
            lines = [(k, x.strip()) for k, x in _stream(text, set(drop))]
            streams.append("\n".join([x for _, x in lines]))
            broken.update(_broken(lines))
            heads_.update(heads)
        counts.add(streams)
        if len(counts) + len(broken) + len(heads_) > 200_000:
            yield flush()
    yield flush()


#: What each odd character may mean, and the confusions among letters.
MEANS = {r: "".join(m for x, m in CONFUSIONS if x == r) for r, _ in CONFUSIONS if not r.isalpha()}
AMONG = [(r, m) for r, m in CONFUSIONS if r.isalpha()]
#: Characters that are taken for each other made one, so that spellings and words can be joined: odd ones as what they mean, i as l.
FOLDED = str.maketrans({"i": "l", **{c: "l" if m[0] == "i" else m[0] for c, m in MEANS.items()}})


def _is(read: str, meant: str) -> bool:
    return read == meant or meant in MEANS.get(read, "")


def explains(spelling: str, word: str) -> bool:
    """Whether ``spelling`` may be ``word`` misread: odd characters may be many, confusions among letters one at most."""
    if spelling == word:
        return False
    n, grown = len(spelling), len(word) - len(spelling)
    left = next((k for k, (x, y) in enumerate(zip(spelling, word, strict=False)) if not _is(x, y)), min(n, len(word)))
    if left == n and not grown:
        return True
    right = next((k for k, (x, y) in enumerate(zip(reversed(spelling), reversed(word), strict=False)) if not _is(x, y)), min(n, len(word)))
    for read, meant in AMONG:
        if len(meant) - len(read) == grown:
            for at in range(max(0, n - right - len(read)), min(left, n - len(read)) + 1):
                if word.startswith(meant, at) and all(map(_is, spelling[at : at + len(read)], read)):
                    return True
    return False


def _halves(folded: str, length: int) -> list[str]:
    cut = length // 2
    return [f"{length}<{folded[:cut]}", f"{length}>{folded[len(folded) - (length - cut) :]}"]


def keys(spelling: str) -> list[str]:
    """Keys under which the words are found that explain ``spelling``; a word's own are those of ``word_keys``."""
    folded = spelling.translate(FOLDED)
    if len(folded) > BY_HALVES:  # one confusion leaves one half as it is; words may be longer or shorter by one
        return sorted({k for n in (-1, 0, 1) for k in _halves(folded, len(folded) + n)})
    out = {folded}
    for read, meant in AMONG:
        read, meant = read.translate(FOLDED), meant.translate(FOLDED)
        at = folded.find(read)
        while at >= 0:
            out.add(folded[:at] + meant + folded[at + len(read) :])
            at = folded.find(read, at + 1)
    return sorted(out)


def word_keys(word: str) -> list[str]:
    folded = word.translate(FOLDED)
    return [folded, *_halves(folded, len(folded))] if len(folded) >= BY_HALVES else [folded]


_keys = F.pandas_udf(lambda words: words.map(keys), T.ArrayType(T.StringType()))
_word_keys = F.pandas_udf(lambda words: words.map(word_keys), T.ArrayType(T.StringType()))
_explains = F.pandas_udf(lambda a, b: pd.Series([explains(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), T.BooleanType())


def _price(count: Column, times: Column | float = 1.0) -> Column:
    """-log of a frequency, but for the size of the corpus, and of an error's odds of one in ``times``."""
    return F.log(F.lit(1.0) * times / count)


def misreadings(asked: DataFrame, good: DataFrame) -> DataFrame:
    """Rows (spelling, n, word, seen, proper, times) of what each of ``asked`` (spelling, n) may be misread from.

    A word counts from its third occurrence on, and if it is ``times`` as frequent as the spelling at least.
    """
    by_key = good.where("seen >= 3").withColumn("key", F.explode(_word_keys("word")))
    times = F.when(F.col("spelling").rlike(r"[0-9|!$+€]"), F.lit(float(TIMES_DIGITS))).otherwise(float(TIMES_LETTERS))
    met = asked.withColumn("key", F.explode(_keys("spelling"))).join(by_key, "key").where("word <> spelling").withColumn("times", times).where("seen >= times * n")
    return met.drop("key").distinct().where(_explains("spelling", "word"))


def _cuts(column: str) -> Column:
    """All divisions of a word of letters into two parts."""
    return F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.struct(F.substring(F.col(column), F.lit(1), i).alias("a"), F.substring(F.col(column), i + 1, F.length(column)).alias("b")))


EDGE_COLUMNS = ("surface", "word", "cost", "own", "hyphen", "misread")


def _edge(df: DataFrame, surface: Column, word: Column, cost: Column, own: Column | None = None, hyphen: bool = False, misread: Column | None = None) -> DataFrame:
    no = F.lit(False)
    return df.select(surface.alias("surface"), word.alias("word"), cost.alias("cost"), (F.lit(None).cast("double") if own is None else own).alias("own"), F.lit(hyphen).alias("hyphen"), (no if misread is None else misread).alias("misread"))


def run_together(pieces: DataFrame, types: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of words that ran together: the parts stand side by side ``TIMES_LETTERS`` times as often as the spelling stands at all.

    One of the letters may be misread besides, at the same odds again. A spelling that cleaner texts have is a word.
    """
    frequent = pairs.where(F.col("n") >= TIMES_LETTERS).select("a", "b", "n")
    reach = frequent.agg(F.max(F.length("a") + F.length("b"))).first()[0] or 0  # nothing longer can be two of them
    rare = types.where(F.col("word").rlike(r"^\p{L}{4,}$") & (F.col("clean") == 0) & ~F.col("word").isin(sorted(ALSO_TWO))).select("word", F.col("n").alias("own"))
    rare = rare.where(F.length("word") <= reach + 1)
    spelled = rare.select("word", "own", F.col("word").alias("as_read"), F.lit(float(TIMES_LETTERS)).alias("times"))
    misspelled = rare.withColumn("as_read", F.explode(_readings("word"))).select("word", "own", "as_read", F.lit(float(TIMES_LETTERS**2)).alias("times"))
    cuts = spelled.unionByName(misspelled).select("word", "own", "times", F.explode(_cuts("as_read")).alias("c")).select("word", "own", "times", "c.*").where("length(b) >= 2 and (length(a) >= 2 or a = 'a')")
    found = cuts.join(frequent, ["a", "b"]).where(F.col("n") >= F.col("times") * F.col("own"))
    return _edge(found, F.col("word"), F.concat_ws(" ", "a", "b"), _price(F.col("n"), F.col("times")), _price(F.col("own")))


def one_misread(word: str) -> list[str]:
    """All spellings from which one confusion among letters leads to ``word``."""
    out = {word[:at] + meant + word[at + len(read) :] for read, meant in AMONG for at in range(len(word)) if word.startswith(read, at)}
    return sorted(out - {word})


_readings = F.pandas_udf(lambda words: words.map(one_misread), T.ArrayType(T.StringType()))


def torn(types: DataFrame, pairs: DataFrame, good: DataFrame) -> DataFrame:
    """Edges of neighbours that are one torn word: it is much more frequent, and the rarer part mostly stands beside the other one."""
    beside = pairs.where("small > 0 and length(a) >= 2 and length(b) >= 2").withColumn("word", F.concat("a", "b")).join(good.select("word", "seen"), "word").where(F.col("seen") >= TIMES_LETTERS * F.col("small"))
    part = lambda c: types.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"), F.col("clean").alias(f"clean_{c}"))
    rarer, clean = F.least("n_a", "n_b"), F.when(F.col("n_a") <= F.col("n_b"), F.col("clean_a")).otherwise(F.col("clean_b"))
    alone = F.greatest("n_a", "n_b") * TIMES_LETTERS <= F.col("seen")
    weighed = beside.join(part("a"), "a").join(part("b"), "b").withColumn("rarer", rarer).withColumn("times", F.when(alone, float(TIMES_LETTERS)).otherwise(float(TIMES_TORN)))
    likely = weighed.where((clean == 0) & (2 * F.col("small") >= F.col("rarer")) & (F.col("seen") >= F.col("times") * F.col("rarer")))
    surface = F.concat_ws(" ", "a", "b")
    either = F.explode(F.array(F.struct(F.col("word").alias("as"), _price(F.col("seen"), F.col("times")).alias("cost")), F.struct(surface.alias("as"), _price(F.col("rarer")).alias("cost"))))
    return _edge(likely.withColumn("e", either), surface, F.col("e.as"), F.col("e.cost"))


def edges(pieces: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Rows (surface, word, cost, own, hyphen, misread): what a spelling, a broken word ('a-' and 'b' on two lines) or two neighbours ('a b') may stand for.

    ``own`` is the price of the spelling as it is. ``pieces`` as from the texts; ``extra`` may add the words of cleaner
    texts as rows (word, n, small). Each join is between word types; counts are added up before they are shuffled.
    """
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    counted = pieces.where("sort in ('word', 'head')").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"), of(~F.col("cased") & (F.col("sort") == "word")).alias("small"), of(F.col("sort") == "head").alias("heads"), F.lit(0).cast("bigint").alias("clean"))
    if extra is not None:
        counted = counted.unionByName(extra.select("word", "n", "small", F.lit(0).cast("bigint").alias("heads"), F.col("n").alias("clean"))).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "small", "heads", "clean")])
    types = cut_lineage(counted)
    pairs = cut_lineage(pieces.where("sort = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n"), of(~F.col("cased")).alias("small")))
    # A word that the running text never writes small, and that isn't mostly the headers', is a proper name.
    proper = (F.col("small") == 0) & (F.col("n") >= 2 * F.col("heads"))
    good = types.where(F.col("word").rlike(r"^[\p{L}'’-]+$")).select("word", F.col("n").alias("seen"), proper.alias("proper"))
    halves = pieces.where("sort in ('hard', 'soft')").groupBy(F.lower("a").alias("a"), F.lower("b").alias("b")).agg(F.sum("n").alias("n"), F.max(F.col("b").rlike(r"^\p{Lu}") & F.col("a").rlike(r"\p{Ll}$")).alias("name"))
    both = F.explode(F.array(F.struct(F.concat("a", "b").alias("form"), F.lit(False).alias("kept")), F.struct(F.concat_ws("-", "a", "b").alias("form"), F.lit(True).alias("kept"))))
    seen = halves.withColumn("f", both).select("a", "b", "n", "name", "f.*").join(good.select(F.col("word").alias("form"), "seen"), "form", "left")
    # A form that stands nowhere else is priced by the broken word's own count; of forms alike the mark goes, unless a name follows it.
    rather = F.when(F.col("name") == F.col("kept"), 1.0).otherwise(1.001)
    rejoined = cut_lineage(seen.select(F.concat_ws("-\n", "a", "b").alias("surface"), F.col("form").alias("word"), "kept", "n", F.coalesce("seen", F.lit(0)).alias("seen"), _price(F.coalesce(F.col("seen").cast("double"), F.lit(0.5)), rather).alias("cost")))
    unknown = rejoined.groupBy("surface").agg(F.max("seen").alias("most"), F.max("n").alias("n"), F.max(F.when(~F.col("kept"), F.col("word"))).alias("spelling")).where("most = 0").select("spelling", "n")
    # Spellings to be explained: types, and rejoined words that the corpus doesn't know.
    asked = types.select(F.col("word").alias("spelling"), "n").unionByName(unknown).groupBy("spelling").agg(F.max("n").alias("n"))
    asked = asked.where(F.col("spelling").rlike(r"^[\p{L}0-9|!$+€'’-]+$") & F.col("spelling").rlike(r"\p{L}") & (F.length("spelling") >= 3) & ~F.col("spelling").rlike(CODE.pattern))
    meant = cut_lineage(misreadings(asked, good))
    alone = _edge(meant, F.col("spelling"), F.col("word"), _price(F.col("seen"), F.col("times")), _price(F.col("n")), False, ~F.col("proper"))
    divided = _edge(rejoined, F.col("surface"), F.col("word"), F.col("cost"), None, True)
    mended = rejoined.select("surface", F.col("word").alias("spelling")).join(meant, "spelling")
    misdivided = _edge(mended, F.col("surface"), F.col("word"), _price(F.col("seen"), F.col("times")), None, True, ~F.col("proper"))
    return alone.unionByName(divided).unionByName(misdivided).unionByName(run_together(pieces, types, pairs)).unionByName(torn(types, pairs, good))


def surface_filter(surfaces: DataFrame) -> bytes:
    """A bitmap of the hashes of the column ``surface``, put together by Spark; its size is fixed, so it may go to every worker."""
    at = surfaces.select(F.pmod(F.crc32(F.col("surface").cast("binary")), F.lit(FILTER_BITS)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        out[r["word"]] = r["bits"]
    return out.tobytes()


def passes(bits: bytes, surface: str) -> bool:
    at = zlib.crc32(surface.encode()) % FILTER_BITS
    return bits[at >> 3] >> (at & 7) & 1 == 1


WINDOW = "result_id bigint, at int, window string, form string, english boolean, surfaces array<string>"


class Seen(Remembered):
    """What of a chunk may have edges, by the bitmap: its tokens (start, surface) that do, and its last word if it may begin an edge over the next word; None if nothing does."""

    def __init__(self, bits: bytes) -> None:
        super().__init__(self._look)
        self.bits = bits

    def _look(self, chunk: str) -> tuple[list[tuple[int, str]], str | None] | None:
        tokens = [(m.start(), m.group().rstrip(".")) for m in TOKEN.finditer(lowered(chunk))]
        alone = [(at, token) for at, token in tokens if passes(self.bits, token)]
        tail = PAIR_TAIL.search(chunk)
        left = tail.group(1) if tail and passes(self.bits, f"{tail.group(1).lower()} ") else None
        return (alone, left) if alone or left else None


def _places(lines: list[tuple[int, str]], running: str, low: str, seen: Seen) -> tuple[list[tuple[int, int, str]], list[int]]:
    """Stretches (start, end, surface) of the stream that may have edges, and where a line's end may divide a word without a mark."""
    out: list[tuple[int, int, str]] = []
    joints: list[int] = []
    breaks: list[bool] | None = None
    chunks = _chunks(running)
    found = list(map(seen.__getitem__, chunks))
    if any(found):
        stops = list(accumulate(map(len, chunks)))
        for k in compress(range(len(chunks)), found):
            alone, left = found[k]
            stop = stops[k] + k  # so many blanks and line ends stand before the chunk
            out += [(stop - len(chunks[k]) + at, stop - len(chunks[k]) + at + len(token), token) for at, token in alone]
            head = PAIR_HEAD.match(chunks[k + 1]) if left and k + 1 < len(chunks) and chunks[k + 1][:1].islower() else None
            if head and passes(seen.bits, surface := f"{left} {head.group(1)}".lower()):
                if running[stop] == "\n":
                    breaks = breaks or paragraph_breaks(lines, max(len(x) for _, x in lines))
                    if breaks[running.count("\n", 0, stop + 1)]:
                        continue
                    joints.append(stop)
                out.append((stop - len(left), stop + 1 + head.end(1), surface))
    at = 0
    for (_, line), (_, after) in zip(lines, lines[1:], strict=False):
        end = at + len(line)
        if line[-1:] in HYPHENS and (parts := _division(line, after)):
            tail, head = parts
            first, last = at + tail.start(1), end + 1 + head.end(1)
            out.append((first, last, f"{low[first : at + tail.end(1)]}-\n{low[end + 1 : last]}"))
        at = end + 1
    return out, joints


def _windows(running: str, low: str, places: list[tuple[int, int, str]], joints: list[int]) -> Iterator[tuple[int, str, str, list[str]]]:
    """(start, window, its form, surfaces): each stretch with a neighbour on either side, those that touch taken together.

    In the form, letters are small, a mark of division is '-' and a line's end that may divide a word is a blank.
    """
    spans: list[list] = []
    for a, b, surface in sorted(places):
        start, stop = _beside(running, a, b)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
            spans[-1][2].append((a, b, surface))
        else:
            spans.append([start, stop, [(a, b, surface)]])
    for start, stop, own in spans:
        form = list(low[start:stop])
        for at in joints:
            if start <= at < stop:
                form[at - start] = " "
        for a, b, surface in own:
            if "\n" in surface:
                form[a - start : b - start] = surface
        yield start, running[start:stop], "".join(form), sorted({x for _, _, x in own})


#: How far a window reaches beside a stretch; it may begin or end within a longer neighbour.
BESIDE = 200


def _beside(running: str, a: int, b: int) -> tuple[int, int]:
    """A stretch with what touches it and the words before and after."""
    low, high = max(0, a - BESIDE), min(len(running), b + BESIDE)
    for more in (0, 1):
        if a > low:
            blank = max(running.rfind(" ", low, a - more), low - 1)
            a = max(running.rfind("\n", blank + 1, a - more), blank) + 1
        if b < high:
            blank = running.find(" ", b + more, high)
            blank = high if blank < 0 else blank
            line = running.find("\n", b + more, blank)
            b = blank if line < 0 else line
    return a, b


def _emit_windows(shared):
    """Windows of each text, and of its headers (at -1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen(shared.value)
        for frame in frames:
            rows = []
            for result, text, drop, heads in zip(frame["result_id"], frame["text"], frame["drop"], frame["heads"], strict=True):
                tongue: list[bool] = []
                for n, lines in enumerate(([(k, x.strip()) for k, x in _stream(text, set(drop))], *([(0, h)] for h in heads))):
                    running = "\n".join([x for _, x in lines])
                    low = lowered(running)
                    places, joints = _places(lines, running, low, seen)
                    if places:
                        tongue = tongue or [_language(text) == "en"]
                        rows += [(result, -1 if n else a, w, f, tongue[0], s) for a, w, f, s in _windows(running, low, places, joints)]
                seen.shrink()
            yield pd.DataFrame(rows, columns=["result_id", "at", "window", "form", "english", "surfaces"])

    return run


def lowered(text: str) -> str:
    """``text`` in small letters, none of which takes more than one place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: What a character costs that belongs to no word, and a word of which nothing is known; dearer than any edge.
UNCOVERED, UNKNOWN = 100.0, 1.0


def decode_window(form: str, readings: dict[str, list[tuple[str, float, bool, bool]]], own: dict[str, float] | None = None) -> list[tuple[int, int, str, bool, bool]]:
    """Cheapest sequence of words over a stream of characters: what is to be put right, as (start, end, word, hyphen, misread).

    ``readings`` maps a surface to its words with their prices; ``own`` has the prices of spellings as they are. Words
    begin and end where those of the stream do, unless an edge leads over a blank or a line's end. A spelling that only
    edges over neighbours know stands for itself at ``UNKNOWN``; a mark of division has to be read somehow.
    """
    own, n = own or {}, len(form)
    cost: list[float] = [0.0] + [math.inf] * n
    back: list[tuple | None] = [None] * (n + 1)
    spans = {m.start(): m.start() + len(m.group().rstrip(".")) for m in TOKEN.finditer(form)}
    for surface in readings:
        if "\n" in surface:  # a mark of division is no part of the tokens beside it
            at = form.find(surface)
            while at >= 0:
                spans.setdefault(at, at + surface.index("\n") - 1)
                at = form.find(surface, at + 1)
    ends = set(spans.values())
    by_size = sorted({len(x) for x in readings})

    for i in range(n):
        here = cost[i]
        if here == math.inf:
            continue
        end = spans.get(i)
        if end is None:
            price = here + UNCOVERED if form.startswith("-\n", i) else here
            if price < cost[i + 1] - 1e-9:
                cost[i + 1], back[i + 1] = price, None
            continue
        for size in by_size:
            j = i + size
            if j <= n and (j in ends or j == n or not form[j].isalnum()):
                for word, price, hyphen, misread in readings.get(form[i:j], ()):
                    if here + price < cost[j] - 1e-9:
                        cost[j], back[j] = here + price, (i, word, hyphen, misread)
        price = here + own.get(form[i:end], UNKNOWN)
        if price < cost[end] - 1e-9:
            cost[end], back[end] = price, (i, None, False, False)
    out, j = [], n
    while j:
        if (how := back[j]) is None:  # a character that belongs to no word
            j -= 1
            continue
        i, word, hyphen, misread = how
        if word is not None and word != form[i:j]:
            out.append((i, j, word, hyphen, misread))
        j = i
    return out[::-1]


#: A blank or line's end, with the mark of a division perhaps, and with it.
JOINT, DIVISION, ANY_BLANK = re.compile(rf"[{HYPHENS}]?\s"), re.compile(rf"[{HYPHENS}]\s"), re.compile(r"\s")


def _as(word: str, like: str) -> str:
    """``word`` in the case of ``like``."""
    for letters in (JOINT.sub("", like), DIVISION.sub("-", like)) if ANY_BLANK.search(like) else (like,):
        if word.replace(" ", "") == letters.lower():  # ran together, torn or divided: the letters stay as they are
            at = word.find(" ")
            return letters if at < 0 else f"{letters[:at]} {letters[at:]}"
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() or (like[:1].isdigit() and len(letters) > 1 and letters[0].isupper()) else word


FIXES = "array<struct<start:int,stop:int,text:string,kinds:array<string>,item:string>>"


def _decode_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows with their edges decoded: what is to be put right, by its place in the text's stream (-1 in headers)."""
    for frame in frames:
        rows = []
        for result, at, window, form, english, edges_ in zip(frame["result_id"], frame["at"], frame["window"], frame["form"], frame["english"], frame["edges"], strict=True):
            readings: dict[str, list] = {}
            own: dict[str, float] = {}
            # No price is below that of a word that is as frequent as anything can be, so all may be raised by it.
            for e in sorted(edges_, key=lambda e: (e["surface"], e["cost"], e["word"])):
                readings.setdefault(e["surface"], []).append((e["word"], e["cost"] + RAISED, e["hyphen"], e["misread"]))
                if e["own"] is not None:
                    own[e["surface"]] = e["own"] + RAISED + 1e-6
            parts = {p for x in readings if " " in x for p in x.split(" ")}
            own |= {p: RAISED for p in parts if p not in own}
            fixes = []
            for i, j, word, hyphen, misread in decode_window(form, readings, own):
                like = window[i:j]
                kinds = [k for k, yes in (("hyphen", (hyphen or "\n" in like) and at >= 0), ("misread", misread and english)) if yes]
                fixes.append({"start": at + i if at >= 0 else -1, "stop": at + j, "text": _as(word, like), "kinds": kinds, "item": word})
            if fixes:
                rows.append((result, fixes))
        yield pd.DataFrame(rows, columns=["result_id", "fixes"])


#: -log of the frequency of a word is taken but for the corpus' size, so it may be below 0; e^40 words are more than any corpus has.
RAISED = 40.0


HAN = re.compile(r"[㐀-鿿]")
HAN_BLANKS = re.compile(r"(?<=[㐀-鿿，。：；、（）])[ \t]+(?=[㐀-鿿，。：；、（）0-9A-Za-z])|(?<=[0-9A-Za-z])[ \t]+(?=[㐀-鿿，。：；、（）])")
HAN_SIGN = re.compile(r"[㐀-鿿，。：；、（）]")
HAN_NEXT = re.compile(r"[㐀-鿿，。：；、（）0-9A-Za-z]")
BLANKS, GAPS = re.compile(r"[ \t]{2,}"), re.compile(r" ?\n{2,} ?")


def paragraph_breaks(lines: list[tuple[int, str]], width: int) -> list[bool]:
    """Whether a paragraph begins at each line: the cheapest choice, with a price for short paragraphs, by dynamic programming."""
    n = len(lines)
    if not n:
        return []
    texts = [x for _, x in lines]
    sections = [x[:1] in SECTION_STARTS and SECTION_RE.match(x) is not None for x in texts]
    ended = [x[-1:] in ENDS or x[-1:] in QUOTES and x[-2:-1] in ENDS for x in texts]
    joined, split = 0.0, 0.0  # cheapest ways in which the line before is joined to its own, or begins a paragraph
    ways: list[tuple[int, int]] = [(0, 0)]
    for k in range(1, n):
        gap, line, short = lines[k][0] - lines[k - 1][0] > 1, texts[k], len(texts[k - 1]) < 0.75 * width
        ends, heading = ended[k - 1], sections[k - 1] and not ended[k - 1]
        begins = sections[k] or line[:1].isupper() or not line[:1].isascii()
        split_cost = 1.0 + (0 if gap else 1.5) + (0 if ends or heading else 3.0) + (0 if begins else 2.0) + (0 if short or ends else 1.0)
        join_cost = (2.5 if gap and ends else 0.5 if gap else 0) + (3.0 if sections[k] else 0) + (3.0 if heading else 0) + (1.5 if ends and short else 0)
        to_join, to_split = int(split < joined), int(split + 0.3 < joined)
        joined, split = min(joined, split) + join_cost, min(joined, split + 0.3) + split_cost
        ways.append((to_join, to_split))
    out, state = [False] * n, int(n > 1 and split < joined)
    for k in range(n - 1, 0, -1):
        out[k] = bool(state)
        state = ways[k][state]
    out[0] = True
    return out


def assemble(text: str, drop: set[int], fixes: list[tuple[int, int, str]]) -> str:
    """The text as paragraphs, without the lines ``drop``, and with ``fixes`` (start, stop, text; places of its stream) put in."""
    lines = [(k, x.strip()) for k, x in _stream(text, drop)]
    breaks = paragraph_breaks(lines, max((len(x) for _, x in lines), default=1))
    running = "\n".join([x for _, x in lines])
    has_han = HAN.search(text) is not None
    parts: list[str] = []
    at, done, pending = 0, 0, sorted(fixes)[::-1]
    for n, (_, body) in enumerate(lines):
        end = at + len(body)
        if n and done <= at - 1:
            if breaks[n]:
                parts.append("\n\n")
            else:
                last = next((p[-2:] for p in reversed(parts) if p), "")
                code = last[-1:] == "-" and last[:1].isalnum() and body[:1].isdigit() or has_han and body[:1] == "-"
                han = has_han and (HAN_SIGN.match(last[-1:]) and HAN_NEXT.match(body) or HAN_SIGN.match(body) and HAN_NEXT.match(last[-1:]))
                parts.append("" if code or han else " ")
        done = max(done, at)
        while pending and pending[-1][0] < end:
            start, stop, fixed = pending.pop()
            parts += [running[done:start], fixed]
            done = stop
        if done < end:
            parts.append(HAN_BLANKS.sub("", running[done:end]) if has_han else running[done:end])
            done = end
        at = end + 1
    return GAPS.sub("\n\n", BLANKS.sub(" ", "".join(parts))).strip()


def _assemble_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        done = [assemble(t, set(d), [(f["start"], f["stop"], f["text"]) for f in fixes]) for t, d, fixes in zip(frame["text"], frame["drop"], frame["fixes"], strict=True)]
        yield pd.DataFrame({"result_id": frame["result_id"], "repaired": done})


@dataclass
class Repair:
    """Scanned texts with their furniture (result_id, line_no, kind, item), and what is to be put right (result_id, fixes), a row for each window."""

    texts: DataFrame
    marks: DataFrame
    fixes: DataFrame

    def paragraphs(self) -> DataFrame:
        """Rows (result_id, repaired): each text as continuous paragraphs; null and empty texts have none."""
        per_text = self.fixes.select("result_id", F.explode("fixes").alias("f")).where("f.start >= 0").groupBy("result_id").agg(F.collect_list("f").alias("fixes"))
        joined = self.texts.join(per_text, "result_id", "left").withColumn("fixes", F.coalesce("fixes", F.array().cast(FIXES)))
        return joined.mapInPandas(_assemble_frames, "result_id bigint, repaired string")

    def noise(self) -> DataFrame:
        """Rows (result_id, kind, item) of everything that is put right or taken out, each once."""
        put = self.fixes.select("result_id", F.explode("fixes").alias("f")).select("result_id", F.explode("f.kinds").alias("kind"), "f.item")
        return put.unionByName(self.marks.where("kind <> 'marks'").select("result_id", "kind", "item")).distinct()


def repair_pages(pages: DataFrame, words: DataFrame | None = None) -> Repair:
    """The repair of rows (result_id, file_id, page_no, pages, text).

    Null and empty texts stay out of it. Texts stored twice are repaired alike. ``words`` may add rows (word, n, small) of
    cleaner texts to the counts. Whole texts are decoded, however long; an empty table gives empty results.
    """
    kept = spread(pages).select(F.col("result_id").cast("bigint").alias("result_id"), F.col("file_id").cast("bigint").alias("file_id"), "page_no", "pages", F.col("text").cast("string").alias("text")).where("result_id is not null and text is not null and trim(text) <> ''")
    marks = cut_lineage(furniture(kept))
    per_row = marks.groupBy("result_id").agg(F.collect_list("line_no").alias("drop"), F.collect_list(F.when(F.col("kind") == "header", F.col("item"))).alias("heads"))
    empty = lambda kind: F.array().cast(kind)
    texts = cut_lineage(kept.join(per_row, "result_id", "left").select("result_id", "text", F.coalesce("drop", empty("array<int>")).alias("drop"), F.coalesce("heads", empty("array<string>")).alias("heads")))
    pieces = cut_lineage(texts.mapInPandas(_emit_pieces, "sort string, a string, b string, cased boolean, n bigint"))
    known = cut_lineage(edges(pieces, words))
    lefts = known.where("surface like '% %'").select(F.concat(F.substring_index("surface", " ", 1), F.lit(" ")).alias("surface"))
    bits = surface_filter(known.select("surface").unionByName(lefts))
    windows = texts.mapInPandas(_emit_windows(pages.sparkSession.sparkContext.broadcast(bits)), WINDOW).withColumn("place", F.monotonically_increasing_id())
    asked = windows.withColumn("surface", F.explode("surfaces")).drop("surfaces")
    met = asked.join(known, "surface").groupBy("place").agg(*[F.first(c).alias(c) for c in ("result_id", "at", "window", "form", "english")], F.collect_list(F.struct(*EDGE_COLUMNS)).alias("edges"))
    return Repair(texts, marks, met.mapInPandas(_decode_frames, f"result_id bigint, fixes {FIXES}"))


CLEAN_WORD = re.compile(r"[A-Za-z\u00c0-\u024f]+(?:['’-][A-Za-z\u00c0-\u024f]+)*")


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chunks: Counter[str] = Counter()  # no word reaches over a blank, so each chunk is taken apart once

    def flush() -> pd.DataFrame:
        words: Counter[str] = Counter()
        for chunk, n in chunks.items():
            for word in CLEAN_WORD.findall(chunk):
                words[word] += n
        chunks.clear()
        return pd.DataFrame([(w.lower(), n, n if w[:1].islower() else 0) for w, n in words.items()], columns=["word", "n", "small"])

    for frame in frames:
        for text in frame["text"]:
            chunks.update(text.split())
        if len(chunks) > 200_000:
            yield flush()
    yield flush()


def clean_words(texts: Column, df: DataFrame) -> DataFrame:
    """Rows (word, n, small) of ordinary texts, for ``repair_pages``; ``small`` counts the word with a small first letter."""
    counted = df.select(texts.cast("string").alias("text")).where("text is not null").mapInPandas(_count_words, "word string, n bigint, small bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))
