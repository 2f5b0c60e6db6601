"""Abusive, hateful and sexually explicit language, by weak supervision.

Many voters look at each sentence: lexicons of several languages (as written, and through disguises such as digits for
letters, stars, single letters kept apart), patterns of threats, of abuse and of degraded groups, and voters for what
only looks like it (clinical terms, rules that quote such words, technical use). Each voter either fires or abstains, so
with V voters there are at most 2^V patterns of votes; Spark counts them over all sentences.

A generative label model is fitted to the counts by expectation maximisation: a sentence that is accused is toxic, or
clean for one of the reasons that the excusing voters stand for; each of these classes has its share, each voter its
rate in each class. Nothing but where it begins is set. What voters have in common is taken from them by the
correlation of each pair within the classes. How many toxic sentences no voter sees follows from the rates, as in
counts by capture and recapture.

The posteriors label a bounded sample of sentences for a linear classifier on the sentences' own words, without the
votes, so it learns what voters don't know; a sentence's score is drawn from both, and every sentence of every text is
scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage, spread

#: Distinct sentences that the classifier is trained on, at most: those with a vote for toxic, and others; their longest.
TRAIN_VOTED, TRAIN_OTHER, LONGEST = 20_000, 20_000, 2_000
#: Features of the classifier at most, and rounds of training.
FEATURES, ROUNDS = 200_000, 10
#: Share of the classifier in a score; the posterior of the votes has the rest.
CLASSIFIER_SHARE = 0.6
#: From this score on a document counts as toxic.
THRESHOLD = 0.5

#: Insults, as single words, in English.
INSULTS = (
    "idiot moron imbecile cretin bastard bitch asshole arsehole scumbag shithead dickhead dumbass retard slut whore pig cunt wanker prick twat jackass bullshit motherfucker fucker douchebag "
    "dipshit dumbfuck skank hoe faggot fag nigger spic kike chink tranny loser trash scum vermin filth bimbo tosser git bellend shitbag asswipe pisshead cocksucker fuckface tramp halfwit dimwit nitwit simpleton degenerate lowlife pervert"
).split()
#: Of these, words that are too common elsewhere to count unless someone is addressed.
MILD = frozenset("pig trash loser filth git hoe tramp vermin scum pervert degenerate prick chink".split())
#: Insults in German and French.
INSULTS_DE = "arschloch wichser hurensohn vollidiot idiot trottel schlampe fotze drecksau dreckskerl missgeburt fresse hure spast spasti mistkerl scheißkerl schwuchtel untermensch ungeziefer pack abschaum nutte vollpfosten depp".split()
INSULTS_FR = "connard connasse salope salaud enculé pute putain ordure abruti crétin débile bâtard pétasse gueule merde trouduc bouffon sous-merde pédé raclure vermine".split()
#: Insults and threats in Chinese.
INSULTS_ZH = "傻逼 傻b 煞笔 沙雕 s b sb 蠢货 蠢猪 白痴 废物 贱人 贱货 骚货 婊子 滚蛋 滚出去 滚开 混蛋 王八蛋 狗东西 垃圾东西 人渣 畜生 杂种 脑残 智障 脑子进水 去死 去你妈 操你 他妈的 你妈 不要脸 神经病 死全家 浪费空气 下贱 寄生虫".split(" ")
THREATS_ZH = "打断你 弄死你 杀了你 砍死 打死你 找人打 去死 死全家 让你好看 剁了你 捅死".split()
SEXUAL_EN = (
    "porn porno porns xxx blowjob handjob pussy dick cock tits boobs nude nudes naked horny cum cumshot orgasm escort escorts hooker milf threesome fuck fucking fucked anal hardcore uncensored sexting dildo masturbate masturbating jerk erotic webcam stripper strip striptease creampie gangbang"
).split()
SEXUAL_ZH = "裸照 裸聊 裸体 色情 约炮 叫床 无码 一丝不挂 包夜 激情上门 援交 做爱 口交 少妇 成人片 成人无码 春药 骚 发骚 嫖 卖淫 自慰 情色 黄片 肉棒 阴道 阳具".split()
SEXUAL_DE = "porno pornos nacktbilder nackt nacktfotos geile geil ficken fick blasen muschi schwanz titten sexfilme altersprüfung wichsen".split()

LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e"})
BOUNDS = re.compile(r"[\W_]")
ZERO_WIDTH = re.compile("[­​-‏⁠﻿]")
FULL_WIDTH = re.compile("[Ａ-Ｚａ-ｚ]")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ ._\-*·])[^\W\d_])(?:\1[^\W\d_]){1,}(?:s{1,2}\b)?(?![^\W_])")
REPEAT = re.compile(r"([^\W\d_])\1{2,}")
STARRED = re.compile(r"(?<![^\W_])([a-z])(\*{1,})([a-z]{1,3})(?![^\W_])")
MIXED = re.compile(r"(?<![^\W_])(?=[^\s]*[a-z])(?=[^\s]*[0-9@$!+€])[a-z0-9@$!+€]{3,}(?![^\W_])|[@$][a-z0-9@$!+€]{2,}")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CJK = re.compile("[一-鿿]")
SPLIT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|[\r\n]+|\s(?=[A-Za-z]{2,12}: )")
RUN_ON = re.compile(r"(?<=[a-zäöüéèàß]) (?=[A-ZÄÖÜÉ][\w']* \w)")
GLUED = re.compile(r"[!?](?=[一-鿿]|[A-Za-z]{2,12}: )|[一-鿿](?=[A-Za-z]{2,12}: )")
SPEAKER = re.compile(r"^\s*(?:[-*>#|]+\s*)?(?:[A-Za-z]{1,12}|[一-鿿]{1,4})\s?[:：]\s+")


def _word_pattern(words: list[str]) -> re.Pattern:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?:e?s{1,2}|en|n)?(?![^\W_])")


STRONG_RE = _word_pattern([w for w in INSULTS if w not in MILD])
MILD_RE = _word_pattern(sorted(MILD))
DE_RE, FR_RE = _word_pattern(INSULTS_DE), _word_pattern(INSULTS_FR)
SEX_RE, SEX_DE_RE = _word_pattern(SEXUAL_EN), _word_pattern(SEXUAL_DE)
BY_SHAPE = {}
for _w in INSULTS:
    BY_SHAPE.setdefault((_w[0], _w[-1], len(_w)), _w)

ADDRESS_EN = re.compile(
    r"\byou(?:'re| are)? (?:people|useless|worthless|pathetic|stupid|dumb|filthy|disgusting|ugly|lying|brainless|little|are too|are nothing|disgust|sick|all )|\byour (?:mother|mouth|hole|face|whole \w+(?: \w+)? (?:team|department) is)|\b(?:shut|hole|hey,?) (?:up|your|you)|\bstop whining|\bwho should rot"
    r"|\bbunch of\b|\bcrawl back|\bbrainless|\b(?:lying|worthless|useless|brainless) [a-z]+ (?:who|like you|and everyone)|\ba [a-z]+ like you|\ba (?:" + "|".join(INSULTS) + r") (?:who|and everyone)|\bonly an? [a-z@$*]+ would|\bkind of [a-z@$*]+ writes"
)
WISH_EN = re.compile(r"\brot in hell|\bwaste of (?:space|skin|air)|\bashamed to be alive|\bnobody (?:asked|would miss|likes|wants) you|\bgo (?:drown|kill|hang|hurt) yourself|\bkill yourself|\bhope you (?:die|choke|suffer|rot|get)")
ADDRESS_OTHER = re.compile(
    r"\bdu (?:bist|nutzlos|dumm|elend|erbärmlich|geile|wichser|idiot)|\bdu [a-zäöüß]+es? stück|\bhalt (?:die|dein)|\bverpiss|\bwie dir\b|\bstück (?:müll|dreck|scheiße)|\bso ein dreck|\btu es (?:une?|un vrai)|\bespèce de|\bferme ta|\bta gueule|\bnique ta|\bva te faire|\bva crever"
    r"|你(?:就是|是|们这|这|那副|妈|个)[^，。！]{0,6}(?:逼|货|物|痴|玩意|东西|蛋|人渣|狗|猪|b)|闭嘴|滚(?:出去|开|蛋|远)|脑子进水|活着就是|说话吗|一群(?:" + "|".join(w for w in INSULTS_ZH if len(w) > 1 and w != "sb") + ")"
)
THREAT_EN = re.compile(
    r"\b(?:break|smash|bash|cut|slit|punch|stab|burn|shoot|kick) (?:your|you|their|his|her|them)\b|\bmake (?:you|them|him|her) (?:suffer|pay|bleed|regret)|\b(?:i|we)(?:'ll| will| am going to|'m going to) (?:kill|hurt|find|beat|destroy|end|get|make) (?:you|them|him|her)|\bjumped off|\bdrown yourself|\bkill yourself|\bhope you (?:die|choke)|\brot in hell|\bwatch your back|\bbefore i [a-z]+ your|\bbeat you (?:up|to)"
)
THREAT_OTHER = re.compile(r"zähne einschlagen|\bbring(?:e|en)? dich um|\bschlag(?:e|en)? dich|\bmach(?:e|en)? dich (?:kalt|fertig)|va crever|je vais te (?:tuer|frapper|casser|crever)|te casser la|" + "|".join(THREATS_ZH))
PEOPLE = r"(?:[a-zäöüß]{3,}(?:s|men|er|en|ren|ers|ans|ites|ians)|people|immigrants|foreigners|refugees|women|men|jews|muslims|gays|migrants|ausländer|frauen|flüchtlinge|étrangers|immigrés)"
HATE_EN = re.compile(
    rf"\ball {PEOPLE} are (?:vermin|thieves|liars|parasites|rats|animals|criminals|filth|scum|trash|dogs|cockroaches|the same)|\bare born (?:thieves|liars|criminals)|\b(?:they|{PEOPLE}) are (?:vermin|parasites|animals|subhuman|rats|filth|a disease|a plague|less than human)|\bvermin\b|\bparasites\b|\bsubhuman"
    rf"|do(?:es)? not deserve to (?:breathe|live|exist)|same air as us|(?:simply )?disappear(?:ed)? for good|better off if (?:every|all)|\bdriven out|\block them (?:all )?up|\bcarry (?:filth|disease)|\bfilthy {PEOPLE}|\bkeep (?:those|these) [a-z*@$.\-_ 0-9]+ away|\bno {PEOPLE} in this|like (?:[a-z]+ing )?(?:an? )?(?:rats?|animals?|vermin|cockroach(?:es)?|snakes?|lice|maggots?)\b|\bgo back to (?:your|their) (?:country|hole)|\bwipe (?:them|you) out|\bexterminate"
)
HATE_OTHER = re.compile(
    r"gehören (?:verjagt|vergast|weg|abgeschoben|erschossen)|nicht dieselbe luft|mit diesem pack|\bweg mit den\b|\bsind (?:alle )?(?:dreck|abschaum|parasiten|tiere|ungeziefer)|sale race|dehors les|sont tous des (?:voleurs|parasites|rats|animaux)|sont (?:tous )?(?:de la|une) vermine"
    r"|(?:族|人)[^，。]{0,3}(?:天生|都是)[^。]{0,8}(?:小偷|骗子|下贱|寄生虫|垃圾|畜生|贼)|从地球上消失|一个不留|见一个抓一个|全部赶走|不配(?:和|跟|与)?[^，。]{0,6}(?:呼吸|活)|(?:就是|像|如同)[^，。]{0,6}(?:老鼠|蟑螂|蛆|畜生)|滚回(?:去|老家)|劣等|杀光"
)
SEXUAL_PHRASE_EN = re.compile(
    r"\b(?:hot|horny|wet) (?:\w+ ){0,2}(?:singles|girls|women|babes|pussy|milfs|teens|on cam)|\bon cam\b|\bsex (?:show|chat|cam|video|tape|toys)|\bexplicit sex|\badult (?:chat|video|movie|clip|content|site)s?\b|\bno (?:clothes|taboo|limits)\b|\bnudes?\b|\bsee your (?:tits|body|boobs|ass|pussy|dick)|\b(?:blow ?job|porn|xxx|pussy|cum|milf|deepthroat)|\bbeg(?:ging)? me to\b|\bfuck (?:me|you|her|him|my|hard)|\bput it in (?:her|him|me|you)|\bhow hard (?:he|i|she) (?:was|am|is)|\bnaked (?:singles|girls|women|on my|and|in my bed|pics|photos|pictures)|\bof you naked|\bescorts?\b|\bstrip(?:tease|per)"
)
SEXUAL_PHRASE_OTHER = re.compile(r"nackt(?:bilder|fotos)|\bpornos?\b|ohne altersprüfung|\bgeile\b|\bficken\b|photos? (?:de toi )?nue?s?\b|\bphotos nue|\bcoucher avec|\bfilms? (?:x|porno)\b|\bvidéos? (?:x|porno)\b|\bchaudes? (?:salopes?|célibataires)|" + "|".join(SEXUAL_ZH))
CLINICAL = re.compile(
    r"\b(?:examination|examined|dysfunction|fissures?|urologist|gynaecolog|patients?|dose|treated|clinical|diagnos\w*|therapy|syrup|mammogra\w*|prostate|screening|surgery|symptoms?|biopsy|assessment|organic cause|abuse of (?:alcohol|drugs|medication)|substance abuse|alcohol)\b|untersuchung|diagnose|patient|\bexamen du\b|dépistage|médecin|患者|检查|障碍|治疗|诊断|乳腺|剂量"
)
QUOTING = re.compile(
    r"\bforbid|\bprohibit|\bcode of conduct|\bmisconduct|\bethics|\binsults? such as|\bwords? such as|\bcalling (?:a |someone )|\breported to|\bblocks? |\bfilter|\bban(?:s|ned)?\b|\bnot (?:allowed|tolerated|permitted|acceptable)|\bpolicy (?:against|on)|\bviolat|\bverstoß|verhaltenskodex|beleidigung|\bverboten|\buntersagt|\binterdi[ts]|\binsultes?\b|code de conduite|\bsanctionn|属于违纪|辱骂|禁止|不得|违反|通报|行为准则|例如称|严禁"
)
TECHNICAL = re.compile(r"\bprocess\b|\bsignal \d|\brestart|\bindexer|\bserver|\bflame\b|\boxygen\b|\bcockpit\b|\bvalve\b|\bwires?\b|\bwaste (?:bin|collection|water)|进程|重启|索引|服务器|电线|垃圾由|废物桶|废弃物|回收|清空")
BUSINESS = re.compile(r"\bassociation\b|\bcontract\b|\binsured like\b|\bpremiums?\b|\bcovered\b|\breimburs|\bdeductible|versichert|vertrag|contrat|assuré|保障|报销|保险|合同|投保|给付|享受")

ZH_PLAIN = [w for w in INSULTS_ZH if len(w) > 1 and w != "sb"]

POSITIVE = (
    "insult", "disguised", "mild_addressed", "insult_de_fr", "insult_zh", "address", "wish", "address_other", "threat", "threat_other", "hate", "hate_other", "sexual_word", "sexual_word_other", "sexual", "sexual_other",
)
NEGATIVE = ("clinical", "quoting", "technical", "business")
VOTERS = POSITIVE + NEGATIVE


def _joined(match: re.Match) -> str:
    """Single letters kept apart as one word; the words "a" and "I" beside an insult are not part of it."""
    word = re.sub(r"[ ._\-*·]", "", match.group())
    if match.group(1) == " ":
        for i, j in ((1, len(word)), (0, len(word) - 1), (1, len(word) - 1)):
            if {*word[:i], *word[j:]} <= {"a", "i"} and (STRONG_RE.fullmatch(word[i:j]) or MILD_RE.fullmatch(word[i:j])):
                return f"{word[:i]} {word[i:j]} {word[j:]}".strip()
    return word


def plain(sentence: str) -> tuple[str, str]:
    """The sentence in small plain letters, and the same with disguised words opened."""
    base = ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", sentence)).lower().replace("’", "'")
    bare = base
    if SPACED.search(bare):
        bare = SPACED.sub(_joined, bare)
    bare = STARRED.sub(lambda m: BY_SHAPE.get((m.group(1), m.group(3)[-1], len(m.group())), BY_SHAPE.get((m.group(1), m.group(3)[-2:-1], len(m.group()) - 1), m.group())), bare)
    if MIXED.search(bare):
        bare = MIXED.sub(lambda m: m.group().translate(LEET), bare)
    bare = REPEAT.sub(r"\1", bare)
    return base, bare


def _lexicon(text: str, words: list[str]) -> bool:
    return any(w in text for w in words)


#: Pieces of text without which the patterns of abuse, threats, hate and sex can't match.
TRIGGERS = {
    "address": "you|your|hole|hey|shut|whining| rot |bunch of|crawl|brainless|only a|kind of|worthless|lying|useless",
    "wish": " rot |waste of|ashamed|nobody|yourself|hope you",
    "address_other": "bist|du |halt |verpiss|wie dir|stück|dreck|tu es|espèce|ferme|gueule|nique|va te|va crever|你|闭嘴|滚|脑子|活着|说话|一群",
    "threat": "break|smash|bash|cut |slit|punch|stab|burn|shoot|kick|suffer|make |kill|jumped|drown|watch|before i|beat|will |'ll|going to|hope you| rot ",
    "threat_other": "zähne|dich|je vais|casser|va crever",
    "hate": "vermin|thieves|liars|parasit|rats|animals|criminals|filth|scum|trash|dogs|cockroach|the same|subhuman|disease|plague|less than|deserve|same air|disappear|better off|driven out|lock them|carry|keep th|no |like |go back|wipe|exterminate",
    "hate_other": "ungeziefer|gehören|luft|pack|weg mit|abschaum|dreck|parasit|tiere|race|dehors|voleurs|animaux|sont tous|vermine|天生|都是|消失|一个|寄生虫|赶走|不配|老鼠|蟑螂|蛆|畜生|滚回|劣等|杀光",
    "sexual": "hot |horny|wet |on cam|sex|adult|clothes|taboo|limits|nude|see your|job|porn|xxx|pussy| cum|milf|deepthroat| beg|fuck|put it in|how hard|naked|escort|strip|blowjob",
    "sexual_other": "nackt|porno|altersprüfung|geil|ficken| nue| nu | nus |coucher|films|film x|film porno|vidéos|vidéo x|vidéo porno|chaude",
}
#: Fixed lists that are triggers of their voters, word by word.
LISTS = {
    "insult": INSULTS, "mild_addressed": sorted(MILD), "insult_de_fr": [*INSULTS_DE, *INSULTS_FR], "insult_zh": ZH_PLAIN, "address": INSULTS, "threat_other": THREATS_ZH, "sexual_word": SEXUAL_EN, "sexual_word_other": [*SEXUAL_DE, *SEXUAL_ZH], "sexual_other": SEXUAL_ZH,
}
BIT = {v: 1 << k for k, v in enumerate(VOTERS)}


def _triggers() -> ahocorasick.Automaton:
    masks: dict[str, int] = {}
    for voter, word in [*((v, w) for v, ws in TRIGGERS.items() for w in ws.split("|")), *((v, w) for v, ws in LISTS.items() for w in ws)]:
        # Short words begin with a blank, as they are parts of many others; it stands for any mark, as in the text looked at.
        key = BOUNDS.sub(" ", word) if len(word) > 4 or not word.isascii() or BOUNDS.search(word) else f" {word}"
        masks[key] = masks.get(key, 0) | BIT[voter]
    machine = ahocorasick.Automaton()
    for key, mask in masks.items():
        machine.add_word(key, mask)
    machine.make_automaton()
    return machine


TRIGGER = _triggers()
DISGUISE = re.compile(r"\*|[a-z][0-9@$!€+]|[0-9@$!€+][a-z]|([^\W\d_])\1\1|(?<![^\W_])[^\W\d_]([ ._\-·])[^\W\d_]\2[^\W\d_](?![^\W_])")
SB = re.compile(r"(?<![a-z])s ?b(?![a-z])")
EVERY = (1 << len(VOTERS)) - 1


def triggered(base: str) -> int:
    """Bits of the voters that accuse and can fire at all; all marks count as blanks, as words begin after any of them."""
    mask = 0
    for _, bits in TRIGGER.iter(f" {BOUNDS.sub(' ', base)} "):
        mask |= bits
    return mask


PATTERN_VOTERS = {
    "insult_de_fr": (DE_RE, FR_RE), "address": (ADDRESS_EN,), "wish": (WISH_EN,), "address_other": (ADDRESS_OTHER,), "threat": (THREAT_EN,), "threat_other": (THREAT_OTHER,), "hate": (HATE_EN,), "hate_other": (HATE_OTHER,),
    "sexual_word": (SEX_RE,), "sexual": (SEXUAL_PHRASE_EN,), "sexual_other": (SEXUAL_PHRASE_OTHER,),
}
PATTERN_BITS = [(BIT[v], ps) for v, ps in PATTERN_VOTERS.items()]
EXCUSES = [(BIT["clinical"], CLINICAL), (BIT["quoting"], QUOTING), (BIT["technical"], TECHNICAL), (BIT["business"], BUSINESS)]
#: Voters for phrases, not words alone; excuses that don't quote.
PHRASES = sum(BIT[v] for v in ("address", "address_other", "wish", "threat", "threat_other", "hate", "hate_other", "sexual", "sexual_other"))
ASIDE = sum(BIT[v] for v in ("clinical", "technical", "business"))
TOWARDS = sum(BIT[v] for v in ("address", "address_other", "hate", "hate_other", "sexual", "sexual_other"))


def vote(sentence: str) -> tuple[int, str]:
    """Bits of the voters that fire, in the order of ``VOTERS``, and the sentence with disguises opened.

    The voters that excuse are only asked where one accuses. Where a heading without a mark runs on into a sentence
    with a capital ("Deadline for therapy You are ..."), it is no excuse for phrases in that sentence.
    """
    hidden, plain_ascii = False, sentence.isascii()
    if not plain_ascii:
        hidden = ZERO_WIDTH.search(sentence) is not None or FULL_WIDTH.search(sentence) is not None
    base = sentence.lower() if plain_ascii else ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", sentence)).lower().replace("’", "'")
    disguised = hidden or DISGUISE.search(base) is not None
    han = not plain_ascii and CJK.search(base) is not None
    can = EVERY if disguised else triggered(base)
    if not can and not (han and SB.search(base)):
        return 0, base
    bare = plain(sentence)[1] if disguised else base
    bits = sum(bit for bit, patterns in PATTERN_BITS if can & bit and any(p.search(bare) for p in patterns))
    strong = STRONG_RE.search(base) if can & BIT["insult"] else None
    if strong:
        bits |= BIT["insult"]
    if bare != base or hidden:
        opened = STRONG_RE.search(bare) or MILD_RE.search(bare)
        if opened and (hidden or not strong or opened.group() != strong.group()):
            bits |= BIT["disguised"]
    if bits & TOWARDS and can & BIT["mild_addressed"] and MILD_RE.search(bare):
        bits |= BIT["mild_addressed"]
    if han and (_lexicon(bare, ZH_PLAIN) or SB.search(bare)):
        bits |= BIT["insult_zh"]
    if can & BIT["sexual_word_other"] and (SEX_DE_RE.search(bare) or han and _lexicon(bare, SEXUAL_ZH)):
        bits |= BIT["sexual_word_other"]
    if bits:
        bits |= sum(bit for bit, p in EXCUSES if p.search(bare))
    if bits & ASIDE and not bits & BIT["quoting"]:
        for begin in RUN_ON.finditer(sentence):
            own = vote(sentence[begin.end() :])[0]
            if own & PHRASES and not own & ASIDE:
                return own, bare
    return bits, bare


def sentences(text: str | None) -> list[str]:
    """Sentences without speakers' names; one also ends where Han text or a speaker follows its mark, or a speaker Han text, without a blank."""
    return [s for s in (SPEAKER.sub("", x).strip() for x in SPLIT.split(GLUED.sub(r"\g<0>\n", text or ""))) if s]


@dataclass
class LabelModel:
    """Generative model of the votes: log share of each class (the first is toxic), each voter's rate to fire in it, its weight, and what is toxic of the unaccused."""

    shares: np.ndarray
    rates: np.ndarray
    weight: np.ndarray
    unaccused: float

    def classes(self, bits: np.ndarray) -> np.ndarray:
        """Share of each class among sentences with these votes.

        Abstaining from an accusation says nothing, as the voters look for different things; abstaining from an excuse does.
        """
        fired = (bits[:, None] >> np.arange(len(VOTERS))) & 1
        off = np.where(ACCUSES, 0.0, np.log(1 - self.rates))
        odds = self.shares + np.where(fired[:, None, :] == 1, np.log(self.rates), off) @ self.weight
        odds -= odds.max(axis=1, keepdims=True)
        return np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """Share of toxic among sentences with these votes."""
        accused = (bits & sum(BIT[v] for v in POSITIVE)) != 0
        return np.where(accused, self.classes(bits)[:, 0], self.unaccused)


ACCUSES = np.array([v in POSITIVE for v in VOTERS])
#: Accusing voters that only a quote is a reason for, and those that harm done by tools and machines can fire: they are rare
#: in the other clean classes at the beginning, as words of another meaning don't address, threaten or degrade anyone.
STATED = ("address", "address_other", "wish", "threat", "threat_other", "hate_other")
MACHINE = ("threat", "threat_other")
RARE = 0.0005
#: Sentences that the rates at the beginning stand for: so many at least, and this share of the accused, so that a table of any size is judged alike.
WEAK, WEAK_SHARE = 20.0, 1 / 30
#: Rate of each excusing voter in its own class, at least; else a class that hardly any sentence belongs to becomes one of toxic sentences of one kind.
OWN = 0.9


def fit_label_model(bits: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation maximisation on counted patterns of votes.

    Classes are toxic and, for each voter that excuses, clean for its reason; they begin with a high rate of their own
    voter, which stays, and a low one of the accusing voters it is no reason for. Shares and rates are estimated,
    with priors of ``WEAK`` sentences or their share ``WEAK_SHARE``, so that few patterns, or none, leave them near where
    they began. Voters of one side that fire together more than the classes explain share their weight.
    """
    fired = ((bits[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    accused = (fired * ACCUSES).sum(axis=1) > 0
    others, fired, n, own = float(counts[~accused].sum()), fired[accused], counts[accused], bits[accused]
    weak = max(WEAK, WEAK_SHARE * n.sum())
    begin = np.vstack([np.where(ACCUSES, 0.3, 0.02), *[[OWN if v == e else 0.05 if v in NEGATIVE else RARE if e != "quoting" and v in STATED and not (e == "technical" and v in MACHINE) else 0.15 for v in VOTERS] for e in NEGATIVE]])
    least = np.vstack([np.full(len(VOTERS), 1e-4), *[[OWN if v == e else 1e-4 for v in VOTERS] for e in NEGATIVE]])
    part = np.array([0.5, *[0.5 / len(NEGATIVE)] * len(NEGATIVE)])
    model = LabelModel(np.log(part), begin, np.ones(len(VOTERS)), 0.0)
    for _ in range(rounds if len(n) else 0):
        held = n[:, None] * model.classes(own)
        size = held.sum(axis=0)
        rates = np.clip((held.T @ fired + weak * begin) / (size + weak)[:, None], least, 0.99)
        correlation = np.zeros((len(VOTERS),) * 2)
        for k in range(len(size)):
            both, spread_ = (fired.T * held[:, k]) @ fired / max(size[k], 1.0), np.sqrt(rates[k] * (1 - rates[k]))
            correlation += size[k] / size.sum() * np.clip((both - np.outer(rates[k], rates[k])) / np.outer(spread_, spread_), 0, 1)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + (correlation * np.equal.outer(ACCUSES, ACCUSES)).sum(axis=1))
        model = LabelModel(np.log((size + weak * part) / (size.sum() + weak)), rates, weight, 0.0)
    # Toxic sentences that no voter saw, if voters find them independently.
    unseen = float(np.prod(1 - model.rates[0][ACCUSES]))
    toxic = float((n * model.classes(own)[:, 0]).sum()) if len(n) else 0.0
    return LabelModel(model.shares, model.rates, model.weight, min(0.5, toxic * unseen / (1 - unseen) / max(others, 1.0)))


def features(bare: str) -> list[str | tuple[str, str]]:
    """Words, pairs of words and groups of Han characters of a sentence; the constant comes first."""
    tokens = WORDS.findall(bare)
    out: list = ["", *tokens, *zip(tokens, tokens[1:], strict=False)]
    if not bare.isascii():
        out += [t[i : i + n] for t in tokens if CJK.search(t) for n in (2, 3) for i in range(len(t) - n + 1)]
    return out


def train_linear(rows: list[tuple[str, float]], most: int = FEATURES) -> dict[str | tuple[str, str], float]:
    """Weights of a logistic classifier on (sentence, posterior), by adaptive gradient steps on batches in a fixed order.

    The commonest ``most`` features are weighed; the others' weight is 0.
    """
    coded = [set(features(s)) for s, _ in rows]
    seen = Counter(f for own in coded for f in own)
    known = {f: k for k, (f, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], repr(x[0])))[:most])}
    if not known:
        return {}
    at = [np.array(sorted(known[f] for f in own if f in known), dtype=np.int64) for own in coded]
    y = np.array([p for _, p in rows])
    weights, squares, order = np.zeros(len(known)), np.full(len(known), 1e-6), np.random.default_rng(7)
    for _ in range(ROUNDS):
        for batch in np.array_split(order.permutation(len(at)), max(1, len(at) // 32)):
            own = np.concatenate([at[k] for k in batch])
            row = np.repeat(np.arange(len(batch)), [len(at[k]) for k in batch])
            error = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[own], len(batch)), -30, 30))) - y[batch]
            gradient = np.bincount(own, error[row], len(known)) + 1e-5 * weights
            squares += gradient * gradient
            weights -= 0.3 * gradient / np.sqrt(squares)
    return {f: float(w) for f, k in known.items() if abs(w := weights[k]) > 1e-3}


@dataclass
class Classifier:
    labels: LabelModel
    weights: dict[str | tuple[str, str], float]
    posteriors: dict[int, float] = field(default_factory=dict)

    def score(self, sentence: str) -> float:
        bits, bare = vote(sentence)
        linear = math.fsum(filter(None, map(self.weights.get, dict.fromkeys(features(bare)))))
        share = self.posteriors.get(bits)
        if share is None:
            share = self.posteriors[bits] = float(self.labels.posterior(np.array([bits]))[0])
        return CLASSIFIER_SHARE / (1 + math.exp(-max(-30.0, min(30.0, linear)))) + (1 - CLASSIFIER_SHARE) * share


def _voted(rate: float):
    """Counts of the patterns of votes of each batch, all accused sentences, and of the others those whose hash falls under ``rate``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counted: Counter[int] = Counter()
            kept: dict[str, int] = {}
            times: Counter[str] = Counter()
            for s, n in Counter(s for text in frame["text"] for s in sentences(text)).items():  # each sentence of a batch is voted on once
                bits, bare = vote(s)
                counted[bits] += n
                if len(bare) <= LONGEST and (bits or zlib.crc32(bare.encode()) < rate * 2**32):
                    kept[bare] = bits
                    times[bare] += n if bits else 0
            rows = [(None, None, bits, n) for bits, n in counted.items()] + [(s, zlib.crc32(s.encode()), bits, times[s]) for s, bits in kept.items()]
            yield pd.DataFrame(rows, columns=["sentence", "key", "bits", "n"]).astype({"key": "Int64"})

    return run


def fit(docs: DataFrame, text: Column) -> Classifier:
    """Label model from the votes of all sentences of ``docs``, classifier from a bounded sample of distinct ones.

    Of the accused sentences the sample has the most frequent ones, and by their hashes those that are equally frequent:
    they repeat, so a rate that follows from their number would leave out most of them on a large table, and the
    classifier would clear what it never saw. The others are drawn by hash at a rate that follows from the number of
    texts. Accused sentences, each once in a batch, and as many others as the rate lets through are written to the
    shared folder before; no more than the sample is gathered.
    """
    texts = docs.select(text.cast("string").alias("text")).where("text is not null")
    rate = min(1.0, TRAIN_OTHER / max(1, texts.count()))
    voted = cut_lineage(spread(texts).mapInPandas(_voted(rate), "sentence string, key bigint, bits int, n bigint"))
    patterns = voted.where("sentence is null").groupBy("bits").agg(F.sum("n").alias("n")).collect()  # at most 2^len(VOTERS) rows
    labels = fit_label_model(np.array([r.bits for r in patterns], dtype=np.int64), np.array([r.n for r in patterns], dtype=float))

    def sample(part: DataFrame, most: int) -> DataFrame:
        return part.groupBy("key").agg(F.sum("n").alias("n"), F.min("sentence").alias("sentence"), F.min_by("bits", "sentence").alias("bits")).orderBy(F.desc("n"), "key").limit(most)

    spoken = sample(voted.where("bits != 0 and sentence is not null"), TRAIN_VOTED)
    others = sample(voted.where("bits = 0 and sentence is not null"), TRAIN_OTHER)
    rows = [(r.sentence, r.bits) for r in spoken.unionByName(others).select("sentence", "bits").collect()]
    posterior = labels.posterior(np.array([b for _, b in rows], dtype=np.int64)) if rows else []
    return Classifier(labels, train_linear([(s, float(y)) for (s, _), y in zip(rows, posterior, strict=True)]))


def score_documents(docs: DataFrame, doc_id: Column, text: Column, classifier: Classifier) -> DataFrame:
    """Rows (doc_id, score, worst): the highest score of a document's sentences, and that sentence's place from 0.

    Null, empty and blank texts score 0 with worst -1; every sentence counts, however long the text. Repeated rows
    repeat; an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[str, float] = {}
            rows = []
            for doc, body in zip(frame["doc_id"], frame["text"], strict=True):
                best, worst = 0.0, -1
                for k, s in enumerate(sentences(body)):
                    score = known.get(s)
                    if score is None:
                        score = known[s] = classifier.score(s)
                    if score > best:
                        best, worst = score, k
                rows.append((doc, best, worst))
            yield pd.DataFrame(rows, columns=["doc_id", "score", "worst"])

    return spread(docs.select(doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text"))).mapInPandas(run, "doc_id bigint, score double, worst int")


def source_rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, those at or above the threshold, and their share. Null sources form a group of their own."""
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("toxic")).withColumn("rate", F.col("toxic") / F.col("documents"))
