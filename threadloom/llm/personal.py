"""Personal information inside free text.

High-recall generators propose overlapping spans of five types; boosted trees
score each from its format and context; spans over their type's calibrated
threshold are kept, the best of overlapping ones. No list of personal names takes
part: persons are proposed by shape (runs of capitalised words), by cue and by
what stands beside them, and how ordinary their words are is read off the ranks of a
public tokenizer's vocabulary. The trees are trained on labelled
sentences that are composed here, with names made up of random syllables.

Texts are worked on together: one pass of a keyword automaton finds the places
where an address, a spelt-out e-mail address or a named person may be, and the
patterns are tried only there.
"""

from __future__ import annotations

import base64
import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.tokens import VOCABULARY
from threadloom.operators.worker import kept

TYPES = ("email", "phone", "id_number", "address", "person")
#: Labelled sentences that are composed for training, trees and their depth, and bins of a feature.
SENTENCES, TREES, DEPTH, BINS = 9000, 60, 4, 16
#: What a further word of a person's span adds to its score against overlapping spans.
LONGER = 0.5
#: Stands between texts that are worked on together; runes of such a run.
BETWEEN, RUN_RUNES = "\x00", 200_000

S = r"[^\S\n]+"
LETTER = r"[^\W\d_一-鿿]"
JOIN = rf"(?:-|['’](?![sS](?!{LETTER})))"
WORD = rf"{LETTER}+(?:{JOIN}{LETTER}+)*"
CAP = rf"(?:[A-ZÀ-ÞŠŽ]{LETTER}*(?:{JOIN}{LETTER}+)*)"
EDGE, STOP = r"(?<![A-Za-zÀ-ÿ0-9@._/-])", r"(?![A-Za-zÀ-ÿ0-9@])"
DOT, AT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|[^\S\n]+dot[^\S\n]+)", r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?|[^\S\n]+at[^\S\n]+)"
FAR_DOT = r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|[^\S\n]+dot[^\S\n]+)"
ATOM = r"[A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ_%+-]*"
#: What a street is called.
WAYS = "road rd street st avenue ave lane terrace close drive way court place square crescent gardens row mews boulevard".split()
WAY = "(?:" + "|".join(WAYS) + ")"
TOWN = r"(?!(?:please|thanks|bitte|merci|gracias)\b)[^\W\d_][\w'’-]*(?:[^\S\n][^\W\d_][\w'’-]*)?"
CODE = r"(?:[A-Za-z]{1,2}\d{1,2}[A-Za-z]?\s\d[A-Za-z]{2}|[A-Za-z]{2}\s\d{5}|\d{5})"
EMAIL = re.compile(rf"(?i)(?<![\w.+%-]){ATOM}(?:\.{ATOM})*[@＠]{ATOM}(?:\.{ATOM})+")
SPELT = re.compile(rf"(?i)(?<![A-Za-z0-9_.+%-]){ATOM}(?:{DOT}{ATOM})*{AT}{ATOM}(?:{FAR_DOT}{ATOM})+")
PHONE = re.compile(r"(?<![A-Za-z0-9_.@/+-])(?:\+?\(?\d[\d(). \t\xa0‑–/-]{6,20}\d)(?![A-Za-z0-9_@])")
NUMBERS = re.compile(r"\d[\dA-Z ‑–-]{4,}[\dA-Zx]")
ID = re.compile(r"(?<![A-Za-z0-9_.@/+-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|[A-Z]\d{2}[A-Z]\d{5}|\d{8}[A-Z]|[A-Z]{1,2}\d{7}[A-Z]?|\d{3}[ -]\d{2}[ -]\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{17}[\dXx])(?![A-Za-z0-9_@-])")
ADDRESSES = {
    "way": re.compile(rf"(?i)(?<![A-Za-z0-9_.])(?:(?:flat|apt|apartment|unit|suite)\.?\s\w+,\s)?\d{{1,5}}[a-z]?{S}(?:[^\W\d_][\w.'’-]*{S}){{1,4}}?{WAY}\b\.?(?:,\s(?:apt|flat|unit|suite)\.?\s\w+)?(?:(?:,\s|\n){TOWN}(?:,?\s{CODE}(?!\w))|,\s{TOWN}(?=\s*(?:[,.;)，。\n\x00]|$)))?"),
    "rue": re.compile(rf"(?<![A-Za-z0-9_.])\d{{1,4}}(?:{S}(?:bis|ter))?,?{S}(?:[Rr]ue|[Aa]venue|[Pp]lace|[Cc]hemin|[Bb]oulevard)(?:{S}(?:de|du|des|la|le|les|l'|d')){{0,3}}{S}[\w'’-]+(?:{S}[A-ZÀ-Þ][\w'’-]*)?(?:,\s\d{{5}}{S}{CAP})?"),
    "strasse": re.compile(rf"(?:{CAP}{S})?(?:{CAP}(?:straße|strasse|gasse|weg|platz|allee)|{CAP}{S}(?:[Ss]traße|[Ss]trasse|[Gg]asse|[Ww]eg|[Pp]latz)){S}\d{{1,4}}[a-z]?(?:,\s\d{{5}}{S}{CAP})?"),
    "calle": re.compile(rf"(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)(?:{S}(?:de|del|los|las|la|el)){{0,3}}(?:{S}[A-ZÀ-Þ][\w'’-]*){{1,3}}{S}\d{{1,4}}(?:,\s\d{{1,2}}º(?:{S}[A-Z])?)?(?:,\s\d{{5}}{S}{CAP})?"),
    "han": re.compile(r"[一-鿿]{2}市(?:[一-鿿]{1,3}[区县])?[一-鿿]{1,4}[路街道巷]\d+号(?:\d+(?:单元|栋|楼))?(?:\d+室)?"),
}
#: Words that are capitalised for their place (or in German, or as log levels) and are no names on their own; common Chinese surnames.
ORDINARY = frozenset("""
the a an this that these those it its he she they we you i my your our their his her is are was were be been do does did has have had can could will would shall should may might must not no yes and or but if then than so as at by for from in into of on off out over to up with within without
why what when where which who whom whose how please thanks remember next now once after before since until while also only just still already each every all both some any many most few more less other another same new old older later here there line row page step note context plan report
ask call mail cc re fwd tel fax phone name address dear hi hello hey regards sincerely best cheers visit ship reach send ping tell see check run fix add remove update use keep make let try
kb mb gb tb ms info error warn warning debug trace fatal todo fixme utc gmt json http https api url sql csv ok null none true false id ids get put post ssn dni nino
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag
mr mrs ms miss dr prof herr herrn frau monsieur madame mme sr sra señor señora
der die das den dem des ein eine einen einem einer ich du er sie es wir ihr mein meine dein unser und oder aber wenn weil dass nicht nach vor mit von zu bei für auf aus in an um bis warum was wann wo wer wie bitte danke ruf rufe
le la les un une des du de je tu il elle nous vous ils elles mon ma mes notre et ou mais si ne pas pour par avec sans dans sur après avant pourquoi que qui quand où comment merci adresse
el los las unos unas yo tú él ella nosotros ellos mi mis su sus y o pero si no por para con sin en sobre después antes qué quién cuándo dónde cómo gracias vivo
rd st ave flat apt unit suite
""".split())  # fmt: skip
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
DOUBLE = ("欧阳", "上官", "司马", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "端木", "司徒")
#: What stands before a person's name, by kind: an introduction, a header or field, a greeting or signature, a title, a role, a verb of talking, ownership, and words that only may stand there.
CUES = (
    ("name is ", "name's ", "i am ", "i'm ", "this is ", "it's ", "it is ", "llamo ", "nombre es ", "soy ", "appelle ", "nom est ", "heiße ", "name ist ", "called ", "named "),
    ("name: ", "name=", "from: ", "to: ", "cc ", "cc: ", "author: ", "by: ", "contact: ", "assignee: ", "owner: ", "reviewer: ", "attn ", "signed: ", '"name": "', '"name":"', '"contact": "', '"contact":"', '"owner": "', '"owner":"', '"author": "', '"author":"', '"user": "', '"user":"', '"customer": "', '"customer":"'),
    ("dear ", "hi ", "hello ", "regards,\n", "best,\n", "thanks,\n", "cheers,\n", "sincerely,\n", "regards\n", "grüße\n", "grüßen\n", "cordialement,\n", "cordialement\n", "saludos,\n", "saludos\n"),
    ("mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "dr ", "dr. ", "prof. ", "herr ", "herrn ", "frau ", "monsieur ", "madame ", "mme ", "señor ", "señora ", "sr. ", "sra. "),
    ("applicant is ", "applicant ", "patient ", "customer ", "employee ", "passenger ", "tenant ", "colleague ", "manager "),
    ("ask ", "asked ", "tell ", "told ", "mention ", "contact ", "ping ", "call ", "meet ", "met ", "invite ", "thank ", "spoke with ", "spoke to ", "talk to ", "talked to ", "write to ", "remind ", "assigned to ", "gesprochen mit ", "habla con "),
    ("belongs to ", "belong to ", "owned by ", "signed by ", "sent by ", "written by ", "issued to ", "registered to ", "gehört ", "pertenece a ", "appartient à "),
    ("on monday ", "on tuesday ", "on wednesday ", "on thursday ", "on friday ", "on saturday ", "on sunday ", "maybe ", "perhaps ", "yesterday ", "today ", "gestern ", "heute ", "ayer ", "hoy ", "hier ", "both ", "and ", "und ", "et ", "y "),
    ("for ", "with ", "to ", "by ", "from ", "of ", "mit ", "von ", "an ", "con ", "por ", "para ", "avec ", "par ", "de ", "a "),
)
#: The kinds of cues that also point to names in lower case.
POINTING = CUES[:7] + (CUES[7][:13], ("both ", "with ", "by ", "from "))
HAN_CUES = ("我叫", "我是", "联系人", "收件人", "姓名", "名叫", "叫做", "申请人", "负责人", "请找", "联系", "告诉", "通知", "交给", "询问", "作者")
SPELT_CUES = (" at ", "(at", "[at", "{at", "( at", "[ at")
PLACES = {"way": [f" {w}{e}" for w in WAYS for e in (" ", ",", ".", "\n", ")", BETWEEN)], "rue": ["rue ", "avenue ", "place ", "chemin ", "boulevard "], "strasse": ["straße ", "strasse ", "gasse ", "weg ", "platz ", "allee "], "calle": ["calle ", "avenida ", "plaza ", "paseo "], "han": ["市"]}
TOKEN = re.compile(rf"[A-ZÀ-ÞŠŽ]\.|{CAP}")
RUN = re.compile(rf"{EDGE}(?:[A-ZÀ-ÞŠŽ]\.{S})?{CAP}(?:{S}(?:[A-ZÀ-ÞŠŽ]\.(?={S}[A-ZÀ-ÞŠŽ])|{CAP}))*{STOP}")
TURNED = re.compile(rf"{EDGE}{CAP},{S}{CAP}{STOP}")
AFTER_CUE = re.compile(rf"(?:[^\W\d_]\.{S})?{WORD}(?:,?{S}(?:[^\W\d_]\.{S})?{WORD}){{0,2}}")
BEFORE_SPAN = re.compile(rf"(?:^|(?<=[\s,;:\"(>|]))((?:[^\W\d_]\.{S})?{WORD}(?:{S}(?:[^\W\d_]\.{S})?{WORD}){{0,2}})\s?[;,<(:|\"]{{1,3}}$")
AFTER_SPAN = re.compile(rf"\s?[;,>(|\"]{{1,3}}\s?((?:[^\W\d_]\.{S})?{WORD}(?:{S}(?:[^\W\d_]\.{S})?{WORD}){{0,2}})")
HAN_RUN = re.compile(r"[一-鿿]{2,4}")
HAN_ALONE = re.compile(rf"(?<![一-鿿])(?:(?:{'|'.join(DOUBLE)})[一-鿿]{{1,2}}|[{SURNAMES}][一-鿿]{{1,2}})(?![一-鿿])")
#: What shows a person, or a thing, after a name; what stands before names of things.
DEEDS = re.compile(r"\s+(?:wants?|signed|wrote|says?|said|asked|asks|called|calls|opened|knows?|approved|reported|needs?|thinks?|will|has|had|and|is|was|lives?|works?|joined|left|sent|confirmed|requested|hat|ist|möchte|sagt|ha|es|quiere|pide|a|est|veut|demande|about|to)\b", re.I)
THINGS = re.compile(r"\s+(?:theme|service|job|gem|map|parser|server|driver|library|plugin|module|package|protocol|cluster|queue|index|engine|api|release|version|edition|dataset|test|suite|project|repo|branch|avenue|road|street|lane|square|airport|station|river|museum|university|bank|gmbh|inc|ltd|corp|v?\d)", re.I)
ARTICLE = re.compile(r"\b(?:the|an?|this|that|each|every|new|our|your|der|die|das|den|dem|des|ein|eine|einen|einem|einer|im|zur|zum|le|la|les|un|une|du|el|los|las|una|del|in|at|near|via|using|install|restart|upgrade)\s+$", re.I)
OPENING = re.compile(r"(?:^|[.!?。！？:|>\x00]|\n)[\s\W]*$")
HINTS = {
    "id": r"ssn|social|passport|identity|tax|document|ausweis|证件|身份|护照|id\b|form use|dni|nino|license|insurance", "phone": r"phone|tel|call|number|numéro|电话|手机|ring|mobile|erreichbar|fax|cell|text me|sms|dial",
    "place": r"address|living|live|vivo|wohne|adresse|dirección|ship|parcel|visit|寄|地址|住|moved|deliver", "mail": r"mail|reach|write|cc|from|author|delivery|escríb|ou|<|contact|邮", "not": r"isbn|order|invoice|build|epoch|checksum|version|coordinates|offset|commit|request|clone|git|npm|root|listening|section|took|line|lists|pass|limit|exit|code|port|ip|sku|serial|timestamp|hash|ticket|issue|rows?|tokens?",
}
HINT = [re.compile(h) for h in HINTS.values()]
FORMS = [re.compile(p) for p in (r"\d{10}", r"\d{5} \d{3} \d{3}", r"\+\d{2} \d \d{2} \d{2} \d{2} \d{2}", r"\d{3}\.\d{3}\.\d{4}", r"\+\d{2} \d{2} \d{5} \d{3}", r"\d{3}-\d{3}-\d{4}", r"\(\d{3}\) \d{3}[ -]\d{4}", r"\+\d{11,13}", r"\d{3}/\d{7,8}", r"\d{2}( \d{2}){4}", r"\+\d{2} \d{4} \d{6}", r"\+\d \(\d{3}\) \d{3}-\d{4}", r"\d{3} \d{4} \d{4}", r"\+\d[‑-]\d{3}[‑-]\d{3}[‑-]\d{4}", r"1\d{10}", r"\+\d{1,3}( \d{2,4}){3,4}")]


class Lexicon:
    """How ordinary a word is, by the ranks of a public tokenizer's vocabulary (the earlier a word was merged, the more frequent it is)."""

    def __init__(self, path: str):
        self.small: dict[str, int] = {}
        self.capital: dict[str, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                raw = base64.b64decode(token)
                if raw[:1] == b" " and len(raw) > 2:
                    word = raw[1:].decode("utf-8", "ignore")
                    if word.isalpha():
                        if word.islower():
                            self.small[word] = int(rank)
                        elif word.istitle():
                            self.capital[word.lower()] = int(rank)
        self.memory: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """0: ordinary; 1: ordinary, but often capitalised as well; 2: known with a capital only; 3: unknown."""
        got = self.memory.get(word)
        if got is None:
            low = word.lower()
            if low in ORDINARY:
                got = 0
            else:
                a, b = self.small.get(low), self.capital.get(low)
                got = (0 if b is None or b > 5 * a else 1) if a is not None and (b is None or a < 4 * b) else 2 if b is not None else 3
                if got == 3 and len(low) > 4:  # inflected forms of ordinary words
                    for end in ("s", "es", "ed", "ing", "ly"):
                        if low.endswith(end) and (low[: -len(end)] in self.small or end in ("ing", "ed") and low[: -len(end)] + "e" in self.small):
                            got = 0 if b is None else 2
                            break
            if len(self.memory) < 500_000:
                self.memory[word] = got
        return got


def lexicon(path: str = VOCABULARY) -> Lexicon:
    return kept("lexicon " + path, lambda: Lexicon(path))


def _automaton():
    import ahocorasick

    words: dict[str, set] = {}
    for kind, own in (("spelt", SPELT_CUES), ("cue", tuple(w for own in POINTING for w in own)), ("han cue", HAN_CUES), *PLACES.items()):
        for w in own:
            words.setdefault(w, set()).add(kind)
    out = ahocorasick.Automaton()
    for w, kinds in words.items():
        out.add_word(w, (len(w), tuple(sorted(kinds))))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """Lower case, rune by rune, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _stretches(text: str, words: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of up to three words of a run without an ordinary one at either end, initials counted with them."""
    for i in range(len(words)):
        for j in range(i, min(i + 3, len(words))):
            if words[i][2] and words[j][2] and (words[j][1] - words[j][0] > 2 or text[words[j][1] - 1] != ".") and words[j][1] - words[i][0] > 1:
                yield words[i][0], words[j][1]


def candidates(text: str, words: Lexicon) -> list[tuple[int, int, str]]:
    """Overlapping spans with their types, in order. ``text`` may be several texts with BETWEEN between them; no span crosses it."""
    out: set[tuple[int, int, str]] = set()
    low = lowered(text)
    automaton = kept("personal cues", _automaton)
    at = text.find("@")
    marks = []
    for sign in "@＠":
        at = text.find(sign)
        while at >= 0:
            marks.append(at)
            at = text.find(sign, at + 1)
    for at in marks:
        begin = at
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%-"):
            begin -= 1
        if m := EMAIL.search(text, begin, at + 320):
            if m.start() < at < m.end():
                out.add((*m.span(), "email"))
    cues: set[int] = set()
    han: set[int] = set()
    for end, (length, kinds) in automaton.iter(low):
        start, end = end - length + 1, end + 1
        for kind in kinds:
            if kind == "cue":
                if start == 0 or not low[start - 1].isalnum() and not low[max(0, start - 2) : start - 1].isdigit():  # "2 ms" is no title
                    cues.add(end)
            elif kind == "han cue":
                han.add(end)
            elif kind == "spelt":
                if "dot" in low[end : end + 100]:
                    for m in SPELT.finditer(text, max(0, start - 100), end + 120):
                        if m.start() <= start and end <= m.end():
                            out.add((*m.span(), "email"))
            else:
                a = max(0, start - 90)
                if kind in ("way", "rue") and not any(c.isdigit() for c in low[a:start]):
                    continue
                for m in ADDRESSES[kind].finditer(text, a, end + 110):
                    if m.start() < end <= m.end() + 1:
                        out.add((*m.span(), "address"))
    for m in PHONE.finditer(text):
        out.add((*m.span(), "phone"))
    for n in NUMBERS.finditer(text):
        for m in ID.finditer(text, max(0, n.start() - 3), min(len(text), n.end() + 2)):
            out.add((*m.span(), "id_number"))
    beside = list(out)
    kind = words.kind
    for run in RUN.finditer(text):
        a, b = run.span()
        own = text[a:b]
        if " " not in own and "\t" not in own:
            if kind(own) and b - a > 1:
                out.add((a, b, "person"))
            continue
        parts = [(m.start() + a, m.end() + a, kind(m.group()) if m.group()[-1] != "." else 3) for m in TOKEN.finditer(own)]
        for s, e in _stretches(text, parts):
            out.add((s, e, "person"))
    for m in TURNED.finditer(text):
        one, two = m.group().split(",")
        if kind(one) and kind(two.strip()):
            out.add((*m.span(), "person"))

    def proposed(s: int, e: int) -> None:
        """What a cue or a neighbouring span points to: up to three words of any case."""
        own = [(m.start() + s, m.end() + s, kind(m.group()) if m.group()[-1] != "." else 3) for m in re.finditer(rf"[^\W\d_]\.(?=\s)|{WORD}", text[s:e])]
        if own and own[0][2]:
            for j in range(len(own)):
                if own[j][2] and (own[j][1] - own[j][0] > 2 or text[own[j][1] - 1] != ".") and own[j][1] - own[0][0] > 1:
                    out.add((own[0][0], own[j][1], "person"))

    for end in cues:
        if m := AFTER_CUE.match(text, end):
            proposed(*m.span())
    for s, e, k in beside:
        if k != "address":
            if m := BEFORE_SPAN.search(text, max(0, s - 60), s):
                proposed(*m.span(1))
        if m := AFTER_SPAN.match(text, e):
            proposed(*m.span(1))
        if k == "address" and s > 2 and text[s - 1] == "\n":  # a name on the line above an address
            line = text.rfind("\n", 0, s - 1) + 1
            if (m := AFTER_CUE.fullmatch(text, line, s - 1)) and BETWEEN not in m.group():
                proposed(*m.span())
    for end in han:
        if end < len(text) and text[end] in "：: 是":
            end += 1
        if m := HAN_RUN.match(text, end):
            for n in range(2, m.end() - m.start() + 1):
                out.add((m.start(), m.start() + n, "person"))
    for m in HAN_ALONE.finditer(text):
        out.add((*m.span(), "person"))
    return sorted(c for c in out if c[1] > c[0])


def features(text: str, start: int, end: int, kind: str, words: Lexicon, near: bool = False) -> list[float]:
    """Format and context of a span; ``near``: another span of another type is close."""
    own, left, right = text[start:end], text[max(0, start - 28) : start], text[end : end + 16]
    left = left[left.rfind(BETWEEN) + 1 :]
    right = right[: right.find(BETWEEN)] if BETWEEN in right else right
    low = lowered(left)
    digits = sum(map(str.isdigit, own))
    common = [
        TYPES.index(kind), len(own), digits, digits / len(own), sum(map(str.isupper, own)), "@" in own, "+" in own, "(" in own, "," in own, "\n" in own,
        right[:1] in ":/" and right != "", right[:1].isalnum(), left[-1:].isalnum(), left[-1:] in "/#=._-" and left != "", left[-1:] in "<(:\"" and left != "",
        *(bool(h.search(low)) for h in HINT), bool(HINT[4].search(low[-9:])),
    ]
    if kind != "person":
        return [*common, bool(re.search(r"(?i)\bat\b|at[\])}]", own)), "dot" in own.lower(), max((i + 1 for i, f in enumerate(FORMS) if f.fullmatch(own)), default=0), own.lower().startswith(("git@", "root@")), bool(re.search(CODE, own)), own.count("."), bool(re.match(r"\s*(?:" + WAY + r")\b", right, re.I)), bool(THINGS.match(right)), len(own.split()), bool(re.search(r"[a-z]{3}\.\s", own)), sum(words.kind(w) == 0 and w.lower() not in WAYS for w in re.findall(WORD, own)), own[0].isdigit() and own.split(",")[0].count(" ")]
    parts = re.findall(rf"[^\W\d_]\.(?=\s)|{WORD}", own)
    kinds = [words.kind(p) for p in parts if p[-1] != "."] or [3]
    cue = next((i for i, own_cues in enumerate(CUES) if low.endswith(own_cues) and not (i == 3 and low[-5:-4].isdigit())), -1)
    before, after = re.search(rf"({WORD})\s$", left), re.match(rf"\s({WORD})", right)
    is_han = "一" <= own[0] <= "鿿"
    return [
        *common, len(parts), sum(p[-1] == "." for p in parts), min(kinds), max(kinds), sum(k == 3 for k in kinds) / len(kinds), sum(k >= 2 for k in kinds) / len(kinds), sum(k == 1 for k in kinds), own[0].isupper(), own.isupper(), own.islower(), "-" in own, "'" in own or "’" in own,
        cue, cue >= 0, 0 <= cue < 5, 5 <= cue < 7, bool(ARTICLE.search(left)), bool(OPENING.search(left)), bool(re.search(r"(?:^|\n)\s*$", left)), left[-1:] in ",;|" and left != "",
        right[:2] in ("'s", "’s"), right[:1] in ",;|" and right != "", right[:1] in ")\"" and right != "", right[:1] in ".!?。，" and right != "", right == "" or right[:1] == "\n", bool(re.match(r"\s?[<(]\S*@|\s?[;,]\s?\S*[@\d]", right)), bool(DEEDS.match(right)), bool(THINGS.match(right)),
        words.kind(before[1]) if before and before[1][0].isupper() else -1, before is not None and before[1][0].isupper(), words.kind(after[1]) if after else -1, after is not None and after[1][0].isupper(), after is not None and bool(words.kind(after[1])) and after[1][0].isupper() == own[0].isupper(),
        is_han, is_han and own[0] in SURNAMES, is_han and own[:2] in DOUBLE, is_han and bool(re.search("(?:" + "|".join(HAN_CUES) + ")[：: 是]?$", left)), is_han and "一" <= right[:1] <= "鿿", is_han and right[:1] in "的说和与在负，。", near,
    ]


#: Fixed values for the composer: frequent public names, which no rule looks up, and things that are written like names.
FREQUENT = "Maria John Thomas Anna Peter Laura David Sarah Michael Julia Ahmed Fatima Wei Yuki Carlos Elena Ivan Olga Pierre Claire Hans Sofia Mohammed Aisha Kumar Singh Smith Johnson Brown Miller Garcia Martinez Lopez Schmidt Weber Wagner Becker Dubois Moreau Rossi Ferrari Novak Kowalski Nguyen Tanaka Kim Patel Hassan Silva Costa Andersen Berg Murphy Kelly".split()
PRODUCTS = "Docker Kafka Redis Jenkins Kubernetes Postgres Python Linux Spark Hadoop Grafana Chrome Windows Oracle Apache Ubuntu Android Excel Slack Jira Nginx Terraform Berlin Paris London Madrid Vienna Europe Germany Monday Internet Unicode Markdown English French Deutsch".split()
GIVEN_HAN = "明华丽强敏静磊洋艳勇杰娟涛超霞平刚桂英文雪梅宇晨欣怡浩然子轩"


def _strange(r: random.Random) -> str:
    """A made-up name of random syllables."""
    on, vow, off = ("b br c ch d f g gr h j k kl l m n p pr qu r s sh st t th tr v w z", "a e i o u a e i o u ia ei au é ö ü í", "n r l s t m nd rt ck lm x v st ng")
    out = "".join(r.choice(on.split()) + r.choice(vow.split()) + (r.choice(off.split()) if r.random() < 0.35 else "") for _ in range(r.choice((1, 2, 2, 2, 3, 3, 4)))) + r.choice(("", "", "n", "a", "o", "s", "ez", "son", "sky", "mann", "er", "by", "wick"))
    return out.capitalize()


def _person(r: random.Random, han: float = 0.03) -> str:
    if r.random() < han:
        return (r.choice(SURNAMES) if r.random() < 0.85 else r.choice(DOUBLE)) + "".join(r.choice(GIVEN_HAN) for _ in range(r.randint(1, 2)))
    word = lambda: r.choice(FREQUENT) if r.random() < 0.3 else _strange(r)
    g, f = word(), word()
    if r.random() < 0.1:
        f = r.choice(("O'", "D'", "Mc", "De ")) + f
    elif r.random() < 0.12:
        f = f + "-" + word()
    elif r.random() < 0.05:
        g = g + "-" + word()
    out = r.choice([f"{g} {f}"] * 5 + [g, f, g, f"{g[0]}. {f}", f"{g} {f[0]}. {f}", f"{g} {word()} {f}"])
    return r.choice([out] * 6 + [out.upper(), out.lower(), f"{f.upper()}, {g}"])


def _fill(r: random.Random, shape: str) -> str:
    return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEGHKLMXYZ") if c == "A" else c for c in shape)


PHONES = ("##########", "##### ### ###", "+## # ## ## ## ##", "###.###.####", "+## ## ##### ###", "###-###-####", "(###) ### ####", "+###########", "###/########", "## ## ## ## ##", "+## #### ######", "+# (###) ###-####", "### #### ####", "+#‑###‑###‑####", "1##########", "+## ### ### ####", "#### ######", "+## ## #### ####")
NUMBERS_OF = ("A#######", "########A", "### ## ####", "## ### ### ###", "###-##-####", "AA ## ## ## A", "A##A#####", "AA######A", "##################", "#################X", "AA#######")
#: Carriers of the composed sentences; each is written for this training.
GOOD = (
    "My name is {person}, you can reach me on {phone}.", "Hello, this is {person} from accounting.", "I'm {person} and I would like to change my plan.", "From: {person} <{email}>\nTo: {person} <{email}>", "Best,\n{person}", "Kind regards,\n{person}\n{phone}", "Thanks,\n{person}\n{email}\n{address}", "Regards,\n{person}\n{address}\nPhone {phone}",
    "Signed-off-by: {person} <{email}>", "commit by {person}", "Author: {person} <{email}>", "The patch by {person} was merged yesterday.", "{person} opened the ticket last week.", "Maybe {person} knows why it stalls.", "We met {person} and {person} at the desk.", "Yesterday {person} asked for the log.", "On Thursday {person} wrote:\n> fine", "INFO login of {person} accepted at 09:12", "assigned to {person} (was: {person})",
    "Please ask {person} or call {phone}.", "Could you mention {person} in the notes?", "I spoke with {person} this morning.", "tell {person} to look at it", "{person}'s account is locked", "{person}’s notebook was stolen", "both {person} and {person} agreed to it", "Mr. {person} called about the lease.", "Dr. {person} will see you at noon.", "Mrs {person} has moved.", "Dear {person}, thank you for the letter.", "The passport {id_number} belongs to {person}.", "document {id_number} belongs to {person}",
    "The applicant is {person}, born in May, passport no. {id_number}, living at {address}.", "name={person} mail={email}", "{person},{email},{phone}", "{person};{id_number};{phone}", "row 12: {person};{id_number};{phone}", "{person}|{email}|{id_number}", "id,name,mail\n7,{person},{email}", '{{"name": "{person}", "email": "{email}", "phone": "{phone}"}}', '{{"owner":"{person}","tel":"{phone}"}}', "phone {phone} ({person})", "Tel. {phone} ({person})", "{person} ({email})", "{person}, {phone}",
    "btw it's {person}, write to {email}", "- {person} wants a copy of the summary.", "> {person} said the parcel went to {address}", "reviewer: {person}", "cc {person}, {person}", "{person}", "SSN on record: {id_number}", "Use {id_number} as the identity number in the form.", "tax id {id_number}", "My number is {phone}.", "Call {phone} after six and mention {person}.", "call me at {phone}", "Write to {email} if it stalls.", "Reach me at {email}, please.", "mailto:{email}?subject=hi", "WARN mail to {email} bounced", "We moved to {address}.", "Our address since May: {address}.", "Send it to {address}, please.", "Visit us: {address} (ring {phone})", "fax {phone}",
    "Ich heiße {person} und wohne in {address}.", "Mein Name ist {person}.", "Frau {person} hat angerufen.", "Herr {person} möchte den Bericht.", "Gestern hat {person} den Bericht geprüft.", "Die Nummer im Ausweis ist {id_number}, erreichbar bin ich unter {phone}.", "Viele Grüße\n{person}", "Bitte an {person} weiterleiten, {email}.", "Ich habe mit {person} gesprochen.",
    "Je m'appelle {person} et mon adresse est {address}.", "Je m'appelle {person}, j'habite à Lyon.", "Hi, my name is {person}, and I have a question.", "{person}'s mailbox is full again.", "{person}’s order is late", "{person}'s desk", "Mon numéro est le {phone}, ou bien {email}.", "La demande vient de {person}.", "Madame {person} a signé.", "Cordialement,\n{person}", "Me llamo {person} y mi documento es {id_number}.", "Vivo en {address}; escríbeme a {email}.", "Habla con {person} mañana.", "La señora {person} llamó ayer.", "Saludos,\n{person}",
    "我叫{person}，电话{phone}。", "联系人：{person}，手机{phone}。", "联系人{person}。", "请找{person}说明。", "证件号码是{id_number}，申请人{person}。", "请寄到{address}，收件人{person}。", "身份证{id_number}", "通知{person}，邮箱{email}。", "我住在{address}。",
)
HAN_GOOD = tuple(g for g in GOOD if re.search("[一-鿿]", g))
BAD = (
    "The {Thing} service restarted twice.", "Install {Thing} and {Thing} first.", "the {Thing} theme is dark", "We use {Thing} with {Thing} in production.", "{Thing} v2.# was released.", "{Thing} 4 is out", "Upgrade {Thing} to the new version", "{Thing} Avenue is closed", "He lives near {Thing} Road in {Thing}.", "The trip from {Thing} to {Thing} takes ## minutes.", "in {Thing} there was rain", "the {Thing} parser and the {Thing} job", "import {Thing}", "class {Thing}Handler", "{Thing} Inc. bought {Thing} Ltd.", "University of {Thing}", "{Thing} server: connection lost", "via {Thing} we read the queue",
    "The Report lists ### rows.", "Release Notes for the Session Store", "Context compacted, Older sessions kept", "Pull Request #### by the Bot", "| Name | Kind | Count |", "Visual Studio Code or the Command Line", "ERROR Graph Builder: Timeout", "[INFO] Cleanup Task done", "Nothing was cached. Everything was fine. Retry later.", "Session Store, Outbox Writer; Claim Writer", "Remember that I prefer short answers.", "Can you explain how the planner works?", "Each call carries a digest. Both sides agree.", "Thanks, that works. Done?", "Line ## of docs/plan.md", "Next Steps: Review the Draft, Merge the Branch", "Lane report: the limit went up", "Status: Ready, Kind: Episode", "Key Points and Open Questions", "Terms of Service", "The Quick Start Guide",
    "Der Grenzwert steigt von ## auf ###, die Sitzung bleibt.", "Nach ### Versuchen war die Warteschlange leer. Alte Einträge fehlen.", "Die Zusammenfassung nennt ### Treffer im Speicher.", "Danke, passt so. Warum wartet der Dienst?", "Der Bericht und die Zeilen im Zwischenspeicher", "Bitte prüfe die Anzeige im Planer.", "Neue Einträge mit Fehler oder Warnung", "Le Rapport contient ### lignes. Pourquoi attend-il ?", "Merci de vérifier. Nous avons lancé les tests.", "Après ## essais la session était complète.", "Ejecutamos todo. Nada apareció en el registro.", "El informe muestra ### filas. Prefiero respuestas cortas.", "Revisa por qué falla. La sesión sigue abierta.", "高级设置，任务列表。", "方法，程序和任务的日志。", "系统在周五重新启动，然后继续。", "通知中心，联系方式，作者列表。",
    "epoch 17########", "checksum ################", "ISBN 9##-#-####-####-#", "order ###-####-## was archived", "build 2024####.#####", "timestamp 2023-##-## 1#:##:##", "git clone git@forge.example:group/project.git", "git@host.example: permission denied", "root@node-#:~# uptime", "logo@2x.png is missing", "npm install @scope/tool@2.###.1", "pkg@1.2.3", "coordinates 48.######, -1.######", "request id ########-####a-9c1e", "invoice INV-######", "listening on 10.0.###.7:####", "commit ####### touches 4 files", "version 10.###.09 of the driver", "section 12 of the Main Road map parser", "offset 0x########", "it took ### ms, then ## ms and ### rows", "It took ## ms. Everything was fine.", "checksum ################ of ## MB", "we looked at example.com today", "sku ###-###-####", "ticket ##########", "rows ##########, tokens #########", "serial A#######", "hash ########A", "1,###,### rows in 12 files", "pid ##### port ####", "meet at dot com events", "look at the dot in the chart",
    "It takes 12 retries. If the evidence row is stale, the lane is closed.", "We ran 3 jobs in the drive letter test", "5 files in the close queue, 7 rows in place", "kept 40 rows. The court case is next.", "a row of 12 items on the way out", "the place 3 rows down", "ask the planner for more", "by default and with care", "from memory to disk", "and then both sides", "for example and with retries",
)


def compose(seed: int = 3, n: int = SENTENCES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences: (text, spans)."""
    r = random.Random(seed)

    def mail() -> str:
        clean = lambda x: x.lower().replace("é", "e").replace("ü", "u").replace("ö", "o").replace("í", "i")
        a, b = clean(_strange(r)), clean(r.choice([_strange(r), r.choice(FREQUENT)]))
        local = r.choice([f"{a}.{b}", f"{a}-{b}", f"{b}_{a}", f"{a}##", f"{a}{b}", f"{a}.{b}+news", a])
        at, dot = r.choice([("@", ".")] * 6 + [("＠", ".")] + [(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "[dot]"), ("(at)", "[dot]")])
        out = _fill(r, local.replace("A", "a")) + at + r.choice(["example", "mail." + clean(_strange(r)), clean(_strange(r))]) + "." + r.choice(["com", "org", "net", "test", "io", "de"])
        if at not in "@＠":
            head, tail = out.split(at)
            out = (head if r.random() < 0.6 else head.replace(".", dot)) + at + tail.replace(".", dot)
        return out if r.random() > 0.06 else out.upper()

    def place() -> str:
        n, street, town = r.randint(1, 999), r.choice([_strange(r), "Old " + _strange(r), "St. " + _strange(r), _strange(r) + "'s", "Upper Mill"]), r.choice([_strange(r), "Lower " + _strange(r), "Port " + _strange(r)])
        cap = lambda: _strange(r)
        out = r.choice([f"{n} {street} Road, {town}, {_fill(r, 'AA# #AA')}", f"{n} {street} Avenue", f"{n} {street} St, Apt {r.randint(1, 40)}B, {town}, {_fill(r, 'AA #####')}", f"Flat {r.randint(1, 40)}, {n} {street} Terrace, {town}", f"{n} rue de la {cap()}, {_fill(r, '#####')} {cap()}", f"{n} avenue {cap()}", f"{cap()}straße {n}{r.choice(['', 'a'])}, {_fill(r, '#####')} {cap()}", f"{cap()}weg {n}", f"Calle de los {cap()} {n}, 3º A, {_fill(r, '#####')} {cap()}", f"Calle {cap()} {n}", f"{r.choice('云南海北东')}{r.choice('渡栖棠川城')}市{r.choice(['', '新安区'])}{r.choice('柳青望长中')}{r.choice('桥石江山')}路{n}号{r.choice(['', '1单元101室', '2栋'])}", f"{n} {street} Lane\n{town}, {_fill(r, 'AA #####')}", f"{n} {street} Lane, {town}"])
        return out.lower() if r.random() < 0.35 and out.isascii() and not re.search(r"[A-Z]{2}", out) else out

    make = {"person": lambda: _person(r), "phone": lambda: _fill(r, r.choice(PHONES)), "id_number": lambda: _fill(r, r.choice(NUMBERS_OF)), "email": mail, "address": place}
    thing = lambda: r.choice(PRODUCTS) if r.random() < 0.4 else _strange(r)
    tails = [b for b in BAD if "{" not in b]

    def one() -> tuple[str, list[tuple[int, int, str]]]:
        if r.random() < 0.45:
            text = r.choice(BAD)
            while "{Thing}" in text:
                text = text.replace("{Thing}", thing(), 1)
            return re.sub("#", lambda _: r.choice("0123456789"), text), []
        text, spans = "", []
        carrier = r.choice(GOOD if r.random() < 0.9 else HAN_GOOD)
        for part in re.split(r"(\{\w+\})", carrier.replace("{{", "{ ").replace("}}", " }")):
            if m := re.fullmatch(r"\{(\w+)\}", part):
                value = _person(r, 0.85) if m[1] == "person" and carrier in HAN_GOOD else make[m[1]]()
                spans.append((len(text), len(text) + len(value), m[1]))
                part = value
            text += part
        return text, spans

    out = []
    for _ in range(n):
        text, spans = one()
        if r.random() < 0.4:  # other sentences around it
            lead = re.sub("#", lambda _: r.choice("0123456789"), r.choice(tails)) + r.choice(("\n", " ", ". ", " — ", ": "))
            text, spans = lead + text, [(s + len(lead), e + len(lead), k) for s, e, k in spans]
        if r.random() < 0.4:
            text += r.choice(("\n", " ", "\n")) + re.sub("#", lambda _: r.choice("0123456789"), r.choice(tails))
        out.append((text, spans))
    return out


class Boosted:
    """Gradient-boosted trees of fixed depth for a binary label, on features cut into bins by quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rate: float = 0.25):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self.binned(x)
        width = BINS + 1
        flat = bins + np.arange(bins.shape[1]) * width
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        z = np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p) + 1e-6
            feature, cut, node = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, width, int), np.zeros(len(y), int)
            for i in range(2**DEPTH - 1):
                own = np.flatnonzero(node == i)
                if len(own) > 8:
                    at = flat[own].ravel()
                    gs = np.bincount(at, np.repeat(g[own], bins.shape[1]), bins.shape[1] * width).reshape(-1, width).cumsum(1)
                    hs = np.bincount(at, np.repeat(h[own], bins.shape[1]), bins.shape[1] * width).reshape(-1, width).cumsum(1)
                    ga, ha = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                    best = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[best] > 1e-3:
                        feature[i], cut[i] = best
                node[own] = 2 * i + 1 + (bins[own, feature[i]] > cut[i])
            leaf = node - (2**DEPTH - 1)
            value = rate * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            z += value[leaf]
            self.trees.append((feature, cut, value))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, z, every = self.binned(x), np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[every, feature[node]] > cut[node])
            z += value[node - (2**DEPTH - 1)]
        return z


def described(text: str, spans: list[tuple[int, int, str]], words: Lexicon) -> list[list[float]]:
    """The features of sorted candidate spans of one or more texts."""
    others = sorted(s for s, _, k in spans if k != "person")
    out = []
    for s, e, k in spans:
        near = False
        if k == "person":
            i = bisect.bisect_left(others, s - 60)
            near = i < len(others) and others[i] < e + 30
        out.append(features(text, s, e, k, words, near))
    return out


class Model:
    """Trees for persons and trees for the other types, and per type the threshold with the best F1 on sentences that were held out."""

    def __init__(self, path: str = VOCABULARY):
        words = lexicon(path)

        def table(seed: int, n: int):
            x, y, k = ([], []), ([], []), []
            rows = compose(seed, n)
            begins = np.cumsum([0] + [len(t) + 1 for t, _ in rows]).tolist()
            truth = {(s + b, e + b, kind) for b, (_, spans) in zip(begins, rows) for s, e, kind in spans}
            text = BETWEEN.join(t for t, _ in rows)
            own = candidates(text, words)
            for c, f in zip(own, described(text, own, words)):
                person = c[2] == "person"
                x[person].append(f), y[person].append(c in truth)
                if not person:
                    k.append(c[2])
            return [np.array(v, float) for v in x], [np.array(v, float) for v in y], np.array(k)

        x, y, _ = table(3, SENTENCES)
        self.trees = [Boosted(a, b) for a, b in zip(x, y)]
        x, y, k = table(4, SENTENCES // 2)
        z = [t.score(a) for t, a in zip(self.trees, x)]
        pairs = {kind: (z[0][k == kind], y[0][k == kind]) for kind in TYPES[:-1]} | {"person": (z[1], y[1])}
        self.limits = np.zeros(len(TYPES))
        steps = np.linspace(-1, 1, 17)
        for i, kind in enumerate(TYPES):
            own, truth = pairs[kind]
            f1 = np.array([2 * ((truth > 0) & (own > t)).sum() / max(1, truth.sum() + (own > t).sum()) for t in steps])
            good = np.flatnonzero(f1 >= f1.max() - 0.001)
            self.limits[i] = steps[good[len(good) // 2]]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        """Scores less their type's thresholds, so that spans over 0 are kept."""
        kind = np.array([int(r[0]) for r in rows])
        person = kind == TYPES.index("person")
        out = np.empty(len(rows))
        for own, trees in ((~person, self.trees[0]), (person, self.trees[1])):
            if own.any():
                out[own] = trees.score(np.array([r for r, o in zip(rows, own) if o], float))
        return out - self.limits[kind]


train = Model


def _kept_spans(text: str, model: Model, words: Lexicon) -> list[tuple[int, int, str]]:
    """Of overlapping spans over their thresholds e-mails come first, then addresses, then the better score (of persons, LONGER more for each further word), of equal ones the longer."""
    own = candidates(text, words)
    if not own:
        return []
    z = model.score(described(text, own, words))
    keep = [(*c, v + LONGER * (c[2] == "person") * text.count(" ", c[0], c[1])) for c, v in zip(own, z) if v > 0]
    taken: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for s, e, k, _ in sorted(keep, key=lambda r: ({"email": 0, "address": 1}.get(r[2], 2), -round(r[3], 3), r[0] - r[1], r[0])):
        i = bisect.bisect_left(starts, e)
        if i == 0 or taken[i - 1][1] <= s:
            starts.insert(i, s), taken.insert(i, (s, e, k))
    return taken


def found(texts: list[str | None], model: Model, path: str = VOCABULARY) -> list[list[tuple[int, int, str]]]:
    """Spans of each text. Texts are joined to runs of bounded length (a text is never cut) and worked on together."""
    words = lexicon(path)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    run: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            run.append((i, t.replace(BETWEEN, " ")))
            size += len(t)
        if run and (size > RUN_RUNES or i == len(texts) - 1):
            begins = np.cumsum([0] + [len(t) + 1 for _, t in run]).tolist()
            for s, e, k in _kept_spans(BETWEEN.join(t for _, t in run), model, words):
                j = bisect.bisect_right(begins, s) - 1
                out[run[j][0]].append((s - begins[j], e - begins[j], k))
            run, size = [], 0
    return out


SPANS = "event_id string, created_at timestamp, spans array<struct<start_rune:int,end_rune:int,pii_type:string>>"


def detected(events: DataFrame) -> DataFrame:
    """``event_id`` and its spans, of the counted delivery. Texts are read where they lie; only the spans are shuffled.

    Rows without an id are no events; null and empty texts have no spans; a text is worked on whole.
    """
    model = kept("personal model", train)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_rune", pa.int32()), ("end_rune", pa.int32()), ("pii_type", pa.string())]))
        for b in batches:
            got = found(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"start_rune": s, "end_rune": e, "pii_type": k} for s, e, k in o] for o in got], kind)], ["event_id", "created_at", "spans"])

    rows = events.where("event_id is not null").select("event_id", "created_at", "content").mapInArrow(detect, SPANS)
    return rows.groupBy("event_id").agg(F.max(F.struct("created_at", "spans"))["spans"].alias("spans"))


def spans(events: DataFrame) -> DataFrame:
    return detected(events).select("event_id", F.explode("spans").alias("s")).select("event_id", "s.pii_type", "s.start_rune", "s.end_rune")


def redacted(events: DataFrame) -> DataFrame:
    """``event_id, created_at, content`` of every delivery, each span replaced by its type in brackets, all other text unchanged."""
    model = kept("personal model", train)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, own in enumerate(found(texts, model)):
                for s, e, k in reversed(own):
                    texts[i] = f"{texts[i][:s]}[{k.upper()}]{texts[i][e:]}"
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["event_id", "created_at", "content"])

    return events.select("event_id", "created_at", "content").mapInArrow(redact, "event_id string, created_at timestamp, content string")
