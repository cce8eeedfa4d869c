"""Problem 10: personal information in free text, found and replaced by typed placeholders.

Candidate gradient boosting. Generators of high recall propose spans that may overlap, by format alone: every run of
capitalised words, initials and particles is a source of names, every run of digits one of numbers, and so on. Each
span gets format and context features; the name lexicon is a feature, too, not a condition. Boosted trees score the
spans, one model for a kind, and a threshold calibrated on held-out rows selects; of overlapping spans the best score
wins. The models are trained when the operator starts, on ``n_train`` labelled texts made by ``personal_training``
(a bounded sample, the bound is this parameter), and kept for the next use with an equal lexicon. What is found in a text
depends on the text and the whole lexicon alone: neither on the other texts nor on the way the lexicon is sent.

Defined cases: a null, empty or clean text gives no rows and stays as it is; a repeated string counts once for
a document; long texts are scanned whole; null ids are kept in the redaction and left out of the findings; extra
columns are ignored; null words of the lexicon are left out, and an empty lexicon leaves the built-in common names.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .boosting import Boosted, best_threshold
from .personal_words import ARTICLES, CALENDAR, CUES, FAMILY, FUNCTION, GIVEN, INSTITUTIONS, LOCATIVE, PARTICLES, STREETS, TITLES

KINDS = ("email", "phone", "id_number", "address", "name")
U = "A-ZÀ-ÖØ-Þ"
GAP = r"(?:[ \t]{1,2}|[ \t]?\r?\n[ \t]?)"

LETTER = r"[^\W\d_]"
WORD = rf"(?:[dDlL][’'])?[{U}](?:{LETTER}|[’'](?={LETTER}))+(?:-[{U}]?(?:{LETTER}|[’'](?={LETTER}))+)*(?!\w)"
INITIAL = rf"[{U}]\.(?:-?[{U}]\.)*"
PARTICLE = rf"(?:{'|'.join(PARTICLES).replace(' ', GAP)})(?!\w)"
# a pattern that begins with a set of characters is searched fastest, so what may not stand before it is looked at behind the first one
RUN = re.compile(rf"[{U}](?<![\w@.+’'/-].)(?:\.(?:-?[{U}]\.)*|(?:{LETTER}|[’'](?={LETTER}))+(?:-[{U}]?(?:{LETTER}|[’'](?={LETTER}))+)*(?!\w))(?:,?{GAP}(?:{PARTICLE}{GAP})?(?:{INITIAL}|{WORD}))+(?![\w@])")
ITEM = re.compile(rf"({PARTICLE})|({INITIAL})|({WORD})")
LEFT = re.compile(rf"(?<![\w’'-]){PARTICLE}{GAP}$")
FRENCH = re.compile(r"(?i)\b(?:le|la|les|du|des|est|et|une?|au|dans|pour)\b")

NUMBER = re.compile(r"(?:\d(?<![\w+(].)|[+(](?<![\w+(].)[+(]?\d)(?:(?:[-./]|\)?[-./]?[ \t]?(?:\r?\n)?\(?)\d){5,20}(?:[ \r\n-]{0,2}[A-Z]{1,2}(?!\w))?")
LETTERED = re.compile(r"[A-Z](?<!\w.)[A-Z]{0,2}[ \r\n-]{0,2}[+(]{0,2}\d(?:(?:[-./]|\)?[-./]?[ \t]?(?:\r?\n)?\(?)\d){5,20}(?:[ \r\n-]{0,2}[A-Z]{1,2}(?!\w))?")
MIXED = re.compile(r"[A-Z0-9](?<![\w-].)[A-Z0-9]{7,11}(?![\w-])")
CUE_EDGE = re.compile(r"[=;:(]")
SIGN = re.compile(r"@(?=\w)")
AT_BRACKET = re.compile(r"[ ]?[\[(][ ]?(?:at|AT)[ ]?[\])]\s?")
AT_WORD = re.compile(r"\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s)")
DOT = r"(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\s(?:dot|DOT)\s)"
LOCAL = re.compile(rf"[\w+-][\w.+-]*(?:(?:\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\s(?:dot|DOT)\s)[\w+-]+)*$")
LOCAL_LAST = re.compile(r"[\w+-][\w.+-]*$")
DOMAIN = re.compile(rf"[^\W_][\w-]*(?:{DOT}[^\W\d_][\w-]*)+")
LOOK_BACK = 160  # the local part of an address has 64 characters at most; the rest is room for spelled-out dots

PLACE = rf"[{U}][\w’'-]+"
_TYPES = {lang: "|".join(re.escape(w) for w in sorted(STREETS[lang], key=lambda w: (-len(w), w))) for lang in STREETS}
_EN = rf"(?:{_TYPES['en']}|{_TYPES['en'].upper()})(?!\w)"
_OF = {"fr": rf"(?:(?i:de{GAP}la|du|des|de|d[’']|de{GAP}l[’'])(?:{GAP})?)?", "es": rf"(?:(?i:de{GAP}las|de{GAP}los|de{GAP}la|del|de)(?:{GAP}))?"}
# by language; the group of further capitalised words is optional, so a match is cut back to give more candidates
ADDRESSES = (
    re.compile(rf"\d(?<![\w-].)\d{{0,4}}[A-Za-z]?,?{GAP}(?:{PLACE}{GAP}){{1,3}}?{_EN}"),
    re.compile(rf"\d(?<![\w-].)\d{{0,3}}(?:[A-Za-z]|{GAP}(?i:bis|ter|quater))?,?{GAP}(?i:{_TYPES['fr']}){GAP}{_OF['fr']}{PLACE}(?:{GAP}{PLACE}){{0,2}}"),
    re.compile(rf"(?<!\w)(?:[{U}][\w’]*(?i:{_TYPES['de']})|(?:{PLACE}{GAP}|[{U}][\w’]+-){{1,2}}(?i:{_TYPES['de']})|(?:Am|An{GAP}der|An{GAP}den|Auf{GAP}dem|Zum|Zur|Im|In{GAP}der|Unter{GAP}den|Hinter{GAP}dem){GAP}{PLACE}(?:{GAP}{PLACE})?){GAP}\d{{1,4}}(?:[ ]?[A-Za-z](?!\w))?(?!\d)"),
    re.compile(rf"(?<![\w-])(?i:{_TYPES['es']}){GAP}?{_OF['es']}{PLACE}(?:{GAP}{PLACE}){{0,2}},?{GAP}(?:n[.ºo°]{{0,2}}{GAP}?)?\d{{1,4}}[A-Za-z]?(?!\w)"),
    re.compile(rf"(?<![\w-])(?:{PLACE}{GAP}){{1,2}}(?:{_TYPES['en']})(?!\w),?{GAP}\d{{1,4}}[A-Za-z]?(?![\w.,]?\d|\w)"),
    re.compile(rf"(?<![\w-])(?i:{_TYPES['fr']}){GAP}{_OF['fr']}{PLACE}(?:{GAP}{PLACE}){{0,2}},?{GAP}\d{{1,4}}(?:[A-Za-z]|{GAP}(?:bis|ter))?(?![\w.,]?\d|\w)"),
)
# what a text must hold for a pattern of addresses to match at all: words in lower case; ends of German street names,
# some alone and others before a number only; what a German address without such an end begins with
_STEMS = {lang: {w.lower() + end for w in STREETS[lang] for end in ("", ",", ".", ";", ":", ")")} for lang in STREETS}
_GERMAN = ("straße", "strasse", "gasse", "platz", "allee", "chaussee")
_GERMAN_ENDS = tuple(STREETS["de"])
_GERMAN_STARTS = ("Am ", "An de", "Auf dem ", "Zum ", "Zur ", "Im ", "In der ", "Unter den ", "Hinter dem ", "Am\n", "Im\n", "Zum\n", "Zur\n")


def keys(w: str) -> tuple[str, str, str]:
    """What a word of a text is looked up by: the whole, its first and its last part."""
    base = w.lower().removesuffix("'s").removesuffix("’s")
    return base, base.split("-", 1)[0], base.rsplit("-", 1)[-1]


Traits = tuple[Counter, Counter, Counter]


def traits_of(given: set[str], family: set[str]) -> Traits:
    """How often ends and starts of family names and ends of given names occur."""
    return Counter(w[-n:] for w in family for n in (2, 3, 4)), Counter(w[:4] for w in family), Counter(w[-2:] for w in given | GIVEN)


@dataclass
class Names:
    """Known given and family names (the lexicon's and a few common ones), and how often the ends of the lexicon's occur."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    ends: Counter = field(default_factory=Counter)
    starts: Counter = field(default_factory=Counter)
    given_ends: Counter = field(default_factory=Counter)
    known: dict = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str]], traits: Traits | None = None) -> "Names":
        """Of a part of a lexicon, ``traits`` are those of the whole."""
        given = {w.lower() for w, k in rows if w and k == "given"}
        family = {w.lower() for w, k in rows if w and k == "family"}
        return cls(given | GIVEN, family | FAMILY, *(traits or traits_of(given, family)))

    def without(self, share: float, rng) -> "Names":
        """The same with a share of the names unknown."""
        keep = lambda words: {w for w in sorted(words) if rng.random() >= share}
        return Names(keep(self.given), keep(self.family), self.ends, self.starts, self.given_ends)

    def word(self, w: str) -> tuple[int, ...]:
        """Features of one word; an unknown one is all zeros but for its form."""
        got = self.known.get(w)
        if got is None:
            base, first, last = keys(w)
            got = (
                int(base in self.given or first in self.given), int(base in self.family or last in self.family), _level(self.ends[last[-4:]]), _level(self.ends[last[-3:]]), min(31, self.ends[last[-2:]] // 4), _level(self.starts[last[:4]]), _level(self.given_ends[base[-2:]]),
                int(base in INSTITUTIONS or base.removesuffix("s") in INSTITUTIONS), int(base in FUNCTION) + 2 * int(base in CALENDAR), int(base.strip(".") in TITLES), int(w.isupper() and len(w) > 2), min(15, len(w)), int("-" in w), int(base in NEVER),
            )
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[w] = got
        return got


NO_WORD = (0,) * 14
# function words that are no names either; no name holds one with a capital letter
NEVER = FUNCTION - GIVEN - FAMILY - {"will", "may", "can", "so", "an", "al", "la", "le", "du", "des", "de", "den", "dem", "der", "el", "to", "do", "see", "es", "su", "noble", "on", "von", "vom", "zum", "zur", "war", "son"}
PARTICLE_KIND = {"vo": 1, "va": 2, "de": 3}


def _level(n: int) -> int:
    return 0 if n == 0 else 1 if n < 3 else 2 if n < 10 else 3


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    before = text[max(0, start - 24) : start].split()
    after = text[end : end + 24].split()
    return before[-1] if before else "", after[0] if after else ""


Span = tuple[int, int, str, list[int]]


def emails(text: str) -> Iterator[Span]:
    found = list(SIGN.finditer(text)) if "@" in text else []
    if "(at" in text or "[at" in text or "(AT" in text or "[AT" in text or "( at" in text or "[ at" in text:
        found += AT_BRACKET.finditer(text)
    if " dot" in text or "dot " in text or "DOT" in text:
        found += AT_WORD.finditer(text)
    for m in found:
        right = DOMAIN.match(text, m.end())
        if not right:
            continue
        blank = text.rfind("\n\n", 0, m.start())
        off = max(0, m.start() - LOOK_BACK, blank + 2 if blank >= 0 else 0)
        left = text[off : m.start()]
        bare = m.group().strip() == "@"
        starts = {x.start() + off for x in (LOCAL.search(left), LOCAL_LAST.search(left)) if x}
        for s in starts:
            whole = text[s : right.end()]
            prev, nxt = _context(text, s, right.end())
            yield s, right.end(), "email", [
                int(bare), int("[" in m.group() or "(" in m.group()), min(31, m.start() - s), min(31, right.end() - m.end()), len(starts), int(s == min(starts)), whole.count("."), min(7, len(re.findall("dot", whole, re.I))),
                int(any(c.isdigit() for c in whole)), int(prev[-1:] == ":"), min(15, len(whole) - whole.rfind(".") - 1), int(whole.isupper()),
            ]


def _cue(word: str) -> int:
    return CUES.get(CUE_EDGE.split(word.rstrip(".,:;#()=°º").lower())[-1].strip("#(°º"), 0)


def numbers(text: str) -> Iterator[Span]:
    lettered = list(LETTERED.finditer(text))
    within = {m.end() for m in lettered}
    mixed = [m for m in MIXED.finditer(text) if m.end() not in within and sum(c.isdigit() for c in m.group()) > 1 and not m.group().isdigit()]
    for m in [*(m for m in NUMBER.finditer(text) if m.end() not in within), *lettered, *mixed]:
        options = [(m.start(), m.end())]
        s = m.group()
        tail = s.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if len(tail) < len(s):
            options.append((m.start(), m.start() + len(tail.rstrip(" \r\n-"))))
        if s[0] == "(" and s.count("(") > s.count(")"):  # a bracket around the whole
            options = [(a + 1, b) for a, b in options]
        front = s.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if len(front) < len(s):
            n = len(s) - len(front.lstrip(" \r\n-"))
            options += [(a + n, b) for a, b in list(options)]
        after = text[m.end() : m.end() + 16]
        nxt = after.split()
        behind = _cue(nxt[0]) if nxt else 0
        from_ = None
        for a, b in options:
            if a != from_:
                from_, before = a, text[max(0, a - 40) : a]
                around = before.split()[-3:]
                cues = [0] * (3 - len(around)) + [_cue(w) for w in around]
            t = text[a:b]
            digits = sum(c.isdigit() for c in t)
            if digits > 16:  # neither a telephone number nor one of a person's papers is so long
                continue
            groups = re.findall(r"\d+", t)
            flat = re.sub(r"\s+", " ", t)
            shape = [len(g) for g in groups]
            letters = sum(c.isalpha() for c in t)
            yield a, b, "number", [
                min(31, digits), len(groups), min(15, shape[0]), min(15, shape[-1]), min(15, shape[1]) if len(shape) > 1 else 0, min(15, shape[2]) if len(shape) > 2 else 0, sum(c.isalpha() for c in t[:3]), sum(c.isalpha() for c in t[-2:]), letters,
                int(t[0] == "+"), int("(" in t), int(t.count("(") == t.count(")")), int(groups[0][0] == "0"), int(t.startswith("00")), min(7, flat.count(" ")), min(7, t.count("-")), min(7, t.count(".")), t.count("/"),
                *cues, behind, max(cues), int(1 in cues), int(2 in cues), int(3 in cues), int(groups[-1] == groups[-1][:1] * len(groups[-1])), int(a == m.start()), int(b == m.end()), int(after[:1] == ","), int(groups[0] == "1"), int(len(set(shape)) == 1),
                int(before[-1:] in "#$£€"  and before != ""), int(after[:1] in "%€$£-/" and after != ""), int(bool(nxt) and nxt[0][:1].islower()), int(len(groups[0]) == 4 and groups[0][:2] in ("16", "17", "18", "19", "20")), int(len(groups[-1]) == 4 and groups[-1][:2] in ("16", "17", "18", "19", "20")),
            ]


def addresses(text: str) -> Iterator[Span]:
    low = text.lower()
    tokens = low.split()
    words = set(tokens)
    en, fr, es = (not words.isdisjoint(_STEMS[lang]) for lang in ("en", "fr", "es"))
    numbered = [x for x, y in zip(tokens, tokens[1:]) if y[0].isdigit()]
    de = any(h in low for h in _GERMAN) or any(x.endswith(_GERMAN_ENDS) for x in numbered) or any(h in text for h in _GERMAN_STARTS)
    there = (en, fr, de, es or "c/" in low, en and not _STEMS["en"].isdisjoint(numbered), fr)
    for n, pattern in enumerate(ADDRESSES):
        if not there[n]:
            continue
        for m in pattern.finditer(text):
            stops = [m.end()]
            if n in (1,):  # a street's name of several words may have taken in what follows it
                words = list(re.finditer(r"\S+", m.group()))
                while len(stops) < 3 and len(words) > 3 and words[-1].group()[:1].isupper() and words[-2].group()[:1].isupper():
                    words.pop()
                    stops.append(m.start() + words[-1].end())
            begins = [m.start()]
            if n == 2:  # and a noun may stand before a German street
                words = list(re.finditer(r"\S+", m.group()))
                if len(words) > 2 and words[1].group()[:1].isupper():
                    begins.append(m.start() + words[1].start())
            for start, stop in [(x, y) for x in begins for y in stops]:
                prev, nxt = _context(text, start, stop)
                t = text[start:stop]
                words = [w.strip(",.").lower() for w in t.split()]
                digits = re.search(r"\d+", t).group()
                after = nxt.strip(".,;:").lower()
                yield start, stop, "address", [
                    n, len(digits), int(digits[0] == "0"), len(words), int("," in t), int(t.isupper()), int(after in INSTITUTIONS or after.removesuffix("s") in INSTITUTIONS), int(prev[-1:].isdigit()), int(prev.strip(".,:;").lower() in LOCATIVE), int(prev[-1:] in ",:;"),
                    int(any(w in FUNCTION for w in words)), int(any(w in CALENDAR for w in words)), int(nxt[:1].islower()), int(nxt[:1].isupper() and text[stop : stop + 1].isspace()), int(t[-1] == "."), min(15, len(prev)), int(stop != m.end()), int(start != m.start()), int(len(begins) > 1), int(words[0] in FUNCTION),
                    int(len(digits) == 4 and digits[:2] in ("16", "17", "18", "19", "20")), _cue(prev), int(prev.strip(".,:;").lower() in CALENDAR), int(text[stop : stop + 1] == ","), int(bool(re.fullmatch(r"(?i)(?:in|en|à|zu|of|near)", after))),
                ]


def words_in(text: str) -> set[str]:
    """The words that ``names_in`` looks up."""
    return {x.group() for m in RUN.finditer(text) for x in ITEM.finditer(text, m.start(), m.end()) if x.group(3)}


def names_in(text: str, lex: Names) -> Iterator[Span]:
    for m in RUN.finditer(text):
        toks, comma = [], []
        last = m.start()
        for x in ITEM.finditer(text, m.start(), m.end()):
            toks.append((x.start(), x.end(), x.group(), "p" if x.group(1) else "i" if x.group(2) else "w"))
            comma.append("," in text[last : x.start()])
            last = x.end()
        feats = [lex.word(t[2]) if t[3] == "w" else NO_WORD for t in toks]
        if sum(t[3] != "p" and not f[13] for t, f in zip(toks, feats)) < 2:
            continue
        wrapped = [k > 0 and "\n" in text[toks[k - 1][1] : toks[k][0]] for k in range(len(toks))]
        prev, nxt = _context(text, m.start(), m.end())
        prev_low, nxt_low = prev.strip(".,:;()\"").lower(), nxt.strip(".,:;()\"").lower()
        edge = 4 if not prev else 3 if prev[-1] in ":;(" else 2 if prev[-1] in ".!?" else 1 if prev[-1] == "," else 0
        line = int("\n" in text[max(0, m.start() - 2) : m.start()])
        outer = [int(prev_low in TITLES), edge, int(prev_low in LOCATIVE), int(prev_low in FUNCTION), line, int(prev_low in INSTITUTIONS), int(prev[:1].isupper()), int(prev_low in ARTICLES)]
        lowered = [int(t[3] == "w" and (f" {t[2].lower()} " in text or f" {t[2].lower()}," in text)) for t in toks]
        n = len(toks)

        def context(i: int, j: int, stop: int) -> list[int]:
            """What stands before token i and behind token j."""
            if i == 0:
                left = [*outer, 0, 0, 0]
            else:
                t, f = toks[i - 1], feats[i - 1]
                left = [f[9] or int(t[2].strip(".").lower() in TITLES), 1 if comma[i] else 0, 0, int(f[8] == 1), 0, f[7], 1, int(t[2].lower() in ARTICLES), f[0], f[1], int(t[3] == "i") + 2 * int(t[3] == "p")]
            if j == n - 1:
                right = [0, int(nxt_low in INSTITUTIONS and text[stop : stop + 1].isspace()), 0, 0, "?,.:;)(".find(text[stop : stop + 1] or "?") + 1, int(nxt[:1].islower())]
            else:
                f = feats[j + 1]
                right = [1 + int(comma[j + 1]), f[7], f[0], f[1], 2 if comma[j + 1] else 0, int(toks[j + 1][3] != "w")]
            return left + right

        def row(form: int, i: int, j: int, first: int, family: int, stop: int) -> list[int]:
            inner = [k for k in range(i, j + 1) if k not in (first, family) and toks[k][3] == "w"]
            t = toks[first]
            french = int(t[2] == "M." and bool(FRENCH.search(text[max(0, t[0] - 40) : stop + 40])))
            return [
                form, j - i + 1, sum(toks[k][3] == "i" for k in range(i, j + 1)), max([0, *(PARTICLE_KIND.get(toks[k][2][:2].lower(), 4) for k in range(i, j + 1) if toks[k][3] == "p")]), *feats[first], int(t[3] == "i") + int(t[3] == "i" and t[2].strip(".").lower() in TITLES), french, *feats[family],
                int(any(feats[k][0] for k in inner)), int(any(feats[k][7] or feats[k][9] for k in inner)), int(any(feats[k][8] for k in inner)), int(any(feats[k][1] for k in inner)), len(inner), lowered[first], lowered[family], *context(i, j, stop),
                sum(wrapped[i + 1 : j + 1]), int(wrapped[j]), int("\n" in text[stop : stop + 2]), int(i > 0 and wrapped[i]), int(j < n - 1 and wrapped[j + 1]),
                int(toks[first][2] == toks[family][2]), int(len({toks[k][2].isupper() for k in range(i, j + 1) if toks[k][3] == "w"}) == 2),
            ]

        for i in range(n):
            if toks[i][3] == "p" or feats[i][13]:
                continue
            # given name first
            own = 1
            for j in range(i + 1, n):
                if comma[j] or own == 4 or feats[j][13]:
                    break
                if toks[j][3] == "p":
                    continue
                own += 1
                if toks[j][3] == "w":
                    stop = toks[j][1] - (2 if toks[j][2][-2:] in ("'s", "’s", "'S", "’S") else 0)
                    yield toks[i][0], stop, "name", row(0, i, j, i, j, stop)
            # family name first, with particles before it
            if toks[i][3] == "w" and i + 1 < n:
                for c in (i + 1, i + 2):
                    if c < n and comma[c] and not any(comma[i + 1 : c]) and toks[c - 1][3] == "w" and not feats[c - 1][13]:
                        head = toks[i][0]
                        if i == 0:
                            back = LEFT.search(text[max(0, head - 16) : head])
                            head -= len(back.group()) if back else 0
                        else:
                            k = i
                            while k and toks[k - 1][3] == "p" and not comma[k]:
                                k -= 1
                            head = toks[k][0]
                        for j in range(c, min(n, c + 3)):
                            if toks[j][3] == "p" or (j > c and comma[j]) or feats[j][13]:
                                break
                            yield head, toks[j][1], "name", row(1, i, j, c, c - 1, toks[j][1])


def candidates(text: str, lex: Names) -> list[Span]:
    return [*emails(text), *numbers(text), *addresses(text), *names_in(text, lex)]


MODELS = {"email": "email", "phone": "number", "id_number": "number", "address": "address", "name": "name"}


def features(rows: list[list[int]]) -> np.ndarray:
    return np.asarray(rows, np.int16).clip(0, 31).astype(np.uint8) if rows else np.zeros((0, 1), np.uint8)


class Detector:
    def __init__(self, lex: Names, n_train: int = 7000, seed: int = 7, drawn: Names | None = None):
        """The training texts are filled from ``drawn`` (else ``lex``) and looked up in ``lex``."""
        import random

        from .personal_training import sentences

        self.lex = lex
        rng = random.Random(seed)
        rows: dict[str, list] = {k: [] for k in KINDS}
        partly = [lex.without(share, rng) for share in (0.1, 0.4, 0.7)]
        for n, (text, truth) in enumerate(sentences(drawn or lex, n_train, seed)):
            wanted = set(truth)
            # a register is never complete: part of the names of a training text are unknown
            for a, b, source, f in candidates(text, partly[n % len(partly)]):
                for kind, of in MODELS.items():
                    if of == source:
                        rows[kind].append((f, (a, b, kind) in wanted, n % 4 == 0))
        self.models, self.cuts = {}, {}
        for kind, r in rows.items():
            x, y, held = features([v[0] for v in r]), np.array([v[1] for v in r], float), np.array([v[2] for v in r], bool)
            model = (Boosted(trees=100, depth=4, rate=0.2) if kind == "name" else Boosted(trees=60)).fit(x[~held], y[~held])
            self.models[kind], self.cuts[kind] = model, min(0.6, max(0.3, best_threshold(model.predict(x[held]), y[held], 1.2)))

    def knowing(self, lex: Names) -> "Detector":
        """The same models with other names to look up."""
        got = copy.copy(self)
        got.lex = lex
        return got

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Selected spans of each text, in order and without overlaps."""
        spans: dict[str, list] = {"email": [], "number": [], "address": [], "name": []}
        for i, text in enumerate(texts):
            if text:
                for a, b, source, f in candidates(text, self.lex):
                    spans[source].append((i, a, b, f))
        scored: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        for kind, source in MODELS.items():
            rows = spans[source]
            if not rows:
                continue
            p = self.models[kind].predict(features([r[3] for r in rows]))
            for j in np.flatnonzero(p >= self.cuts[kind]):
                i, a, b, _ = rows[j]
                scored[i].append((p[j], a, b, kind))
        out = []
        for rows in scored:
            taken: list[tuple[int, int, str]] = []
            for _, a, b, kind in sorted(rows, key=lambda r: (-round(r[0], 6), r[1] - r[2])):
                if all(b <= x or a >= y for x, y, _ in taken):
                    taken.append((a, b, kind))
            out.append(sorted(taken))
        return out


_TRAINED: dict[str, Detector] = {}


def _register(lexicon: DataFrame) -> DataFrame:
    """``(low, kind)``: the given and family names, each once, in the lower case that words of a text are looked up in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["low", "kind"])

    names = lexicon.select("word", "kind").where("word <> '' and kind in ('given', 'family')")
    return written(names.mapInArrow(run, "low string, kind string").distinct(), "names")


def _traits(register: DataFrame) -> Traits:
    """``traits_of`` the whole register, counted by the executors: as many rows as there are ends and starts."""
    ends = ", ".join(f"named_struct('of', 'end', 'part', right(low, {n}))" for n in (2, 3, 4))
    parts = F.expr(f"inline(if(kind = 'family', array({ends}, named_struct('of', 'start', 'part', left(low, 4))), array(named_struct('of', 'given', 'part', right(low, 2)))))")
    out = {"end": Counter(), "start": Counter(), "given": Counter(w[-2:] for w in GIVEN)}
    for of, part, n in register.where((F.col("kind") == "family") | ~F.col("low").isin(sorted(GIVEN))).select(parts).groupBy("of", "part").count().collect():
        out[of][part] += n
    return out["end"], out["start"], out["given"]


def _met(register: DataFrame, texts: DataFrame) -> list[tuple[str, str]]:
    """Names of the register that a word of ``texts`` (one column) can be looked up by; all others are never asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = set().union(*(words_in(t) for t in b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(sorted({k for w in words for k in keys(w)}), pa.string())], names=["low"])

    low = texts.toDF("text").where("text is not null").mapInArrow(run, "low string").distinct()
    return [tuple(r) for r in register.join(low, "low", "left_semi").select("low", "kind").collect()]


def detector(lexicon: DataFrame, n_train: int = 7000, docs: DataFrame | None = None, most: int = 200_000, draw: int = 50_000, seed: int = 7) -> Detector:
    """Trained with the whole lexicon; of one over ``most`` names (checked) only those that ``docs`` (one column of texts) hold are collected.

    The models don't depend on ``most`` or ``docs``: ends and starts are counted over the whole lexicon, the training texts
    are filled with the ``draw`` names of the least hashes and looked up in the whole, and a name that is not collected
    is one that no word of ``docs`` is looked up by.
    """
    from .personal_training import sentences

    register = _register(lexicon)
    n = register.count()
    if n > most and docs is None:
        raise ValueError(f"the lexicon has more than {most} words")
    traits = _traits(register)
    some = [tuple(r) for r in register.orderBy(F.xxhash64("low", "kind"), "low", "kind").limit(draw).collect()]
    drawn = lex = Names.of(some, traits)
    if n > draw:  # else all are drawn
        made = register.sparkSession.createDataFrame([(t,) for t, _ in sentences(drawn, n_train, seed)], "text string")
        lex = Names.of([*some, *_met(register, made)], traits)
    asked = repr((n_train, seed, [sorted(w) for x in (drawn, lex) for w in (x.given, x.family)], [sorted(t.items()) for t in traits]))
    key = hashlib.blake2b(asked.encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _TRAINED:
        if len(_TRAINED) > 3:
            _TRAINED.clear()
        _TRAINED[key] = Detector(lex, n_train, seed, drawn)
    names = _met(register, docs) if n > most else [tuple(r) for r in register.collect()]
    return _TRAINED[key].knowing(Names.of(names, traits))


def personal_spans(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_train: int = 7000) -> DataFrame:
    """``(doc_id, kind, found)``, each string once for a document and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(detector(lexicon, n_train, docs.select(text_col)))
    kind_of_id = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, found, at = [], [], [], []
            texts = b.column(1).to_pylist()
            for i, (text, spans) in enumerate(zip(texts, shared.value.find(texts))):
                for kind, s in sorted({(k, text[x:y]) for x, y, k in spans}):
                    at.append(i)
                    kinds.append(kind)
                    found.append(s)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["doc_id", "kind", "found"])

    rows = docs.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.mapInArrow(run, f"doc_id {kind_of_id}, kind string, found string").distinct()


def redacted(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_train: int = 7000) -> DataFrame:
    """``(doc_id, text, n_found)`` for every document: personal strings replaced by ``[EMAIL]`` and so on."""
    shared = docs.sparkSession.sparkContext.broadcast(detector(lexicon, n_train, docs.select(text_col)))
    kind_of_id = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out, n = [], []
            for text, spans in zip(texts, shared.value.find(texts)):
                for x, y, k in reversed(spans):
                    text = f"{text[:x]}[{k.upper()}]{text[y:]}"
                out.append(text)
                n.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "text", "n_found"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind_of_id}, text string, n_found long")
