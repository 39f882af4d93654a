"""Personal data, also disguised: transducers that keep offsets, then the base patterns on what they give.

A transducer rewrites parts of a text and carries for each character of its output the source span that it stands for. Three
follow one another: homoglyphs (full-width and look-alike letters, other scripts' digits, invisible characters), "at" and "dot"
disguises, and spelled digits. The base patterns run on the source and on the output; spans of the output map back
to the source and are added where they overlap no base span of their kind.

Edge cases. Null and empty texts: no spans. Every pattern is linear in the text, long runs of digits or letters included.
Spans count code points. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common
from .spans import Span, span_table

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @: what stands before it as far as local characters reach."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_SET:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


#: Letters of other scripts that look like these Latin ones.
LOOK_ALIKES = {
    "a": "аα", "c": "сϲ", "e": "еє", "i": "іι", "j": "ј", "k": "кκ", "m": "м", "n": "п", "o": "оοօ", "p": "рρ", "s": "ѕ", "t": "т", "u": "υ", "v": "ν", "x": "хχ", "y": "у", "h": "һ", "d": "ԁ", "q": "ԛ", "w": "ԝ", "l": "ӏ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。｡", "-": "‐‑‒–—−",
}
INVISIBLE = "­​‌‍⁠﻿"


def _plain() -> dict[int, str]:
    out = {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)} | {0x3000: " ", 0xA0: " ", 0x2007: " ", 0x202F: " "}
    out |= {ord(x): plain for plain, xs in LOOK_ALIKES.items() for x in xs}
    for c in (*range(0x80, 0x10000), *range(0x1D7CE, 0x1D800)):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            out[c] = str(d)
    return out


PLAIN = _plain()
ODD = re.compile("[" + "".join(map(re.escape, INVISIBLE)) + "".join(re.escape(chr(c)) for c in sorted(PLAIN)) + "]")
HIDDEN = re.compile("[" + INVISIBLE + "]+")
OPEN_AT = re.compile(r"(?i)\s{0,3}[(\[{<]\s*+(at|@|arroba|dot|\.|punto|punkt)\s*+[)\]}>]\s{0,3}")
BARE_AT = re.compile(r"(?i)(?<=[A-Z0-9])(\s{1,3}(?:at|arroba)\s{1,3})[A-Z0-9-]{1,64}(?:(?:\s{1,3}(?:dot|punto|punkt)\s{1,3}|\.)[A-Z0-9-]{1,64})*?(?:\s{1,3}(?:dot|punto|punkt)\s{1,3})[A-Z0-9-]{1,64}(?:(?:\s{1,3}(?:dot|punto|punkt)\s{1,3}|\.)[A-Z0-9-]{1,64})*")
BARE_DOT = re.compile(r"(?i)\s{1,3}(?:dot|punto|punkt)\s{1,3}")
#: Names of the digits 0 to 9.
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGITS = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words.split())}
TIMES = {"double": 2, "triple": 3}
_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
SPELLED = re.compile(rf"(?i)\b(?:plus[\s,]{{1,3}}+)?{_WORD}(?:[\s,;.-]{{1,3}}+(?:(?:dot|punto|punkt|double|triple)[\s,;-]{{1,3}}+)?{_WORD})*+\b")
TOKEN = re.compile(r"(?i)[^\W\d_]+")
LEAST_SPELLED = 4
#: Shorter runs count where digits stand beside them: the base patterns decide what the whole is.
ASCII_DIGITS = frozenset("0123456789")
DIGIT_AHEAD = re.compile(r"[\s,;.-]{0,3}[(+]?[0-9]")
DIGIT_BEHIND = re.compile(r"[0-9][\s,;.-]{0,3}\Z")
#: Words that a run of spelled digits may hold, as they stand between white space and punctuation.
RUN_WORDS = frozenset([*DIGITS, *TIMES, "plus", "dot", "punto", "punkt"])


def has_spelled(low: str) -> bool:
    """Whether a lower-case text has LEAST_SPELLED words of a run one after another, or fewer beside digits."""
    words = low.replace("-", " ").replace(",", " ").replace(";", " ").replace(".", " ").split()
    in_run = bytes(map(RUN_WORDS.__contains__, words))
    if bytes([1]) * LEAST_SPELLED in in_run:
        return True
    at = in_run.find(1)
    while at >= 0:
        if at and words[at - 1][-1] in ASCII_DIGITS or at + 1 < len(words) and words[at + 1].lstrip("(+")[:1] in ASCII_DIGITS:
            return True
        at = in_run.find(1, at + 1)
    return False


def has_disguise(text: str, low: str) -> bool:
    """Never false where at_and_dot would rewrite something: each of its rules needs an open bracket or a dot written out."""
    return "(" in text or "[" in text or "{" in text or "<" in text or "dot" in low or "punto" in low or "punkt" in low


class Mapped:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def edited(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace [from, to) by a string; edits ascend and don't overlap."""
        if not edits:
            return self
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        texts.append(self.text[at:])
        starts.append(self.start[at:])
        ends.append(self.end[at:])
        return Mapped("".join(texts), np.concatenate(starts), np.concatenate(ends))


def homoglyphs(m: Mapped) -> Mapped:
    m = m.edited([(x.start(), x.end(), "") for x in HIDDEN.finditer(m.text)])
    return Mapped(m.text.translate(PLAIN), m.start, m.end)


def at_and_dot(m: Mapped) -> Mapped:
    edits = [(x.start(), x.end(), "@" if x[1].lower() in ("at", "@", "arroba") else ".") for x in OPEN_AT.finditer(m.text)]
    m = m.edited(edits)
    edits = []
    for x in BARE_AT.finditer(m.text):
        edits.append((*x.span(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(m.text, x.end(1), x.end())]
    m = m.edited(edits)
    edits = []  # dots written out behind an open @
    for x in re.finditer(r"(?i)@[A-Z0-9-]{1,64}((?:\s{1,3}(?:dot|punto|punkt)\s{1,3}[A-Z0-9-]{1,64})+)", m.text):
        edits += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(m.text, *x.span(1))]
    return m.edited(edits)


def spelled(m: Mapped) -> Mapped:
    edits: list[tuple[int, int, str]] = []
    for run in SPELLED.finditer(m.text):
        words = list(TOKEN.finditer(m.text, run.start(), run.end()))
        if len(words) < LEAST_SPELLED and not DIGIT_AHEAD.match(m.text, run.end()) and not DIGIT_BEHIND.search(m.text, max(run.start() - 4, 0), run.start()):
            continue
        times, at = 1, run.start()
        for w in words:
            s = w[0].lower()
            if w.start() > at:
                gap = m.text[at : w.start()]
                edits.append((at, w.start(), "." if gap.strip() == "." else "-" if gap.strip() == "-" else ""))
            new = "+" if s == "plus" else "." if s in ("dot", "punto", "punkt") else "" if s in TIMES else DIGITS[s] * times
            edits.append((w.start(), w.end(), new))
            times, at = TIMES.get(s, 1), w.end()
    return m.edited(edits)


def find_pii(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    m, low = Mapped(text), text.lower()
    if not text.isascii() and ODD.search(text):
        m = homoglyphs(m)
        low = m.text.lower()
    if has_disguise(m.text, low):
        m = at_and_dot(m)
    if has_spelled(low):
        m = spelled(m)
    if m.text == text:
        return base, []
    added = []
    for kind, a, b in base_spans(m.text):
        start, end = int(m.start[a]), int(m.end[b - 1])
        if not any(k == kind and start < e and s < end for k, s, e in base):
            added.append((kind, start, end))
    return base, added


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return span_table(docs, find_pii, KINDS, lambda s: (ORDER[s[0]], s[1]), id_col, text_col)


def op6_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
