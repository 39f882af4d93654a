"""Secret scan: base patterns, and novelty against a dictionary-primed zstandard compressor.

Added spans (kind novel): a string of MIN_LENGTH or more characters that starts within REACH characters behind the sensitive word before it, on its
line or below, or goes on from such a string on the next line, and holds a digit and letters. Its novelty is the bytes that it adds to the
compressed form of the text around it, by a compressor primed with identifiers that code commonly uses; the lines of a wrapped string also count together. Names, words and copies of what stands
nearby cost little. What chance would cost depends on alphabet, length and surroundings, so it is measured too: STAND_INS random strings of the same length and
the same classes of characters take the string's place, and it is reported if it costs RANDOM of their mean or more.

A string ends where the next sensitive word begins and belongs to the nearest word before it, so no character is looked at twice, added spans
don't overlap, and none holds a sensitive word. At most AROUND characters on both sides are compressed with a string.

Edge cases. Null and empty texts: no spans. Long texts: every step is linear. A candidate within a base span is not added again.
Repeated rows give repeated results. Empty table: empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import cache

import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common
from .spans import Span, span_table

KINDS = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*KINDS, "novel"))}
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"(?ai)passphrase|password|passwd|secret|token|credential|bearer|authorization|(?:api|private|access|signing)(?:[_-]|\s{1,3})?key")
SENSITIVE_PARTS = ("passphrase", "passw", "secret", "token", "credential", "bearer", "authorization", "key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]+")
#: Between a word and its value, not part of it.
JOINT = "=_~.-"
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Between the lines of a wrapped string.
WRAP = re.compile(r"""[\x20\t"'\\+,]{0,8}\r?\n[\x20\t"'+]{0,64}""")
MIN_LENGTH, REACH, AROUND = 16, 64, 160
#: Share of the cost of random strings that counts as random, and how many of them are measured.
RANDOM, STAND_INS = 0.88, 3
#: What prose and code are made of, so that it compresses to little.
IDENTIFIERS = """
import from return class function const static public private protected void string int float double boolean true false null none self this
def lambda async await yield try except catch finally throw raise for while if else elif switch case break continue new delete typeof instanceof
config configuration settings environment variable parameter argument value default option header request response session cookie client server
username user_name user_id email address account database connection hostname localhost port endpoint base_url timeout retry version
password passwd secret token api_key apikey access_key private_key client_secret client_id credential authorization bearer signature certificate
example placeholder changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
the of and to in is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said
application/json text/html utf-8 content-type https://www.example.com/index.html http://localhost:8080/ /usr/local/bin /etc/ /home/user/
"""


@cache
def compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(text: str, start: int, end: int) -> tuple[float, float]:
    """Marginal bits a character of text[start:end] in its surroundings, and the mean of what its stand-ins would cost there."""
    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    size = lambda x: len(compressor().compress(x.encode()))
    own, alone = text[start:end], size(around)
    bits = [8 * (size(around + x) - alone) / len(own) for x in (own, *stand_ins(own))]
    return bits[0], sum(bits[1:]) / STAND_INS


def stand_ins(s: str) -> list[str]:
    """Random strings as long as s of the digits, the hexadecimal letters or all of a case, and the other characters that s has. The same for the same s."""
    seen = set(s)
    alphabet = "0123456789" * any(c.isdigit() for c in seen) + "".join(sorted(c for c in seen if not c.isalnum()))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if own := seen & set(letters):
            alphabet += letters[:6] if own <= set(letters[:6]) else letters
    draw = random.Random(s)
    return ["".join(draw.choices(alphabet, k=len(s))) for _ in range(STAND_INS)]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[list[tuple[int, int]]]:
    """Strings behind sensitive words, in order; the lines of a wrapped string in one list."""
    out: list[list[tuple[int, int]]] = []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    for k, (_, end) in enumerate(words):
        last = None
        for m in CANDIDATE.finditer(text, end, words[k + 1][0] if k + 1 < len(words) else len(text)):
            wrapped = last is not None and last[1] - last[0] >= MIN_LENGTH and WRAP.fullmatch(text, last[1], m.start())
            if m.start() >= end + REACH and not wrapped:
                break
            if m.start() == end:  # the value follows the word itself
                last = (m.end() - len(m[0].lstrip(JOINT)), m.end())
            else:
                last = m.span()
            if wrapped:
                out[-1].append(last)
            else:
                out.append([last])
    return out


def novel_spans(text: str, base: list[Span]) -> list[Span]:
    low = text.lower()
    if not any(x in low for x in SENSITIVE_PARTS):
        return []
    starts, reach = sorted(b for _, b, _ in base), []
    for _, _, e in sorted(base, key=lambda x: x[1]):
        reach.append(max(e, reach[-1] if reach else 0))
    out = []
    for lines in candidates(text):
        measured = []
        for start, end in lines:
            s = text[start:end]
            if end - start < MIN_LENGTH or "://" in s or not DIGIT.search(s) or not LETTER.search(s):
                continue
            at = bisect_right(starts, start)
            if at and reach[at - 1] >= end:
                continue
            bits, chance = novelty(text, start, end)
            measured.append((start, end, bits, RANDOM * chance))
        whole = sum((e - b) * bits for b, e, bits, _ in measured) >= sum((e - b) * least for b, e, _, least in measured)
        out += [("novel", b, e) for b, e, bits, least in measured if whole or bits >= least]
    return out


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, novel_spans(text, base)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return span_table(docs, find_secrets, KINDS, lambda s: (s[1], ORDER[s[0]]), id_col, text_col)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
