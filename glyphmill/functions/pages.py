"""Synthetic pages: lines of a template, drawn in dot letters, with a box for every line, word and character.

A page is (image, text, boxes); a box is (what, pos, text, type, x, y, w, h). Character boxes are those of the ink itself.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from datetime import date, timedelta

import numpy as np

from .lettering import letters
from .text import FAMILY, GIVEN, NRIC_WEIGHTS, FG_LETTERS, ST_LETTERS, STREETS

DPI, DOT, MARGIN, PITCH = 200, 3, 24, 27
WORDS = "page north river lamp stone house field green paper light market letter seven water road garden early silver".split()


@dataclass
class Page:
    image: np.ndarray
    text: str = ""
    boxes: list[tuple] = field(default_factory=list)


def identity_number(rng: random.Random) -> str:
    prefix, digits = rng.choice("STFG"), [rng.randrange(10) for _ in range(7)]
    total = sum(d * w for d, w in zip(digits, NRIC_WEIGHTS, strict=True)) + 4 * (prefix in "TG")
    return prefix + "".join(map(str, digits)) + (ST_LETTERS if prefix in "ST" else FG_LETTERS)[total % 11]


def name(rng: random.Random) -> str:
    return f"{rng.choice(FAMILY)} {rng.choice(GIVEN)}"


def day(rng: random.Random, start: date = date(2026, 1, 1), days: int = 300) -> str:
    return (start + timedelta(days=rng.randrange(days))).strftime("%d-%m-%Y")


def account(rng: random.Random) -> str:
    return f"{rng.randrange(100, 999)}-{rng.randrange(100000, 999999)}-{rng.randrange(9)}"


def lines_of(template: str, rng: random.Random) -> tuple[int, int, list[tuple[str, str]], list[tuple[str, int, int, int, int]]]:
    """Width, height, lines with the type of what each line's last part gives away, and regions without text."""
    if template == "id_card":
        rows = [("identity card", ""), (f"no. {identity_number(rng)}", "nric"), (f"name {name(rng)}", "name"), (f"born {day(rng, date(1950, 1, 1), 365 * 55)}", "dob"), (f"blk {rng.randrange(1, 900)} {rng.choice(STREETS)}", "address")]
        return 640, 260, rows, [("photo", 500, 60, 100, 130)]
    if template == "cheque":
        cents = rng.randrange(100, 2_000_000)
        rows = [("bank of the north", ""), (f"date {day(rng)}", ""), (f"pay {name(rng)}", "name"), (f"amount {cents // 100}.{cents % 100:02d}", "amount"), (f"account {account(rng)}", "account")]
        return 720, 280, rows, [("signature", 500, 180, 180, 60)]
    if template == "receipt":
        items = [(f"{rng.choice(WORDS)} {rng.choice(WORDS)} {rng.randrange(100, 9999) / 100:.2f}", "") for _ in range(rng.randint(4, 10))]
        return 460, 140 + PITCH * (len(items) + 2), [("corner shop", ""), (day(rng), ""), *items, (f"total {rng.randrange(1000, 99999) / 100:.2f}", "amount")], []
    if template == "form":
        rows = [("application form", ""), (f"full name: {name(rng)}", "name"), (f"number: {identity_number(rng)}", "nric"), (f"date: {day(rng)}", ""), *((f"{rng.choice(WORDS)}: {rng.choice(WORDS)} {rng.choice(WORDS)}", "") for _ in range(6))]
        return 700, 380, rows, [("logo", 560, 20, 110, 40)]
    if template.startswith("plain_"):
        return 800, 480, [(" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 9)))[:60], "") for _ in range(14)], []
    raise ValueError(f"there is no template {template!r}")


def page(template: str, rng: random.Random) -> Page:
    width, height, rows, regions = lines_of(template, rng)
    out = Page(np.full((height, width), 255, np.uint8), "\n".join(t for t, _ in rows))
    chars = words = pii = 0
    for i, (text, kind) in enumerate(rows):
        y, x, inked = MARGIN + PITCH * i, MARGIN, []
        for word in text.split(" "):
            first = len(inked)
            for ch in word:
                dots = letters(ch, DOT)[:, : 3 * DOT]
                part = out.image[y : y + dots.shape[0], x : x + dots.shape[1]]
                part[dots[: part.shape[0], : part.shape[1]]] = 20
                ys, xs = np.nonzero(dots)
                if len(ys) and x + dots.shape[1] <= width and y + dots.shape[0] <= height:
                    inked.append((x + int(xs.min()), y + int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1))
                    out.boxes.append(("chars", chars, ch, "", *inked[-1]))
                    chars += 1
                x += 4 * DOT
            if len(inked) > first:
                out.boxes.append(("words", words, word, "", *around(inked[first:])))
                words += 1
            x += 4 * DOT
        if inked:
            out.boxes.append(("lines", i, text, "", *around(inked)))
            if kind:
                out.boxes.append(("pii", pii, text.split(" ", 1)[-1], kind, *around(inked)))
                pii += 1
    for i, (kind, x, y, w, h) in enumerate(regions):
        out.image[y : y + h, x : x + w] = 170
        out.boxes.append(("regions_nontext", i, "", kind, x, y, w, h))
    return out


def around(boxes: list[tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y
