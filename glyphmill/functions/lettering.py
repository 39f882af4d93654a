"""Dot letters, for legends and synthetic pages."""

from __future__ import annotations

import numpy as np

#: Letters of three by five dots, a row a digit (4: left, 2: middle, 1: right).
DOTS = dict(
    zip(
        "abcdefghijklmnopqrstuvwxyz0123456789:._-/ ",
        "25755 65656 34443 65556 74647 74644 34553 55755 72227 11152 55655 44447 57755 65555 25552 65644 25563 65655 34216 72222 55557 55552 55775 55255 55222 71247 75557 26227 61247 61216 55711 74617 34657 71224 25252 35716 02020 00002 00007 00700 11244 00000".split(),
        strict=True,
    )
)


def letters(text: str, size: int = 2) -> np.ndarray:
    """Which pixels are ink where a text is written in dots of a size."""
    rows = [[int(r) for r in DOTS.get(c, "77777")] for c in text.lower()]
    cols = [np.array([[r >> 2 & 1, r >> 1 & 1, r & 1, 0] for r in glyph], bool) for glyph in rows]
    return np.kron(np.concatenate([np.zeros((5, 0), bool), *cols], axis=1), np.ones((size, size), bool)).astype(bool)
