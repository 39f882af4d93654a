"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes map to Latin-1 characters, so that a pyahocorasick trie of the vocabulary finds the longest token at
a position. A sequence of tokens is what the merges would give exactly when every two neighbours are
compatible, that is when merging the bytes of the two alone gives the two back. The encoder takes
the longest match, goes to the next shorter token while it is incompatible with its left neighbour, and pops
the neighbour where none fits; every position is given up at most once, so the time is linear. Compatibility
is memoised, and so are the ids of pieces of text.

Edge cases. Null and empty texts: no ids, the hashes of no bytes. Long texts go through in pieces. Bytes that are
no valid UTF-8 cannot occur in a string column. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Entries of a generation of each memo, of which there are two, so a worker's memory is bounded.
MEMO = 150_000
PAIRS, TOKENS = 100_000, 20_000
#: Longer strings are never memoised.
LONG = 64
#: A single space between characters that are no white space always begins a new piece.
SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: White space as the pattern's own library has it, in place of the class of this one.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space but the space and the newline: in ASCII, and beyond.
ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def own_pattern(pattern: str) -> str:
    """The pattern with its white-space classes written out, so both libraries split alike."""
    return pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def is_lone(text: str) -> bool:
    """Whether every space of a text that isn't empty is a lone one, between characters that are no white space."""
    lone = "  " not in text and " \n" not in text and "\n " not in text and text[0] != " " and text[-1] != " "
    return lone and not any(c in text for c in ASCII_SPACE) and (text.isascii() or not any(c in text for c in WIDE_SPACE))


def chunks(text: str) -> list[str]:
    """Cut a text where a piece surely begins: before a lone space. The parts joined are the text."""
    parts = text.split(" ") if is_lone(text) else SPLIT.split(text)
    return parts[:1] + [" " + x for x in parts[1:]]


class Memo(dict):
    """A dict that fills itself. Full, it becomes the old generation and a new one begins; what is still used moves over."""

    def __init__(self, make: Callable, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > LONG:
                return out
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = out
        return out


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token in ranks:
            self.trie.add_word(token.decode("latin-1"), len(token))
        self.find = regex.compile(own_pattern(pattern)).findall
        self.fits = Memo(self._fits, PAIRS)
        self.head = Memo(self._head, PAIRS)
        self.four = {t.decode("latin-1"): i.to_bytes(4, "little") for t, i in ranks.items()}
        self.chunk = Memo(self._chunk)
        self.down = Memo(self._down, TOKENS)
        self.longest = max(map(len, ranks), default=1)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, raw: bytes) -> list[bytes]:
        """The merges themselves, lowest rank first; only for the bytes of two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; nothing for a single byte or a token that no merges give."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _down(self, side_token: tuple[int, str]) -> list[tuple[int, bytes]]:
        """What touches the boundary before each merge, latest first: (rank, token), of the right or left edge."""
        side, token = side_token[0], side_token[1].encode("latin-1")
        out = [(self.ranks[token], token)]
        while halves := self._halves(token):
            token = halves[side]
            out.append((self.ranks[token], token))
        return out

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether no merge crosses the boundary. Undoing the later of the two merges beside it shows which
        two tokens meet there at each time; a merge of them that comes before the next own merge crosses."""
        if not pair[0]:
            return self.merged(raw := pair[1].encode("latin-1")) == [raw]
        left, right, rank = self.down[1, pair[0]], self.down[0, pair[1]], self.ranks.get
        i, j, most = 0, 0, 1 << 62
        while True:
            if rank(left[i][1] + right[j][1], 1 << 62) < most:
                return False
            more_left, more_right = i + 1 < len(left), j + 1 < len(right)
            if more_left and (left[i][0] > right[j][0] or not more_right):
                most, i = left[i][0], i + 1  # of equal ranks the left pair goes first
            elif more_right:
                most, j = right[j][0] + 1, j + 1
            else:
                return True

    def _head(self, path: str) -> str:
        """The longest token that a path of the trie begins with."""
        return next((path[:k] for k in range(len(path), 0, -1) if self.trie.exists(path[:k])), "")

    def _chunk(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha() or len(pieces := self.find(chunk)) == 1:
            return self._piece(chunk)
        known = self.chunk
        return b"".join([known[x] if x in known else self._piece(x) for x in pieces])

    def _piece(self, piece: str) -> bytes:
        s = piece if piece.isascii() else piece.encode().decode("latin-1")
        return self.four.get(s) or b"".join(map(self.four.__getitem__, self.split(s)))

    def split(self, s: str) -> list[str]:
        """Tokens of one piece, as Latin-1 strings."""
        out: list[str] = []
        at, n, dead = 0, len(s), set()
        path, head, fits, most = self.trie.longest_prefix, self.head, self.fits, self.longest
        token = head[s[: path(s[:most])]]
        while at < n:
            left = out[-1] if out else ""
            while token and (dead and at + len(token) in dead or not fits[left, token]):
                token = head[token[:-1]]
            if token:
                out.append(token)
                at += len(token)
                rest = s[at : at + most]
                token = head[rest[: path(rest)]]
            elif out:  # nothing fits here: never end a token here again, and shorten the one before
                dead.add(at)
                token = out.pop()
                at -= len(token)
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunk.__getitem__, chunks(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder a worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.load(path, pattern)
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids (array of int) and decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            n, a, b, raw, back = [], [], [], [], []
            for text in batch.column(1):
                ids = own.ids(text.as_py())
                decoded = own.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    raw.append(ids)
                    back.append(decoded.decode())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(raw, pa.binary()), pa.array(back, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return common.map_partitions(common.id_text(docs, id_col, text_col), run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
