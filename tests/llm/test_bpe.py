import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm import bpe, tokenio

PATH, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
OWN = bpe.ByteBpe.load(PATH, P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
HF = Tokenizer.from_file(JSON)
ENC = tokenio.Encoder(JSON, P.PATTERN)
TEXT = st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", " a", "ing", ". ", ", ", ".\n", "\n", "  ", "'s", "é", "œ", "x)", "12", "\x00", "\x1c", "\x85", " ", "²", "<|endoftext|>", "中文", "😀"]), max_size=20).map("".join))


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_as_tiktoken(text):
    assert ids(OWN.ids(text)) == TIK.encode_ordinary(text)
    assert OWN.decode(OWN.ids(text)) == text.encode()


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_as_tokenizers(text):
    got, n = ENC.ids([text, "", text])
    want = HF.encode(text, add_special_tokens=False).ids
    assert got.tolist() == want + want and n.tolist() == [len(want), 0, len(want)]


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000, "ab" * 30_000 + "!", "\n" * 9999 + "x"])
def test_long_pieces(text):
    assert ids(OWN.ids(text)) == TIK.encode_ordinary(text)


def test_compatibility_is_what_merging_gives():
    OWN.ids("thshtioned unbelievably rerewhthe ouonth zzqx 1234567 Straßenbahnhaltestelle")
    for left, right in list(OWN.fits):
        if left:
            a, b = left.encode("latin-1"), right.encode("latin-1")
            assert OWN.fits[left, right] == (OWN.merged(a + b) == [a, b])


def test_memos_start_anew(monkeypatch):
    m = bpe.Memo(len, most=3)
    assert [m[x] for x in ("a", "bb", "a", "ccc", "dddd", "a", "bb")] == [1, 2, 1, 3, 4, 1, 2] and len(m) <= 3
    monkeypatch.setattr(tokenio, "MEMO_PIECES", 5)
    e = tokenio.Encoder(JSON, P.PATTERN)
    for text in ("one two three four", "five six seven", "one two", "x" * 100 + " one"):
        assert e.ids([text])[0].tolist() == HF.encode(text, add_special_tokens=False).ids


def test_operator(edge_docs):
    got = bpe.encode_decode(edge_docs, PATH, P.PATTERN, with_ids=True).collect()
    assert len(got) == edge_docs.count()
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            raw = np.array(TIK.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
            assert bytes(r.ids) == raw and r.decoded == texts[r.doc_id]
    assert bpe.encode_decode(edge_docs.limit(0), PATH, P.PATTERN).count() == 0
