import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from glyphmill.llm import common, rans, tokenio


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 65_536, 150_001])
@pytest.mark.parametrize("most", [1, 3, 50_257, 400_000])
def test_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype("<u4")
    s = rans.encode(ids)
    assert (rans.decode(s) == ids).all()
    blocks, steps, lanes = rans.shape_of(n)
    for b in {0, blocks - 1}:  # a block alone
        assert (rans.decode(s, [b]) == ids[b * steps * lanes : (b + 1) * steps * lanes]).all()


def test_near_entropy():
    ids = (np.random.default_rng(1).zipf(1.4, 400_000) % 20_000).astype("<u4")
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    assert 8 * len(rans.encode(ids)["words"]) / len(ids) < 1.08 * -(p * np.log2(p)).sum()


@pytest.mark.parametrize("part", ["words", "states"])
def test_damage_is_found(part):
    s = rans.encode(np.arange(70_000, dtype="<u4") % 977)
    raw = bytearray(s[part])
    raw[len(raw) // 2] ^= 1
    with pytest.raises(rans.Damaged):
        rans.decode(s | {part: bytes(raw)})


def test_files(spark, docs):
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    texts = {i: " ".join(rng.choice(["the", "word", "of", "zq\n", "é"], rng.integers(0, 300))) for i in range(300)} | {77: None, 78: "", 79: "x " * 50_000, 80: "<|endoftext|>", 81: "a word<|endoftext|> more é<|endoftext|>\n<|endoftext", 82: "plain <|endoftext|>"}
    d = docs([(i, t) for i, t in texts.items()]).repartition(7)
    folder = common.scratch_path(spark, "test-tokens")
    tokenio.write_ids(d, folder, P.path("byte_bpe_50k.json"), P.PATTERN, segment_ids=5000)
    assert spark.read.parquet(folder).count() >= 4
    got = {r.doc_id: r for r in tokenio.read_ids(spark, folder, with_ids=True).collect()}
    at = 0
    for i in sorted(texts):
        want = np.array([*hf.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        assert got[i].ids == want.tolist()
        at += len(want)


def test_edges(spark, edge_docs):
    folder = common.scratch_path(spark, "test-edges")
    tokenio.write_ids(edge_docs, folder, P.path("byte_bpe_50k.json"), P.PATTERN)
    got = sorted(((r.start, r.n_tokens, r.doc_id) for r in tokenio.read_ids(spark, folder).collect()))
    assert len(got) == edge_docs.count() and [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got)])[:-1].tolist()
    assert [g[2] for g in got] == sorted((r.doc_id for r in edge_docs.collect()), key=lambda i: (i is not None, i))
    empty = common.scratch_path(spark, "test-empty")
    tokenio.write_ids(edge_docs.limit(0), empty, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert tokenio.read_ids(spark, empty).count() == 0
