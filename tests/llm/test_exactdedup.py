import hashlib
from collections import defaultdict

import pytest

from glyphmill.llm import exactdedup as X


def brute(rows, keep=max):
    norm = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        out.append((i, keep(ids) if ids else None, len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(i, t) for i, t in enumerate(["a", "A", "b", None, "", "É", "é", "b ", "long " * 5000, "LONG " * 5000, "a"])]


@pytest.mark.parametrize(("keep", "f"), [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_groups(docs, keep, f, digest_bytes):
    """Also with digests so short that different texts collide: bytes decide."""
    got = X.dedup(docs(ROWS), keep=keep, digest_bytes=digest_bytes, memtable_rows=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS, f)
    assert {r.doc_id for r in got if r.kept} == {k for _, k, *_ in brute(ROWS, f)}


def test_edges(edge_docs):
    got = X.dedup(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert len([r for r in got if r.kept]) == len({r.text_sha256 for r in got})  # one row stays of each text, repeated rows too
    assert [r.keep_id for r in got if r.doc_id is None and r.group_size == 1] == [None]


def test_empty(docs):
    assert X.dedup(docs([(1, "a")]).where("doc_id > 1")).count() == 0


def test_filter_has_no_false_negatives():
    f, keys = X.Filter(1 << 14), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(700)]
    f.add(keys)
    assert f.has(keys).all()
    assert f.has([hashlib.sha256(b"other" + bytes([i])).digest() for i in range(200)]).mean() < 0.2


def test_unknown_keep(docs):
    with pytest.raises(ValueError):
        X.dedup(docs([(1, "a")]), keep="first")


def test_merged_runs_keep_one_entry_a_digest(spark):
    rows = [(bytes([k % 7]), (k * 13) % 50 if k % 5 else None, 1 + k % 3) for k in range(200)]
    got = {bytes(r.digest): (r.id, r.n) for r in X.merged_runs(spark.createDataFrame(rows, "digest binary, id long, n long").repartition(5), "smallest").collect()}
    want = {d: (min(i for x, i, _ in rows if x == d and i is not None), sum(n for x, _, n in rows if x == d)) for d, *_ in rows}
    assert got == want


def test_index_is_kept_and_grown(spark, docs, tmp_path):
    """Batch by batch, with compaction on the way, against a plain dictionary."""
    folder, held = f"file://{tmp_path}/index", {}
    batches = [[(5, "a"), (6, "b"), (7, "A")], [(1, "a"), (8, "c")], [], [(None, "d"), (9, None)], [(3, "b"), (10, ""), (2, "d")]]
    for batch in batches:
        got = sorted(((r.doc_id, r.seen, r.keep_id) for r in X.extend(docs(batch) if batch else docs([(1, "x")]).limit(0), folder, most_levels=3).collect()), key=repr)
        before, norm = dict(held), lambda t: (t or "").lower()
        for i, t in batch:
            ids = [x for x in (held.get(norm(t)), i) if x is not None]
            held[norm(t)] = min(ids) if ids else None
        assert got == sorted(((i, norm(t) in before, held[norm(t)]) for i, t in batch), key=repr)
    assert len(X.levels(spark, folder)) < 3
