import re
from collections import defaultdict

from glyphmill.llm import mixing as M


def targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(size.values())
    while free:
        total = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / total > 3 * size[s] + 1e-9]
        if not full:
            return out | {s: left * w[s] / total for s in free}
        for s in full:
            out[s] = 3 * size[s]
            left -= out[s]
            free.discard(s)
    return out


def check(rows, got, near):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(size), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= near


def rows_of(counts):
    out, i = [], 0
    for source, n in counts.items():
        for k in range(n):
            i += 1
            out.append((i, " ".join(["w"] * (1 + (i * 37) % 90)), source))
    return out


def test_targets_and_words(docs):
    rows = rows_of({"a": 700, "b": 30, "É": 60, "z": 5, None: 40, "hot": 900})
    d = docs(rows)
    got = M.mix(d).collect()
    check(rows, got, near=1)
    again = M.mix(d.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_inclusion_is_fair(docs):
    """Every document of a source has about the same share of whole copies."""
    rows = [(i, "w w w", "a") for i in range(4000)] + [(i, "w w w", "b") for i in range(4000, 8000)]
    got = M.mix(docs(rows)).collect()
    share = [sum(r.copies for r in got if r.source == "a" and lo <= r.doc_id < lo + 1000) / 1000 for lo in range(0, 4000, 1000)]
    assert max(abs(s - 2 / 3) for s in share) < 0.06


def test_edges(edge_docs):
    rows = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    check(rows, M.mix(edge_docs).collect(), near=200)
    assert M.mix(edge_docs.limit(0)).count() == 0
    assert {r.taken for r in M.mix(edge_docs.where("doc_id in (1, 2, 3)")).collect()} == {0}
