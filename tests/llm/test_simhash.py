import random
import re

import numpy as np
import pytest
import xxhash

from glyphmill.llm import common as K
from glyphmill.llm import simhash as S


def slow(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    counts = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(sh))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("t", ["", " \n", "one", "One two\tTHREE", "a b c d", "a b c d e É x\x0by", "word " * 100_000, "naïve Ü a\xa0b c d e"])
def test_fingerprint(t):
    assert S.fingerprint(t.encode()) == slow(t)


def family(rng, n, spread):
    base = int(rng.integers(0, 1 << 63))
    return [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread), replace=False)) for _ in range(n)]


@pytest.mark.parametrize(("groups", "n", "spread"), [(200, 3, 9), (2, 700, 8), (1, 1500, 5)])
def test_forest_has_the_components_of_all_links(groups, n, spread):
    rng = np.random.default_rng(groups)
    fps = np.unique(np.array([f for _ in range(groups) for f in family(rng, n, spread)] + [0, 1, (1 << 64) - 1], np.uint64))
    keys, owners = S.posts(fps)
    order = np.argsort(keys, kind="stable")
    got = S.edges_of(keys[order], fps[owners[order]])
    links = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 4]]
    assert roots(fps.tolist(), got) == roots(fps.tolist(), links)
    assert all((a ^ b).bit_count() <= 4 for a, b in got)


def test_linked_ones_share_a_grid_point():
    rng = random.Random(5)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        (ka, _), (kb, _) = (S.posts(np.array([x], np.uint64)) for x in (a, b))
        assert set(ka.tolist()) & set(kb.tolist())


def test_documents(docs):
    rng, texts = random.Random(2), []
    for _ in range(30):
        words = [rng.choice("red blue green stone river tree house lamp".split()) + str(rng.randrange(50)) for _ in range(300)]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(300)] = "edit" + str(rng.randrange(9))
            texts.append(" ".join(copy))
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (2, ""), (0, "short text"), (None, "short text"), (None, "alone here")]
    got = S.near_duplicates(docs(rows)).collect()
    fps = [(i, slow(t)) for i, t in rows]
    nodes = sorted({f for _, f in fps})
    root = roots(nodes, [(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_chain_of_many_steps(spark):
    chain = [(i, i + 1) for i in range(200)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)}


def test_components_of_stars_and_random_graphs(spark):
    """Nodes of very many edges, whether smallest or largest of their component, and what hangs on their leaves; against a search from node to node."""
    rng = random.Random(5)
    edges = [(0, x) for x in range(1, 3000)] + [(x, 10_000) for x in range(5000, 8000)] + [(x, x + 20_000) for x in range(2500, 2600)]
    edges += [(rng.randrange(40_000, 40_400), rng.randrange(40_400, 40_800)) for _ in range(350)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = node
                todo += near[at]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_edges(edge_docs):
    assert S.near_duplicates(edge_docs).count() == edge_docs.count()
    assert S.near_duplicates(edge_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.links(edge_docs.selectExpr("doc_id as fp"), most=9)


def test_similar_groups(docs):
    """Copies that share 0.9 of their shingles are found, unlike texts are left alone."""
    rng, rows = random.Random(4), []
    for g in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(400)]
        rows.append((10 * g, " ".join(words)))
        for k in (1, 2):
            copy = list(words)
            for at in rng.sample(range(0, 400, 10), 4):
                copy[at] = f"edit{g}{k}{at}"
            rows.append((10 * g + k, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs(rows)).collect()}
    assert all(c == i - i % 10 or c == i for i, c in got.items())
    assert sum(got[i] == i - i % 10 for i, _ in rows if i % 10) >= 0.95 * 120


def test_similar_groups_edges(edge_docs):
    assert S.similar_groups(edge_docs).count() == edge_docs.count()
    assert S.similar_groups(edge_docs.limit(0)).count() == 0


def test_similar_groups_are_those_of_exact_shingle_sets(docs):
    """Near copies on both sides of a similarity of 0.8, all with one common passage: neither missed nor linked below it."""
    rng, texts, passage = random.Random(11), [], [f"shared{k}" for k in range(60)]
    for g in range(50):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((6, 30, 120, 500)))]
        texts.append(" ".join(words + passage))
        for _ in range(5):
            copy, at = list(words), rng.randrange(len(words))
            for k in range(at, min(len(words), at + round(len(words) * rng.uniform(0, 0.16)))):
                copy[k] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy + passage))
    texts += ["", " ", "one two", "One  TWO", texts[0].upper()]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    share = {(i, j): len(a & b) / len(a | b) if a | b else 1.0 for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    assert sum(0.75 <= x < 0.8 for x in share.values()) > 20 and sum(0.8 <= x < 0.85 for x in share.values()) > 20
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs(list(enumerate(texts)))).collect()}
    assert got == roots(range(len(texts)), [p for p, x in share.items() if x >= 0.8])


def test_candidates_lose_no_pair_at_the_limit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 40, 400, 1025, 3000):
        inter = -(-8 * n // 9)  # of two sets of n: a similarity of 0.8 or just above
        pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:inter], pool[n : 2 * n - inter]]))
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        assert set(S.prefix(a, *none).tolist()) & set(S.prefix(b, *none).tolist())
        both = S.Sketches([S.sketch(a).tobytes(), S.sketch(b).tobytes()], np.array([len(a), len(b)]))
        assert both.may_share(np.array([0]), np.array([1])).all()
        assert S.shared_forest([a, b]) == [(0, 1)]


def test_posts_that_cannot_meet_stop_at_the_first_exchange():
    """Of pairs at 0.8 or more the first common post goes on; chance meetings of sets unlike in size or late in their prefix don't."""
    rng, none = np.random.default_rng(7), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for n in (1, 2, 4, 5, 9, 40, 400, 1025):
        for m in {n, -(-4 * n // 5), -(-9 * n // 10)}:  # a set of n and one of m that share just enough
            inter = -(-4 * (n + m) // 9)
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n + 20).astype(np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:inter], pool[n : n + m - inter]]))
            p, q = (S.prefix(x, *none) for x in (b, a))
            rows = sorted([(k, m, i) for i, k in enumerate(p.tolist())] + [(k, n, i) for i, k in enumerate(q.tolist())])
            keys, sizes, places = (np.array(x) for x in zip(*rows, strict=True))
            first = next(k for k in p.tolist() if k in q.tolist())
            assert S.may_meet(keys, sizes, places)[keys == first].all()
    assert S.may_meet(*map(np.array, ([1, 1, 2, 2, 3], [100, 300, 100, 100, 5], [0, 0, 19, 19, 0]))).tolist() == [False] * 5
    assert S.may_meet(*map(np.array, ([1, 1, 2, 2], [100, 101, 80, 100], [0, 3, 0, 0]))).all()
    assert S.may_meet(np.zeros(2000, np.int64), np.full(2000, 100), np.where(np.arange(2000) % 1000, 20, 0)).all()  # many neighbours: the key goes on


def test_near_stage_leaves_its_result_only(spark, docs):
    """Intermediate tables and shuffle files of the stage don't stay on disk till the driver ends."""
    before = set(K._made)
    texts = [" ".join(f"w{g}x{k}" for k in range(60)) for g in range(20)]
    d = docs([(2 * i + k, t + " end" * k) for i, t in enumerate(texts) for k in (0, 1)])
    out = S.without_near_copies(d)
    assert {p.split("glyphmill-")[-1].rsplit("-", 1)[0] for p in set(K._made) - before} <= {"near-decided", "odd-keys", "cc"}
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))


def test_near_stage_takes_candidates_from_fingerprints(docs, monkeypatch):
    """Groups of the fingerprints' links, against all pairs; posts that meet none of another group go no further."""
    rng, texts, seen, real = random.Random(8), [], [], S.simhash_groups
    for g in range(20):
        words = [f"w{g}x{rng.randrange(10**6)}" for _ in range(300)]
        for k in range(4):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(300)] = f"edit{k}"
            texts.append(" ".join(copy))
    texts += ["", "a b", "A  b", texts[0].upper()]
    monkeypatch.setattr(S, "simhash_groups", lambda own, tables: seen.append(real(own, tables)) or seen[-1])
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs(list(enumerate(texts)))).collect()}
    assert got == {i: i // 4 * 4 for i in range(80)} | {80: 80, 81: 81, 82: 81, 83: 0}
    fp = {S.set_class(S.shingle_set(t.encode())): slow(t, 5) for t in texts}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    want = roots(fp, links)
    named = {r.cls: r.grp for r in seen[0].collect()}
    assert len(links) > 20 and named == {c: want[c] for c in {x for e in links for x in e}}
    run = [np.full(3, k) for k in (1, 100, 0)]
    assert S.may_meet(*run, np.array([5, 5, 5])).tolist() == [False] * 3 and S.may_meet(*run, np.array([5, 5, 6])).all()


def test_rounds_change_nothing(spark, monkeypatch):
    """Exchanges that would outgrow the input go in rounds, with the same groups."""
    assert [S.rounds_for(x, n) for x, n in ((None, None), (0, 5), (S.LEAST_ROUND, 0), (10 * S.LEAST_ROUND, 0), (12e9, 10**9))] == [1, 1, 1, 10, 6]
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = lambda: {(r.doc_id, r.component_id) for r in S.similar_groups(docs, part=64).collect()}
    whole = groups()
    made, written = [], K.Passing.written
    monkeypatch.setattr(S, "rounds_for", lambda total, shingles: 2)
    monkeypatch.setattr(K.Passing, "written", lambda self, df, name: made.append(name) or written(self, df, name))
    assert groups() == whole
    assert {"near-candidates-1", "near-crossed-1"} <= set(made)
