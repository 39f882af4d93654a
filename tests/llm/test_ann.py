import math

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "q", 1.0) for i, v in rows], "vec_id long, embedding array<float>, query_id string, score double")


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[ids.index(q)]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64))
    x = (centres[rng.integers(0, 10, 6000)] + 1.2 * rng.normal(size=(6000, 64))).astype(np.float32)
    d = frame(spark, list(enumerate(x)))
    got = ann.nearest(d, F.col("vec_id") % 60 == 0, shard=2500).collect()
    want = brute(list(range(6000)), x.astype(float), range(0, 6000, 60), 20)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) for q, w in want.items())
    assert hits / (20 * len(want)) >= 0.9
    assert all(math.isclose(r.score, float((x[r.vec_id].astype(float) * x[r.query_id].astype(float)).sum()), rel_tol=1e-12, abs_tol=1e-12) for r in got)
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))


def test_edges(spark):
    rows = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [1, None]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [1, 2, 3]), (7, [2, 0]), (8, [2, 0]), (20, [0, 1]), (20, [0, 1]), (None, [1, 1]), (9, []), (40, [1, 0, 1])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    twice = [(20, 1, 20, 1.0), (20, 2, 0, 0.0), (20, 3, 7, 0.0), (20, 4, 8, 0.0)]
    assert got == sorted([(0, 1, 7, 2.0), (0, 2, 8, 2.0), (0, 3, 20, 0.0), (0, 4, 20, 0.0), *twice, *twice, (40, 1, 6, 4.0)])
    assert ann.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_small_tables_use_the_index(spark):
    """500 random vectors, the hardest case: what is found comes through the pivot files, which rank 210 of them again."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    got = ann.nearest(frame(spark, list(enumerate(x))), F.col("vec_id") % 20 == 0, least=60).collect()
    want = brute(list(range(500)), x.astype(float), range(0, 500, 20), 20)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) for q, w in want.items())
    assert hits / (20 * len(want)) >= 0.8


def test_empty(spark):
    assert ann.nearest(frame(spark, [(1, None)]), F.col("vec_id") > 0).count() == 0
